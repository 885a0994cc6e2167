"""Recall and distance ratio of approximate results against exact ones, as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: recall, the mean share of each query's k true neighbours that were found."""
    hit = truth.where(F.col("rk") <= k).select("qid", "id").join(found.where(F.col("rk") <= k).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.lit(k)).alias("share")).agg(F.avg("share").alias("recall"))


def distance_ratio(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: ratio, the mean over queries of the sum of found distances by the sum of true ones."""
    total = lambda x, name: x.where(F.col("rk") <= k).groupBy("qid").agg(F.sum("distance").alias(name))
    return total(found, "got").join(total(truth, "best"), "qid").agg(F.avg(F.col("got") / F.col("best")).alias("ratio"))


def validate(index, k: int = 15, queries: DataFrame | None = None, every: int = 1, **params) -> tuple[float, float]:
    """(recall, distance ratio) of an index against a flat scan of its vectors, for the given queries or its rows whose id is divisible by ``every``."""
    from .cells import CellIndex

    asked = queries if queries is not None else index.vectors.where(F.col("id") % every == 0)
    truth = CellIndex.build(index.vectors, "exhaustive", index.metric).query(asked, k)
    found = index.query(asked, k, **params)
    return recall(found, truth, k).first()[0], distance_ratio(found, truth, k).first()[0]


#: Indexed rows that a search is measured with.
MEASURED = 256


def widened(index, k: int, recall: float = 0.9, **params) -> dict:
    """Search parameters, the given ones or wider, at which each of up to ``MEASURED`` indexed rows finds more than the share ``recall`` of its k nearest.

    The rows are those with the smallest hashes among ids that 50 doesn't divide (these are often what is asked), and the index is asked with them and compared with a flat scan of all its
    vectors. Where one finds less, all widths of the method are doubled, up to those at which every row is looked at; widths that do are doubled once more, for rows that weren't measured.
    """
    from .cells import CellIndex

    rows = index.vectors.where("id % 50 <> 0").orderBy(F.xxhash64("id", F.lit(7))).limit(MEASURED)
    asked = materialise(rows if rows.count() else index.vectors.limit(MEASURED))
    truth = materialise(CellIndex.build(index.vectors, "exhaustive", index.metric).query(asked, k))
    params, least = dict(params), min(k, int(recall * k) + 1)
    while True:
        found = index.query(asked, k, **params).select("qid", "id", F.lit(1).alias("hit"))
        worst = truth.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("n"), F.count("*").alias("all")).agg(F.min(F.col("n") - F.least("all", F.lit(least)))).first()[0]
        wider = index.wider(k, params)
        if wider == params or worst >= 0:
            return wider
        params = wider


def reached(index, queries: DataFrame, truth: DataFrame, k: int, recall: float = 0.9, **params) -> DataFrame:
    """(qid, rk, id, distance) of queries that find the share ``recall`` of their rows in ``truth`` at the given widths; those that find less ask again with all widths doubled, until none does or every row was looked at."""
    found, truth = None, truth.select("qid", "id")
    while True:
        own = materialise(index.query(queries, k, **params))
        hit = truth.join(own.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("n"), F.count("*").alias("all"))
        short = materialise(hit.where(F.col("n") < recall * F.col("all")).select("qid"))
        wider = index.wider(k, params)
        if wider == params or not short.count():
            return found.unionByName(own) if found else own
        kept = own.join(short, "qid", "left_anti")
        found = found.unionByName(kept) if found else kept
        queries, truth, params = queries.join(short.select(F.col("qid").alias("id")), "id", "left_semi"), truth.join(short, "qid", "left_semi"), wider
