"""The last step of every search: the k nearest of each query, ranked by distance and then id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(found: DataFrame, k: int, unique: bool = False) -> DataFrame:
    """(qid, rk, id, distance) from candidates (qid, id, distance). unique: an id that came more than once counts once.

    Catalyst turns the filter on the rank into a group limit before and after the shuffle on qid.
    """
    if unique:
        found = found.groupBy("qid", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rk", rank.cast("bigint")).where(F.col("rk") <= k).select("qid", "rk", "id", "distance")
