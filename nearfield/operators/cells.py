"""One index for every method whose candidates are cells: flat scans, inverted files, spilled files, hashes and trees, over raw or coded vectors.

The index is two tables: ``rows`` (cell, home, id, code), sorted by cell, with a
row for each copy of a vector, and ``vectors`` (id, vec) for exact re-ranking.
A query is a list of cells per query row, a scan of these cells by blocks in
numpy, and a top-k. Two plans give the same result:

* Queries up to ``BROADCAST_BYTES`` are broadcast with their cell lists; rows are scanned where they
  lie, nothing of the index is shuffled, and each task sends on at most k
  candidates a query. A task knows what a query's k-th distance can't exceed after its first cell, and from then on only looks at what is nearer.
* More queries than that are dealt by cell and meet the rows of a cell in a
  co-group. Cells over ``CELL_ROWS`` rows, and those that over ``QUERY_BLOCK`` queries look at (both are counted), are cut into
  salted blocks first, so no task holds a whole hot cell.

Candidates of all rows that are scored again by their vectors have a plan of their own: each block of queries meets all rows, codes and
vectors side by side, in one task, so that neither candidates of parts of the rows nor pairs are written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs as C
from ..functions.blocks import BLOCK_CELLS, binaries, lists, matrix, merge_top, near, top
from ..functions.vectors import distance, parse_metric
from ..sources import persist
from ..sources.tables import materialise
from . import routers as R
from .topk import top_k

BROADCAST_BYTES = 256 << 20
CELL_ROWS = 20_000
QUERY_BLOCK = 20_000
#: Cells up to which a scan is told which ones to read, for Parquet to skip the rest.
PUSHED_CELLS = 500
#: Rows of a cell that are scored together, and candidates that a task gathers before it drops those that can't be among the nearest.
SCAN_ROWS, GATHERED = 8_192, 2_000_000
#: Candidates that a block of queries holds while rows pass, to be scored again.
HELD = 500_000
#: Bytes of an index that a partition should hold.
PARTITION_BYTES = 128 << 20
_FOUND = "qid bigint, id bigint, distance double"
CLASSES = {c.__name__: c for c in (*R.ROUTERS.values(), R.KMeansParams, C.Raw, C.BFloat16, C.SQ8, C.PQ, C.Binary, C.RaBitQ, C.TurboQuant)}


def sample(frame: DataFrame, n: int, seed: int, total: int | None = None) -> np.ndarray:
    """At most n vectors, those with the smallest hashes of id and seed, whatever the partitions. total: the frame's rows, so that only those with hashes
    below what n rows will have are sorted."""
    key = F.xxhash64("id", F.lit(seed))
    few = frame
    if total and n < total:
        share = (n + 8 * n**0.5 + 64) / total
        few = frame.where(key < int(-(1 << 63) + share * (1 << 64))) if share < 1 else frame
    rows = few.orderBy(key, "id").limit(n).select("vec").toArrow()
    if few is not frame and rows.num_rows < n:
        return sample(frame, n, seed)
    return np.asarray(matrix(rows.column("vec")), np.float64)


def as_vectors(frame: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = frame.schema[vec_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        raise TypeError(f"{vec_col} must be an array of float or double, not {kind.simpleString()}")
    return frame.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").alias("vec"))


class CellIndex:
    def __init__(self, kind, metric, router, codec, rows, vectors, sizes, n, dim, element="float", defaults=None):
        self.kind, self.metric, self.router, self.codec = kind, metric, router, codec
        self.rows, self.vectors, self.sizes, self.n, self.dim, self.element = rows, vectors, sizes, n, dim, element
        self.defaults = defaults or {}
        self.store = vectors  # what re-ranking reads

    @property
    def distance_kind(self) -> str:
        return self.codec.distance_kind

    @classmethod
    def build(cls, base: DataFrame, kind: str, metric: str = "euclidean", router=None, codec=None, id_col: str = "id", vec_col: str = "vec", seed: int = 42, defaults: dict | None = None) -> CellIndex:
        spark, metric = base.sparkSession, parse_metric(metric)
        vectors = as_vectors(base, id_col, vec_col)
        element = vectors.schema["vec"].dataType.elementType.simpleString()
        router, codec = router or R.OneCell(), codec or C.Raw(metric, "<f8" if element == "double" else "<f4")
        n = vectors.count()
        size = router.sample_size(n, router.lists(n)) if isinstance(router, R.Centroids) else min(n, 50_000)
        if not n:
            raise ValueError("no vectors to index")
        few = sample(vectors, max(size, min(n, 50_000) if not isinstance(codec, C.Raw) else 1), seed, n)
        dim = few.shape[1]
        router.fit(few[: max(size, 1)], n, metric, seed)
        if isinstance(codec, C.SQ8):
            codec.fit_maxima(maxima(vectors, codec))
        else:
            x = codec.ready(few) if isinstance(codec, C.PQ) else few
            if codec.residual and isinstance(codec, C.PQ) and isinstance(router, R.Centroids):
                own = router.assign(few)[1][: len(few)]
                x = x - cell_centre(router, codec, own)
            codec.fit(x, seed)

        def encode(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), np.asarray(matrix(b.column(1), dim), np.float64)
                row, cell, primary = router.assign(x)
                home = np.empty(len(x), np.int64)
                home[row[primary]] = cell[primary]
                if codec.residual:
                    order = np.argsort(cell, kind="stable")
                    code = None
                    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                        own = codec.encode(x[row[part]], cell_centre(router, codec, cell[part[0]]))
                        code = np.empty((len(row), own.shape[1]), np.uint8) if code is None else code
                        code[part] = own
                else:
                    code = codec.encode(x)[row]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home[row]), pa.array(ids[row]), binaries(code)], names=["cell", "home", "id", "code"])

        rows = vectors.mapInArrow(encode, "cell bigint, home bigint, id bigint, code binary")
        width = 32 + len(codec.encode(few[:1], cell_centre(router, codec, 0))[0])
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * router.copies * width // PARTITION_BYTES))
        if router.cells > 1:
            largest = np.unique(router.assign(few[:20_000])[1], return_counts=True)[1].max() / min(len(few), 20_000) * n
            salts = max(1, min(64, int(largest // (4 * CELL_ROWS))))  # so that one large cell is several partitions
            rows = rows.repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("cell")
        rows = materialise(rows)
        sizes = {r[0]: r[1] for r in rows.where("cell = home").groupBy("cell").count().collect()} if router.copies <= 2 else {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}
        return cls(kind, metric, router, codec, rows, vectors, sizes, n, dim, element, defaults)

    # search

    def query(self, queries: DataFrame, k: int = 15, id_col: str = "id", vec_col: str = "vec", rerank: bool | None = None, rerank_factor: int = 20, return_dist: bool = True, **params) -> DataFrame:
        """(qid, rk, id, distance): the k nearest found for each query row. rerank: k * rerank_factor candidates are scored again by their vectors."""
        if k < 1:
            raise ValueError("k must be 1 or more")
        params = self.defaults | params
        rerank = params.pop("rerank", False) if rerank is None else rerank
        if unknown := params.keys() - {"plan", *self.router.SEARCH}:
            raise TypeError(f"unknown search parameters: {', '.join(sorted(unknown))}")
        q = as_vectors(queries, id_col, vec_col)
        want = min(k * (rerank_factor if rerank else 1), self.n)
        if rerank and want == self.n:  # codes can't leave a row out that is met, so its vector decides at once and no pairs are written
            out = self.uncoded().candidates(q, k, params, want)
            out = top_k(out, k, self.router.copies > 1)
            return out if return_dist else out.drop("distance")
        if rerank and (self.router.cells == 1 or not (self.codec.residual and self.router.copies > 1) and self.router.everywhere(self.n, **{x: y for x, y in params.items() if x != "plan"})):
            out = top_k(self.rescored(q, k, want), k)
            return out if return_dist else out.drop("distance")
        found = self.candidates(q, want, params)
        if rerank:
            pairs = top_k(found, want, self.router.copies > 1).select("qid", "id")
            pairs = pairs.join(self.store, "id").join(q.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), "qid")
            found = pairs.select("qid", "id", distance(self.metric)("qvec", "vec").alias("distance"))
        out = top_k(found, k, self.router.copies > 1)
        return out if return_dist else out.drop("distance")

    def wider(self, k: int, params: dict) -> dict:
        """Search parameters of twice the width: cells or rows that are met, and candidates that are scored again; the same ones where everything is."""
        out, full = dict(params), self.defaults | params
        if full.get("rerank"):
            out["rerank_factor"] = min(2 * full.get("rerank_factor", 20), -(-self.n // k))
        return out | self.router.wider(k, self.n, full)

    def self_knn(self, k: int = 15, **params) -> DataFrame:
        """The k nearest of every indexed row, itself included. Methods that can rebuild a row from its code ask with the rebuilt row; estimates without that are re-ranked by the vectors."""
        if isinstance(self.codec, C.RaBitQ | C.TurboQuant):
            params.setdefault("rerank", True)
        if isinstance(self.codec, C.SQ8 | C.PQ | C.BFloat16) and not params.get("rerank"):
            return self.query(self.rebuilt(), k, **params)
        return self.query(self.vectors, k, **params)

    def rebuilt(self) -> DataFrame:
        """(id, vec) from the first copy's codes."""
        router, codec = self.router, self.codec

        def decode(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                cell, codes = b.column(0).to_numpy(), matrix(b.column(2))
                out = np.empty((len(cell), 0))
                for own in np.unique(cell):
                    part = np.flatnonzero(cell == own)
                    x = codec.decode(codes[part], cell_centre(router, codec, own))
                    out = np.empty((len(cell), x.shape[1])) if not out.size else out
                    out[part] = x
                yield pa.RecordBatch.from_arrays([b.column(1), lists(out, pa.float64())], names=["id", "vec"])

        return self.rows.where("cell = home").select("cell", "id", "code").mapInArrow(decode, "id bigint, vec array<double>")

    def uncoded(self) -> CellIndex:
        """The same cells, with the vectors of the store in place of codes."""
        element, dim = self.store.schema["vec"].dataType.elementType.simpleString(), self.dim
        codec = C.Raw(self.metric, "<f8" if element == "double" else "<f4")

        def encode(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], binaries(codec.encode(matrix(b.column(3), dim)))], names=["cell", "home", "id", "code"])

        rows = self.rows.select("cell", "home", "id").join(self.store.select("id", "vec"), "id").select("cell", "home", "id", "vec")
        rows = materialise(rows.mapInArrow(encode, "cell bigint, home bigint, id bigint, code binary"))
        return CellIndex(self.kind, self.metric, self.router, codec, rows, self.vectors, self.sizes, self.n, dim, element)

    def one_cell(self) -> CellIndex:
        """Each row once, in one cell: what queries that look at every cell meet, without lists of cells."""
        zero = F.lit(0).cast("bigint")
        rows = self.rows.where("cell = home").select(zero.alias("cell"), zero.alias("home"), "id", "code")
        return CellIndex(self.kind, self.metric, R.OneCell(), self.codec, rows, self.vectors, {0: self.n}, self.n, self.dim, self.element)

    def rescored(self, q: DataFrame, k: int, want: int) -> DataFrame:
        """(qid, id, distance): of the ``want`` nearest of all rows by codes, the k nearest by vectors. A task has a block of queries and holds ``want`` candidates for each while rows pass, those with codes of residuals cell by cell."""
        spark, codec, metric, dim = q.sparkSession, self.codec, self.metric, self.dim
        element, router = self.store.schema["vec"].dataType.elementType.simpleString(), self.router
        raw = C.Raw(metric, "<f8" if element == "double" else "<f4")
        count, cores = q.count(), max(1, spark.sparkContext.defaultParallelism)
        blocks = max(-(-count * want // HELD), min(cores, -(-count // 64)), 1)
        blocks = -(-blocks // cores) * cores if blocks > cores else blocks

        def rows_of(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], binaries(raw.encode(matrix(b.column(3), dim)))], names=["cell", "id", "code", "vec"])

        def queries_of(batches):
            for b in batches:
                if b.num_rows:
                    x = np.ascontiguousarray(matrix(b.column(1), dim), "<f8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), b.column(0), binaries(np.zeros((len(x), 1), np.uint8)), binaries(x.view(np.uint8).reshape(len(x), -1))], names=["cell", "id", "code", "vec"])

        layout = "cell bigint, id bigint, code binary, vec binary"
        cell = F.col("cell") if codec.residual else F.lit(0).cast("bigint").alias("cell")
        once = self.rows.where("cell = home").select(cell, "id", "code").join(self.store.select("id", "vec"), "id").select("cell", "id", "code", "vec")
        rows = materialise(once.mapInArrow(rows_of, layout))
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        asked = q.mapInArrow(queries_of, layout).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "cell", "id", "code", "vec")
        both = asked.unionAll(rows.select(every.alias("block"), F.lit(1).alias("side"), "cell", "id", "code", "vec"))
        both = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("side", "cell").select("side", "cell", "id", "code", "vec")  # a block's queries come first

        def search(batches):
            ids, x, q, held, waiting, fresh = [], [], None, None, [], 0

            def asked_for():
                n = sum(map(len, ids))
                return np.concatenate(ids) if n else np.zeros(0, np.int64), np.concatenate(x) if n else np.zeros((0, dim))

            def squeezed():
                """Keeps ``want`` candidates a query, and scores those again that are new among them."""
                parts = [held, *((r, i, v, np.full(len(r), np.nan), p) for _, r, i, v, p in waiting)]
                r, i, v, far, place = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((i, v, r))
                order = order[np.arange(len(order)) - np.searchsorted(r[order], r[order], "left") < want]
                r, i, v, far, place = (c[order] for c in (r, i, v, far, place))
                if waiting:
                    vecs, new = np.concatenate([w[0] for w in waiting]), np.flatnonzero(np.isnan(far))
                    for a in range(0, len(new), 65_536):
                        own = new[a : a + 65_536]
                        far[own] = raw.exact(q[r[own]], vecs[place[own]])
                ends = np.searchsorted(r, np.arange(len(q) + 1))
                full = np.flatnonzero(np.diff(ends) == want)
                bound[full] = np.minimum(bound[full], v[ends[full + 1] - 1])
                return r, i, v, far, place

            for side, cell, own, codes, vecs in sides_of(batches):
                if not side:
                    ids.append(own)
                    x.append(np.ascontiguousarray(vecs).view("<f8").reshape(len(own), -1))
                    continue
                if q is None:
                    qid, q = asked_for()
                    bound, every = np.full(len(q), np.inf), np.arange(len(q))
                    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64, np.int64))
                if not len(q):
                    return
                before, order = sum(len(w[0]) for w in waiting), np.argsort(own, kind="stable")
                found = list(scored(codec, cell_centre(router, codec, cell), q, own, codes, want, None, cell, bound, every, None, True))
                r, i, v = (np.concatenate(c) for c in zip(*found))
                waiting.append((vecs, r, i, v, before + order[np.searchsorted(own[order], i)]))
                fresh += len(r)
                if fresh > max(len(held[0]), HELD) or before > 8 * SCAN_ROWS:
                    held, waiting, fresh = squeezed(), [], 0
            if q is not None:
                r, i, _, far, _ = squeezed()
                r, i, far = merge_top(r, i, far, k)
                for a in range(0, len(r), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in (qid[r], i, far)], names=["qid", "id", "distance"])

        return both.mapInArrow(search, _FOUND)

    def candidates(self, q: DataFrame, k: int, params: dict, look: int | None = None) -> DataFrame:
        """look: rows that the cells looked at hold at least, k where None."""
        look = look or k
        if self.router.cells > 1 and not self.codec.residual and self.router.everywhere(self.n, **{x: y for x, y in params.items() if x != "plan"}):
            return self.one_cell().candidates(q, k, {x: y for x, y in params.items() if x == "plan"})
        count = q.count()
        plan = params.pop("plan", None) or ("broadcast" if count * (8 * self.dim + 16 * self.expected_cells(params)) <= BROADCAST_BYTES else "cogroup")
        spark, dim = q.sparkSession, self.dim
        router, sizes = self.router, q.sparkSession.sparkContext.broadcast(self.size_table())  # at most a number for each cell

        def probes(batches):
            for b in batches:
                if b.num_rows:
                    ids, x = b.column(0).to_numpy(), np.asarray(matrix(b.column(1), dim), np.float64)
                    row, cell = router.probe(x, look, sizes.value, **params)
                    order = np.argsort(row, kind="stable")
                    ends = np.searchsorted(row[order], np.arange(len(x) + 1))
                    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell[order], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), lists(x, pa.float64()), listed], names=["qid", "vec", "cells"])

        asked = q.mapInArrow(probes, "qid bigint, vec array<double>, cells array<bigint>")
        if plan == "cogroup":
            return self.met(materialise(asked), k)
        table = q.repartition(max(1, min(spark.sparkContext.defaultParallelism, count // 64))).mapInArrow(probes, "qid bigint, vec array<double>, cells array<bigint>").toArrow()
        return self.scanned(spark, table, k)

    def expected_cells(self, params: dict) -> int:
        if isinstance(self.router, R.Centroids):
            return params.get("nprobe") or int(self.router.cells**0.5) + 1
        return 1 if self.router.cells == 1 else 64 * self.router.copies

    def size_table(self):
        """Rows of each cell: an array by cell, or for hashes and trees the cells that have rows and their numbers."""
        if isinstance(self.router, R.Centroids):
            return np.array([self.sizes.get(c, 0) for c in range(self.router.cells)])
        cells = np.array(sorted(self.sizes), np.int64)
        return cells, np.array([self.sizes[c] for c in cells.tolist()], np.int64)

    def scanned(self, spark, table, k: int) -> DataFrame:
        """Rows scanned where they lie, for queries that fit a broadcast."""
        if not table.num_rows:
            return spark.createDataFrame([], _FOUND)
        qid, q = table.column("qid").to_numpy(), np.asarray(matrix(table.column("vec")))
        cells = table.column("cells").combine_chunks()
        flat = cells.flatten().to_numpy()
        who = np.repeat(np.arange(len(qid)), cells.value_lengths().to_numpy())
        order = np.lexsort((who, flat))
        looked, start = np.unique(flat[order], return_index=True)
        asked = spark.sparkContext.broadcast((qid, q, who[order], looked, np.r_[start, len(flat)]))
        rows = self.rows
        if self.router.cells > 1 and len(looked) <= PUSHED_CELLS and len(looked) < len(self.sizes):
            rows = rows.where(F.col("cell").isin(looked.tolist()))
        router, codec, copies, total = self.router, self.codec, self.router.copies, self.router.cells
        spilled = isinstance(router, R.Spilled)

        def scan(batches):
            qid, q, who, looked, start = asked.value
            bound, met, held, fresh = np.full(len(q), np.inf), ([], [], []), 0, 0
            best = np.full((len(q), k), np.inf, np.float32) if total > 1 and len(q) * k <= 50_000_000 else None
            keys = np.sort(who * total + np.repeat(looked, np.diff(start))) if spilled else None

            def squeezed():
                """Keeps k a query of what was met, and learns from full lists what the k-th distance can't exceed."""
                rows, ids, value = merge_top(*(np.concatenate(x) for x in met), k, copies > 1)
                ends = np.searchsorted(rows, np.arange(len(q) + 1))
                full = np.flatnonzero(np.diff(ends) == k)
                bound[full] = np.minimum(bound[full], value[ends[full + 1] - 1])
                return rows, ids, value

            for cell, home, ids, codes in cells_of(batches):
                at = int(np.searchsorted(looked, cell))
                if at == len(looked) or looked[at] != cell:
                    continue
                mine = who[start[at] : start[at + 1]]
                hidden = (home, mine * total, keys) if spilled and (home != cell).any() else None
                # a copy of a row in another cell would count twice for a bound
                nearest = best if copies == 1 else None
                for r, i, v in scored(codec, cell_centre(router, codec, cell), q[mine], ids, codes, k, hidden, cell, bound, mine, nearest, copies == 1):
                    for x, y in zip(met, (mine[r], i, v)):
                        x.append(y)
                    fresh += len(v)
                if fresh > max(held, GATHERED if best is not None else 20 * len(q)):
                    kept = squeezed()
                    met, held, fresh = tuple([x] for x in kept), len(kept[0]), 0
            if held + fresh:
                who_found, ids, value = squeezed()
                for i in range(0, len(ids), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[who_found[i : i + 50_000]], pa.int64()), pa.array(ids[i : i + 50_000], pa.int64()), pa.array(value[i : i + 50_000], pa.float64())], names=["qid", "id", "distance"])

        return rows.mapInArrow(scan, _FOUND)

    def met(self, asked: DataFrame, k: int) -> DataFrame:
        """Written queries and rows met by cell, in blocks of bounded size on either side. Lists of cells travel with queries of spilled files only."""
        spark, spilled = asked.sparkSession, isinstance(self.router, R.Spilled)
        stored = {r[0]: r[1] for r in self.rows.groupBy("cell").count().where(F.col("count") > CELL_ROWS).collect()}  # fewer than rows / CELL_ROWS cells
        looks = asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().where(F.col("count") > QUERY_BLOCK)
        looked = {r[0]: r[1] for r in looks.collect()}  # fewer than looks / QUERY_BLOCK cells
        hot = spark.createDataFrame([(c, -(-stored.get(c, 1) // CELL_ROWS), -(-looked.get(c, 1) // QUERY_BLOCK)) for c in sorted({*stored, *looked})], "cell bigint, salts bigint, turns bigint")
        salts, turns = F.coalesce(F.col("salts"), F.lit(1)), F.coalesce(F.col("turns"), F.lit(1))
        listed = F.col("cells") if spilled else F.lit(None).cast("array<bigint>")
        queries = asked.select("qid", "vec", listed.alias("cells"), F.explode("cells").alias("cell")).join(F.broadcast(hot), "cell", "left")
        queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).withColumn("turn", F.pmod(F.xxhash64("qid"), turns))
        rows = self.rows.join(F.broadcast(hot), "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts))
        rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), turns - 1)))
        router, codec = self.router, self.codec

        def score(left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            qid, q = left.column("qid").to_numpy(), np.asarray(matrix(left.column("vec")))
            cell, home, ids, codes = right.column("cell")[0].as_py(), right.column("home").to_numpy(), right.column("id").to_numpy(), matrix(right.column("code"))
            hidden = None
            if spilled and (home != cell).any():
                listed = left.column("cells").combine_chunks()
                n = np.arange(len(qid)) * router.cells
                hidden = home, n, np.sort(np.repeat(n, listed.value_lengths().to_numpy()) + listed.flatten().to_numpy())
            out = [(qid[r], i, v) for r, i, v in scored(codec, cell_centre(router, codec, cell), q, ids, codes, k, hidden, cell)]
            a, b, c = (np.concatenate(x) for x in zip(*out))
            return pa.table({"qid": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "distance": pa.array(c, pa.float64())})

        keys = ["cell", "salt", "turn"]
        left = queries.select("qid", "vec", "cells", *keys)
        return left.groupBy(*keys).cogroup(rows.select("home", "id", "code", *keys).groupBy(*keys)).applyInArrow(score, _FOUND)

    # storage

    def save_store(self, path: str) -> None:
        """Writes the vectors that re-ranking reads to a place of their own."""
        persist.save(self.rows.sparkSession, path, "store", self.element, persist.freeze({"n": self.n, "dim": self.dim}, {}), {"store": self.vectors})

    def with_store(self, path: str) -> CellIndex:
        """This index, re-ranking by the vectors of a saved store; it must hold as many of the same dimension."""
        spark = self.rows.sparkSession
        _, _, raw, parts = persist.load(spark, path, "store", self.element)
        state = persist.thaw(raw, {})
        if (state["n"], state["dim"]) != (self.n, self.dim):
            raise persist.TruncatedError(f"the store holds {state['n']} vectors of {state['dim']} dimensions, the index {self.n} of {self.dim}")
        self.store = parts["store"]
        return self

    def save(self, path: str) -> None:
        state = {"metric": self.metric, "router": self.router, "codec": self.codec, "sizes": self.sizes, "n": self.n, "dim": self.dim, "defaults": self.defaults}
        parts = {"rows": self.rows if self.router.cells == 1 else self.rows.sortWithinPartitions("cell"), "vectors": self.vectors}
        persist.save(self.rows.sparkSession, path, self.kind, self.element, persist.freeze(state, CLASSES), parts)

    @classmethod
    def load(cls, spark, path: str, kind: str | None = None, element: str | None = None) -> CellIndex:
        kind, element, raw, parts = persist.load(spark, path, kind, element)
        s = persist.thaw(raw, CLASSES)
        return cls(kind, s["metric"], s["router"], s["codec"], parts["rows"], parts["vectors"], s["sizes"], s["n"], s["dim"], element, s["defaults"])


def maxima(vectors: DataFrame, codec) -> np.ndarray:
    """max(abs) of each dimension over all rows: a partial row from each task, then their maximum."""

    def part(batches):
        most = None
        for b in batches:
            if b.num_rows:
                own = np.abs(codec.ready(matrix(b.column(0)))).max(0)
                most = own if most is None else np.maximum(most, own)
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most)], names=["place", "most"])

    found = vectors.select("vec").mapInArrow(part, "place bigint, most double").groupBy("place").agg(F.max("most").alias("most"))
    return np.array([r[0] for r in found.orderBy("place").select("most").collect()])


def cell_centre(router, codec, cell):
    """The centroid that residuals of a cell are taken to; None where nothing is subtracted."""
    if not codec.residual or not isinstance(router, R.Centroids):
        return None
    return C.unit(router.table)[cell] if router.metric == "cosine" else router.table[cell]


def cells_of(batches):
    """(cell, home, ids, codes) of runs of rows of one cell, across batches, up to about SCAN_ROWS rows at a time."""
    held, rows = [], 0

    def whole():
        homes, ids, codes = zip(*(x[1:] for x in held))
        return held[0][0], np.concatenate(homes), np.concatenate(ids), np.concatenate(codes)

    for b in batches:
        if not b.num_rows:
            continue
        cell, home, ids = (b.column(i).to_numpy() for i in range(3))
        codes = matrix(b.column(3))
        order = np.argsort(cell, kind="stable") if (cell[1:] < cell[:-1]).any() else np.arange(len(cell))
        ends = np.flatnonzero(np.diff(cell[order])) + 1
        for first, last in zip([0, *ends], [*ends, len(order)]):
            for i in range(first, last, SCAN_ROWS):
                part = order[i : min(i + SCAN_ROWS, last)]
                own = int(cell[part[0]])
                if held and (held[0][0] != own or rows + len(part) > SCAN_ROWS):
                    yield whole()
                    held, rows = [], 0
                held.append((own, home[part], ids[part], codes[part]))
                rows += len(part)
    if held:
        yield whole()


def sides_of(batches):
    """(side, cell, ids, codes, vectors) of runs of rows of one side and cell, across batches, up to SCAN_ROWS rows at a time; they come by side and then cell."""
    held, rows = [], 0

    def whole():
        return *held[0][0], *(np.concatenate(x) for x in zip(*(x[1:] for x in held)))

    for b in batches:
        side, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
        ends = np.flatnonzero((np.diff(side) != 0) | (np.diff(cell) != 0)) + 1
        for first, last in zip([0, *ends], [*ends, len(side)]):
            for i in range(first, last, SCAN_ROWS):
                part = b.slice(i, min(SCAN_ROWS, last - i))
                own = int(side[i]), int(cell[i])
                if held and (held[0][0] != own or rows + part.num_rows > SCAN_ROWS):
                    yield whole()
                    held, rows = [], 0
                held.append((own, part.column(2).to_numpy(), matrix(part.column(3)), matrix(part.column(4))))
                rows += part.num_rows
    if held:
        yield whole()


def scored(codec, centre, q, ids, codes, k, hidden=None, cell=None, bound=None, mine=None, best=None, single=False):
    """(row of q, id, score) of the k nearest in a block of codes; with ``bound`` those that may be among them, in any order.

    hidden: (first cells of the rows, each query's number times the cells, sorted sums of that and a cell looked at); second copies are left out for queries that look at the first.
    bound: what each query's k-th distance doesn't exceed, by its number in ``mine``, which is kept up to date if rows have a ``single`` copy; best: its k smallest distances so far (an upper bound each), which are kept up to date with it.
    """
    step = max(1, BLOCK_CELLS // max(1, len(codes)))
    quick = hasattr(codec, "partial")
    for i in range(0, len(q), step):
        part, offset, room = q[i : i + step], None, None
        if quick:
            dist, offset, room = codec.partial(part, codes, centre)
        else:
            dist = codec.score(part, codes, centre)
        if hidden is not None:
            home, number, keys = hidden
            firsts, which = np.unique(home, return_inverse=True)
            want = number[i : i + step, None] + firsts[None]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            seen = (keys[at] == want) & (firsts != cell)[None]
            dist = np.where(seen[:, which], np.inf, dist)
        exact = (lambda r, c, part=part: codec.exact(part[r], codes[c], centre)) if quick else None
        limit, own = None, None
        if bound is not None:
            own = mine[i : i + step]
            if best is not None:
                low = np.partition(dist, k - 1, axis=1)[:, :k] if dist.shape[1] > k else dist
                low = (low + ((0 if offset is None else offset[:, None]) + (room or 0))).astype(np.float32)
                kept = np.partition(np.concatenate([best[own], low], 1), k - 1, axis=1)[:, :k]
                best[own] = kept
                # 32-bit rounding may have gone down
                bound[own] = np.minimum(bound[own], kept[:, k - 1] + 2e-7 * np.abs(kept[:, k - 1]))
            limit = bound[own] - (0 if offset is None else offset)
            r, found, value, last = near(dist, ids, k, exact, limit, room)
            if best is None and hidden is None and single:
                bound[own] = np.minimum(bound[own], last + (0 if offset is None else offset))
            yield r + i, found, value
            continue
        r, found, value = top(dist, ids, k, exact, limit, room)
        yield r + i, found, value
