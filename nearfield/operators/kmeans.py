"""k-means over whole tables: Lloyd's rounds whose sums are taken on the executors.

The centroids (k vectors) travel with the plan; a task sends on one row of sums
for each cell it met, and these are added up by cell before k rows reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import distances, lists, matrix
from ..functions.vectors import parse_metric
from .cells import as_vectors, sample
from .routers import Centroids, seeds


def train_centroids(base: DataFrame, k: int, metric: str = "euclidean", rounds: int = 30, id_col: str = "id", vec_col: str = "vec", seed: int = 42, tolerance: float = 1e-6) -> np.ndarray:
    """k centroids of all rows; first ones from a sample of at most 256 a centroid. Rounds go on in the direction of the last ones (Nesterov's steps, begun anew
    when the sum of squared distances grows), so that they come to rest in about half as many; what is returned are means of rows."""
    metric = parse_metric(metric)
    if metric == "manhattan":
        raise ValueError("k-means needs Euclidean or cosine distance")
    vectors = as_vectors(base, id_col, vec_col)
    few = sample(vectors, min(256 * k, 250_000), seed)
    if k > len(few):
        raise ValueError(f"{k} centroids of {len(few)} rows")
    router = Centroids(centroids=seeds(few, k, np.random.default_rng(seed)))
    router.fit(None, 0, metric, seed)
    before, least, steps = None, np.inf, 0
    for _ in range(rounds):
        table = router.table

        def part(batches, router=router, table=table):
            sums, count, spread = np.zeros_like(table), np.zeros(len(table)), np.zeros(len(table))
            for b in batches:
                if b.num_rows:
                    x = router.ready(matrix(b.column(0)))
                    far = distances("euclidean", x, table)
                    own = far.argmin(1)
                    np.add.at(sums, own, x)
                    count += np.bincount(own, minlength=len(table))
                    spread += np.bincount(own, far.min(1), minlength=len(table))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), pa.array(spread[met]), lists(sums[met], pa.float64())], names=["cell", "n", "spread", "total"])

        found = vectors.select("vec").mapInArrow(part, "cell bigint, n double, spread double, total array<double>")
        found = found.select("cell", "n", "spread", F.posexplode("total").alias("place", "x")).groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum("spread").alias("spread"), F.sum("x").alias("x"))
        rows = found.toArrow()  # k times the dimension
        new = table.copy()
        new[rows.column("cell").to_numpy(), rows.column("place").to_numpy()] = rows.column("x").to_numpy() / rows.column("n").to_numpy()
        if float(np.abs(new - table).max()) <= tolerance:
            return new
        cost = float(rows.column("spread").to_numpy()[rows.column("place").to_numpy() == 0].sum())
        if cost > least:
            before, steps = None, 0
        router.table = new if before is None else new + steps / (steps + 3) * (new - before)
        before, least, steps = new, cost, steps + 1
    return router.table if before is None else before


def assign(base: DataFrame, centroids: np.ndarray, metric: str = "euclidean", top: int = 1, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, rk, cell): the ``top`` nearest centroids of every row."""
    router = Centroids(centroids=centroids)
    router.fit(None, 0, parse_metric(metric))

    def run(batches):
        for b in batches:
            if b.num_rows:
                row, cell, rank = router.assign_top(np.asarray(matrix(b.column(1)), np.float64), top)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(rank + 1), pa.array(cell)], names=["id", "rk", "cell"])

    return as_vectors(base, id_col, vec_col).mapInArrow(run, "id bigint, rk bigint, cell bigint")
