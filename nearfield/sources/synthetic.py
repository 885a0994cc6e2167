"""Seeded synthetic vector families, made on the executors; a row depends on seed and id only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.blocks import lists, matrix

SCHEMA = "id bigint, vec array<float>, label int"
FAMILIES = ("gaussian", "correlated", "lowrank", "cell")


def _centres(d: int, clusters: int, seed: int):
    rng = np.random.default_rng(seed)
    weight = rng.uniform(0.5, 2.5, clusters)
    return rng.uniform(-7.5, 7.5, (clusters, d)), rng.uniform(0.5, 2.5, clusters), weight / weight.sum(), rng


def _block(family: str, ids: np.ndarray, d: int, clusters: int, seed: int):
    width = min(16, d)
    centre, spread, weight, rng = _centres(width if family == "lowrank" else d, clusters, seed)
    near = ((centre[:, None] - centre[None]) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    near = near.argmin(1)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    axes = rng.standard_normal((clusters, max(2, d // 8), d)) / np.sqrt(d)
    out, labels = np.empty((len(ids), d)), np.empty(len(ids), np.int32)
    for i, key in enumerate(ids.tolist()):
        own = np.random.default_rng((seed, key))
        c = labels[i] = own.choice(clusters, p=weight)
        tube = own.random() < {"gaussian": 0.2, "correlated": 0.0, "lowrank": 0.15, "cell": 0.25}[family]
        x = centre[c] + (own.random() * (centre[near[c]] - centre[c]) if tube else 0)
        scale = 0.3 * spread.mean() if tube else spread[c]
        if family in ("correlated", "cell"):
            x = x + own.standard_normal(axes.shape[1]) @ axes[c] * 3 * scale + 0.2 * scale * own.standard_normal(d)
        else:
            x = x + scale * own.standard_normal(len(x))
        if family == "lowrank":
            x = x @ turn[:width]
        if family == "cell":
            x = x + 4.0 * turn[0] * np.sqrt(d)
            x[:4] *= 6
            x = x / np.linalg.norm(x) * own.lognormal(0, 0.3)
        out[i] = x
    return out, labels


def vectors(spark: SparkSession, family: str, n: int, d: int = 32, clusters: int = 25, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """(id, vec, label). gaussian: clusters of own spread with tubes between; correlated: oriented ellipsoids; lowrank: 16 dimensions turned into d;
    cell: a shared cone, four outsized dimensions, and lognormal norms."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")

    def make(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            x, label = _block(family, ids, d, clusters, seed)
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists(x.astype(np.float32), pa.float32()), pa.array(label)], names=["id", "vec", "label"])

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInArrow(make, SCHEMA)


def noised_queries(base: DataFrame, sigma: float = 0.05, seed: int = 1042) -> DataFrame:
    """(id, vec): rows with Gaussian noise that depends on seed and id."""

    def make(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), np.asarray(matrix(b.column(1)), np.float64)
            noise = np.stack([np.random.default_rng((seed, i)).standard_normal(x.shape[1]) for i in ids.tolist()]) if len(ids) else np.zeros_like(x)
            yield pa.RecordBatch.from_arrays([b.column(0), lists((x + sigma * noise).astype(np.float32), pa.float32())], names=["id", "vec"])

    return base.select("id", "vec").mapInArrow(make, "id bigint, vec array<float>")
