"""Scalar functions over array columns, built from Spark expressions only; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = {"euclidean": "euclidean", "l2": "euclidean", "squared_euclidean": "euclidean", "cosine": "cosine", "manhattan": "manhattan", "l1": "manhattan"}


def parse_metric(name: str, strict: bool = True) -> str:
    """The metric's name in one spelling. Unknown names raise, or mean squared Euclidean if not strict."""
    found = METRICS.get(str(name).strip().lower())
    if found is None and strict:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return found or "euclidean"


def _col(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def squared_euclidean(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def dot(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def manhattan(a, b) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def canberra(a, b) -> Column:
    """Sum of |x - y| / (|x| + |y|); places where both are zero count nothing."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: F.when(F.abs(x) + F.abs(y) == 0, 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))


def subtract(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def add(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def l2_norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x * x)))


def l1_norm(a) -> Column:
    return _sum(F.transform(_col(a), F.abs))


def normalise(a) -> Column:
    """Divided by the norm; a zero vector stays as it is."""
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(_col(a), lambda x: x / norm)).otherwise(_col(a))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1 if a norm is zero."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(1.0)


def hamming(a, b) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v).cast("bigint")


def distance(metric: str):
    return {"euclidean": squared_euclidean, "cosine": cosine_distance, "manhattan": manhattan, "canberra": canberra}[metric]


def validate_vectors(frame: DataFrame, vec_col: str, dim: int | None = None) -> DataFrame:
    """The frame, its vectors checked as rows are read: wrong types raise at once; null vectors, null or NaN elements and other lengths as they are met."""
    kind = frame.schema[vec_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        raise TypeError(f"{vec_col} must be an array of float or double, not {kind.simpleString()}")
    v = F.col(f"`{vec_col}`")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x))
    if dim is not None:
        bad = bad | (F.size(v) != dim)
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"{vec_col}: a vector is null, has a null or NaN element, or hasn't the dimension {dim or ''}")).cast(kind)).otherwise(v)
    return frame.withColumn(vec_col, checked)
