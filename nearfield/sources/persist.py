"""Saved indices: component tables as Parquet in a new folder, and a manifest that names it and is written last. An index that is saved again replaces
the old one when its manifest does; until then the old one is whole, and an index may be saved onto the path it was loaded from."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 2


class IndexFormatError(Exception):
    """What is there isn't an index, or not one that can be read."""


class NotAnIndexError(IndexFormatError):
    pass


class VersionError(IndexFormatError):
    pass


class KindError(IndexFormatError):
    pass


class ElementTypeError(IndexFormatError):
    pass


class TruncatedError(IndexFormatError):
    pass


class TrailingError(IndexFormatError):
    pass


def freeze(value, classes: dict[str, type]) -> bytes:
    """An object of known classes, with nested lists, dicts and arrays, as bytes; nothing in them is executed when read."""
    arrays: dict[str, np.ndarray] = {}

    def put(x):
        if isinstance(x, np.ndarray):
            arrays[name := f"a{len(arrays)}"] = x
            return {"array": name}
        if isinstance(x, dict):
            return {"dict": [[put(k), put(v)] for k, v in x.items()]}
        if isinstance(x, list | tuple):
            return {"list": [put(v) for v in x], "tuple": isinstance(x, tuple)}
        if isinstance(x, np.generic):
            return put(x.item())
        if type(x).__name__ in classes:
            return {"object": type(x).__name__, "state": put(vars(x))}
        return {"value": x}

    tree, out = json.dumps(put(value)), io.BytesIO()
    np.savez_compressed(out, tree=np.frombuffer(tree.encode(), np.uint8), **arrays)
    return out.getvalue()


def thaw(raw: bytes, classes: dict[str, type]):
    data = np.load(io.BytesIO(raw), allow_pickle=False)

    def get(x):
        if "array" in x:
            return data[x["array"]]
        if "dict" in x:
            return {get(k): get(v) for k, v in x["dict"]}
        if "list" in x:
            values = [get(v) for v in x["list"]]
            return tuple(values) if x["tuple"] else values
        if "object" in x:
            out = classes[x["object"]].__new__(classes[x["object"]])
            vars(out).update(get(x["state"]))
            return out
        return x["value"]

    return get(json.loads(data["tree"].tobytes()))


def _folder(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def save(spark: SparkSession, path: str, kind: str, element: str, state: bytes, parts: dict[str, DataFrame]) -> None:
    """Writes the parts to a new folder, then the manifest with its name and their row counts, then removes what an earlier manifest named."""
    counts, home = {}, f"parts-{uuid.uuid4().hex}"
    for name, frame in parts.items():
        frame.write.parquet(f"{path}/{home}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{home}/{name}").count()
    row = (kind, FORMAT_VERSION, element, home, json.dumps(counts), bytearray(state))
    spark.createDataFrame([row], "kind string, format_version int, element string, home string, counts string, state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    for old in _children(spark, path):
        if old.startswith("parts-") and old != home:
            p, fs = _folder(spark, f"{path}/{old}")
            fs.delete(p, True)


def load(spark: SparkSession, path: str, kind: str | None = None, element: str | None = None) -> tuple[str, str, bytes, dict[str, DataFrame]]:
    """(kind, element type, state, parts). Raises what is wrong: no manifest, another version, kind or element type, parts with other row counts, parts that the manifest doesn't name."""
    try:
        row = spark.read.parquet(f"{path}/manifest").first()
    except Exception as e:
        raise NotAnIndexError(f"{path} has no manifest") from e
    if row is None or {"kind", "format_version", "element", "counts", "state"} - set(row.asDict()):
        raise NotAnIndexError(f"{path} has no whole manifest")
    if row.format_version != FORMAT_VERSION:
        raise VersionError(f"format {row.format_version}; this code reads {FORMAT_VERSION}")
    if kind is not None and row.kind != kind:
        raise KindError(f"{path} holds {row.kind}, not {kind}")
    if element is not None and row.element != element:
        raise ElementTypeError(f"{path} holds {row.element}, not {element}")
    counts, parts = json.loads(row.counts), {}
    if extra := set(_children(spark, f"{path}/{row.home}")) - counts.keys():
        raise TrailingError(f"{path}/{row.home} has parts that the manifest doesn't name: {', '.join(sorted(extra))}")
    for name, n in counts.items():
        try:
            parts[name] = spark.read.parquet(f"{path}/{row.home}/{name}")
        except Exception as e:
            raise TruncatedError(f"{path}/{row.home}/{name} is missing") from e
        if (found := parts[name].count()) != n:
            raise TruncatedError(f"{path}/{row.home}/{name} has {found} rows of {n}")
    return row.kind, row.element, bytes(row.state), parts
