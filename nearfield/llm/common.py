"""What the operators of this folder share: Arrow batches of bounded size, tables that cut lineage, spans in order."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import materialise, shared_dir

#: Rows of an Arrow batch that are Python objects at a time. Spark holds batches to spark.sql.execution.arrow.maxBytesPerBatch.
TEXT_ROWS = 512


def slices(batches):
    """The batches in pieces of at most TEXT_ROWS rows; pieces share the batch's memory."""
    for b in batches:
        for i in range(0, b.num_rows, TEXT_ROWS):
            yield b.slice(i, TEXT_ROWS)


def pass_id(frame: DataFrame, id_col: str) -> str:
    """The id column's name and type, as a DDL field."""
    return f"`{id_col}` {frame.schema[id_col].dataType.simpleString()}"


def free_name(frame: DataFrame, name: str = "row_of_input") -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def schema_of(fields: list[str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(fields))


def arrow_map(frame: DataFrame, cols: list[str], rows: Callable[[Iterable[tuple]], Iterator[tuple]], fields: list[str], out_rows: int = 4096) -> DataFrame:
    """``rows`` gets the chosen columns' values as tuples, a partition at a time, and yields result tuples; memory is a batch in, a slice of it as Python objects, and a batch out."""
    schema = schema_of(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        def values():
            for b in slices(batches):
                yield from zip(*(c.to_pylist() for c in b.columns))

        def made(chunk):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), arrow)], schema=arrow)

        chunk = []
        for row in rows(values()):
            chunk.append(row)
            if len(chunk) >= out_rows:
                yield made(chunk)
                chunk = []
        if chunk:
            yield made(chunk)

    return frame.select(*[F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)


def arrow_filter(frame: DataFrame, text_col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """Rows whose text ``keep`` accepts, with all their columns as they were."""
    place = frame.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            out = b.filter(pa.array(keep(b.column(place).to_pylist()), pa.bool_()))
            if out.num_rows:
                yield out

    return frame.mapInArrow(run, frame.schema)


class Surroundings:
    """Spans (start, kind, end) sorted by start, and how far those up to each one reach."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts, self.reach = [s for s, _, _ in base], []
        for _, _, e in base:
            self.reach.append(max(e, self.reach[-1]) if self.reach else e)

    def near(self, a: int, b: int, room: int, but: int | None = None) -> bool:
        """Whether one lies in [a - room, b + room]; ``but``: the place of one that doesn't count."""
        i = bisect_right(self.starts, b + room)
        if but is None:
            return i > 0 and self.reach[i - 1] >= a - room
        return but + 1 < i or but > 0 and self.reach[but - 1] >= a - room

    def overlap(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, b - 1)
        return i > 0 and self.reach[i - 1] > a


def cut(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: no lineage behind it, so a lost executor costs its own tasks only."""
    return materialise(frame)


def cut_at(frame: DataFrame) -> tuple[DataFrame, str]:
    """``cut``, and where the table lies, for ``drop_table``."""
    path = shared_dir(frame.sparkSession)
    return materialise(frame, path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table that ``cut`` wrote, through Spark's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
