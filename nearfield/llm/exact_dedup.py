"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its rows into a sorted run of (digest, smallest member,
count). Runs are merged in rounds of a binomial tree with a fan-in of
``FAN_IN``: in a round, the cells of ``FAN_IN`` neighbouring nodes exchange
runs so that each receives one slice of the digests from all of them, merges
those runs and keeps the smallest member of every digest. After the last round
each cell owns one slice of all digests. As nodes grow, slices shrink by the
same factor, so a cell holds the same share at every level and no task ever
gathers more than that; a digest of a third of all rows is one entry of each
run. Each merge verifies that its runs are sorted, that no member is lost, and
that the kept one is the smallest.

The way back is by runs as well: a digest's entry knows which runs it came
from, and rows are joined on (run, digest), which spreads a hot digest over as
many keys as there are runs.

Texts are equal when identical after every run of the six ASCII white-space
characters became one space. Digests are SHA-256.

Defined results: null text counts as empty; of equal texts the smallest id
stays, null ids come last; among equal rows with equal ids one stays, the first
in the order of the table's files; very long texts are hashed whole; an empty table gives an empty table; extra
columns aren't read (``drop_duplicates`` returns them as they were, whatever their names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name

FAN_IN = 8
#: Entries that a cell should hold at most; the tree gets as many cells as that takes.
CELL_ENTRIES = 400_000
_ROW_BITS = 33

#: Odd steps between the leaves that blocks of one partition are dealt to.
_LEAF_STEP = 7919


def run_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in (("sender", T.LongType()), ("digest", T.BinaryType()), ("absent", T.BooleanType()), ("id", id_type), ("row", T.LongType()), ("size", T.LongType()), ("runs", T.ArrayType(T.IntegerType())))])


def comparable(ids: pa.Array) -> np.ndarray:
    """Integers in the order of the ids; absent ones are zero."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.unique(np.array(["" if x is None else x for x in ids.to_pylist()], object), return_inverse=True)[1].astype(np.int64)


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def tree_shape(cells: int, fan_in: int = FAN_IN) -> list[int]:
    """Fan-ins of the rounds, powers of two whose product is at least ``cells``."""
    bits, most = max(0, (cells - 1).bit_length()), fan_in.bit_length() - 1
    return [1 << min(most, bits - done) for done in range(0, bits, most)]


def merge_runs(words: np.ndarray, absent: np.ndarray, ids: np.ndarray, rows: np.ndarray, senders: np.ndarray | None = None):
    """Multiway merge of runs that stand one after another; the stable sort finds them as they are and merges them.

    words: each digest as four unsigned integers; absent, ids, rows: what members are compared by, in this order;
    senders: whose run an entry belongs to, None where the entries are not sorted yet.
    Returns the merged order and where in it each digest begins, its smallest member first.
    """
    head = words[:, 0]
    if senders is not None and (head[1:] < head[:-1])[senders[1:] == senders[:-1]].any():
        raise ValueError("a run isn't sorted")
    order = np.argsort(head, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(1)
    if (new[1:] & (head[order][1:] == head[order][:-1])).any():  # digests that share their first 64 bits
        order = np.lexsort(words.T[::-1])
        new[1:] = (words[order][1:] != words[order][:-1]).any(1)
    group = np.cumsum(new)
    order = order[np.lexsort((rows[order], ids[order], absent[order], group))]
    first = np.flatnonzero(new)
    if len(first) and not (np.minimum.reduceat(np.where(absent, np.iinfo(np.int64).max, ids)[order], first) == np.where(absent, np.iinfo(np.int64).max, ids)[order][first]).all():
        raise ValueError("a kept id isn't the smallest of its digest")
    return order, first


def merged(table: pa.Table, sender: int, is_sorted: bool) -> pa.RecordBatch:
    """One sorted run from the entries of several."""
    col = {c: table.column(c).combine_chunks() for c in table.column_names}
    raw = b"".join(col["digest"].to_pylist())
    words = np.frombuffer(raw, ">u8").reshape(-1, 4).astype(np.uint64)
    ids = comparable(col["id"])
    absent, rows, size = (col[c].to_numpy(zero_copy_only=False) for c in ("absent", "row", "size"))
    order, first = merge_runs(words, absent, ids, rows, col["sender"].to_numpy() if is_sorted else None)
    total = np.add.reduceat(size[order], first)
    if total.sum() != size.sum():
        raise ValueError("members were lost in a merge")
    group = np.zeros(len(order), np.int64)
    group[first[1:]] = 1
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(group)
    lists = col["runs"]
    pairs = np.unique(np.repeat(place, lists.value_lengths().to_numpy()) << 32 | lists.flatten().to_numpy())
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs >> 32, np.arange(len(first) + 1)), pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()))
    keep = pa.array(order[first])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), sender), pa.int64()), col["digest"].take(keep), col["absent"].take(keep), col["id"].take(keep), col["row"].take(keep), pa.array(total), runs], names=table.column_names)


def sorted_runs(batches):
    """The first level: blocks of single rows become runs."""
    part = TaskContext.get().partitionId()
    held, size, block = [], 0, 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CELL_ENTRIES:
            yield merged(pa.Table.from_batches(held), part << 20 | block, False)
            held, size, block = [], 0, block + 1
    if size:
        yield merged(pa.Table.from_batches(held), part << 20 | block, False)


def merge_cell(batches):
    """A round of the tree in one cell."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield merged(pa.Table.from_batches(held), TaskContext.get().partitionId() << 20, True)


def digest_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest): one row per document, written. row holds the partition's number above ``_ROW_BITS`` bits."""
    return docs.select(F.monotonically_increasing_id().alias("row"), whole_id(docs, id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest"))


def whole_id(docs: DataFrame, id_col: str):
    """The id as a long if it is a whole number, else as a string."""
    kind = docs.schema[id_col].dataType
    return F.col(f"`{id_col}`").cast("bigint" if isinstance(kind, T.IntegralType) else "string")


def merge_tree(table: DataFrame) -> DataFrame:
    """One RUN row per digest of a (row, id, digest) table."""
    spark = table.sparkSession
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // CELL_ENTRIES))
    rounds = tree_shape(cells)
    cells = int(np.prod(rounds))
    run, schema = F.shiftright("row", _ROW_BITS).cast("int"), run_schema(table.schema["id"].dataType)
    level = table.select(F.lit(0).cast("bigint").alias("sender"), "digest", F.col("id").isNull().alias("absent"), "id", "row", F.lit(1).cast("bigint").alias("size"), F.array(run).alias("runs")).mapInArrow(sorted_runs, schema)
    slices = 1
    for fan_in in rounds:
        # a cell's number is node * slices + slice; the first runs' nodes are leaves, of which a partition's first block takes its own and others take those farther on
        leaf = F.shiftright("sender", 20) + F.col("sender").bitwiseAND((1 << 20) - 1) * F.lit(_LEAF_STEP)
        node = F.floor(F.pmod(leaf, F.lit(cells)) / F.lit(slices * fan_in))
        slices *= fan_in
        part = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint"), 32 - (slices.bit_length() - 1))
        level = level.repartitionById(cells, (node * F.lit(slices) + part).cast("int")).mapInArrow(merge_cell, schema)
    return level


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and row, which tells equal rows apart. Whole-number ids are longs, others strings."""
    return resolve(cut(digest_table(docs, id_col, text_col)), id_col)


def resolve(table: DataFrame, id_col: str) -> DataFrame:
    groups = merge_tree(table).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"), F.explode("runs").alias("run"))
    rows = table.select("*", F.shiftright("row", _ROW_BITS).cast("int").alias("run"))
    found = rows.join(groups, ["run", "digest"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns. Documents are written once with a row number, which decisions are joined by."""
    row = free_name(docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    table = cut(numbered.select(F.col(row).alias("row"), whole_id(docs, id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("digest")))
    stay = resolve(table, id_col).where("kept").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").drop(row)
