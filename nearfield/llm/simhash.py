"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the majority, bit by bit, of the XXH64 values of
its word shingles. Documents link when fingerprints differ in at most
``THRESHOLD`` bits; the classes are the connected components.

Candidates. The 64 bits fall into blocks so that two linked fingerprints agree
but for ``t = THRESHOLD // blocks`` bits in one block at least. Each block has
a covering code as anchors: a Hamming code over its low 2^m - 1 bits, which is
perfect with covering radius R = 1, and all values of its other bits. So every
fingerprint has exactly one anchor within R, its home. It is replicated to
every anchor within R + t; then two linked fingerprints meet at the home of
either. Per anchor, those at home are compared with all that came.

Only distinct fingerprints are compared: copies, however many, are one entry.
Anchors at which very many are at home are split by a salt of those at home.
Within a batch found links are reduced to a spanning forest before they leave
the task, so a group of n near copies gives some n links and not n^2, and no
link is lost: what counts is who is reachable. Components come from
alternating large and small stars over these links, written to the shared
folder after every round.

Defined results: null text is an empty text, whose fingerprint is zero and
links like any other; of a class the smallest id is named (null ids last), and
among rows with this id the first in the order of the table's files is the one
that ``drop_near_duplicates`` keeps, with its columns whatever their names; very long texts are read whole, in pieces of
``PIECE_WORDS`` words; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, cut, cut_at, drop_table, free_name, pass_id

BITS, THRESHOLD, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints at home at one anchor above which it is split, and the most anchors that a broadcast list can split.
HOT_HOMES, HOT_ANCHORS = 4096, 50_000
#: Distinct fingerprints from which two wide blocks serve better than three.
WIDE_FROM = 200_000_000
PAIRS_AT_ONCE = 2_000_000
#: Words that are hashed together, and entries that a partition of anchors should hold.
PIECE_WORDS, PARTITION_ENTRIES = 100_000, 4_000_000
_SALT_BITS = 20

CELL = T.StructType([T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("fp", T.LongType())])
LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one whole text, as a signed integer."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    count = max(len(words) - shingle + 1, 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, count, PIECE_WORDS):
        octets = np.array(shingle_hashes(words[i : i + PIECE_WORDS + shingle - 1], shingle), "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of every run of ``shingle`` words, or of all words where there are fewer."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]


class Covering:
    """The anchors of each block and who is replicated to them."""

    def __init__(self, blocks: int, threshold: int = THRESHOLD):
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            width = high - low
            code = (1 << (width + 1).bit_length() - 1) - 1  # bits under the Hamming code
            bits = [1 << i for i in range(width)]
            syndromes = [i + 1 if i < code else 0 for i in range(width)]
            masks: dict[int, list[int]] = {}  # by syndrome, lightest first
            layer = [(0, 0, -1)]
            for _ in range(2 + threshold // blocks):
                for mask, syndrome, _last in layer:
                    masks.setdefault(syndrome, []).append(mask)
                layer = [(m | bits[i], s ^ syndromes[i], i) for m, s, last in layer for i in range(last + 1, width)]
            self.blocks.append((low, width, code, [np.array(masks.get(s, [0]), np.int64) for s in range(code + 1)]))

    def syndrome(self, x: np.ndarray, code: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for bit in range(code.bit_length()):
            mask = sum(1 << i for i in range(code) if i + 1 >> bit & 1)
            out |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << bit
        return out

    def homes(self, fps: np.ndarray) -> list[np.ndarray]:
        """The home anchor of each fingerprint in each block."""
        out = []
        for k, (low, width, code, masks) in enumerate(self.blocks):
            x = (fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & (1 << width) - 1
            nearest = np.array([m[0] for m in masks])
            out.append(self.cell(k, x ^ nearest[self.syndrome(x, code)]))
        return out

    def anchors(self, fps: np.ndarray):
        """(cells, home, fps): every fingerprint at all its anchors."""
        for k, (low, width, code, masks) in enumerate(self.blocks):
            x = (fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & (1 << width) - 1
            syndrome = self.syndrome(x, code)
            for s in np.unique(syndrome):
                own = syndrome == s
                cells = self.cell(k, x[own, None] ^ masks[s])
                home = np.zeros(cells.shape, bool)
                home[:, 0] = True
                yield cells.ravel(), home.ravel(), np.repeat(fps[own], len(masks[s]))

    @staticmethod
    def cell(block: int, anchor: np.ndarray) -> np.ndarray:
        return block << 32 + _SALT_BITS | anchor << _SALT_BITS


def salted(cells, home, fps, hot: dict[int, int]):
    """Entries of hot anchors, dealt to as many cells as ``hot`` names: those at home to one of them, and all to each as guests."""
    if not hot:
        return cells, home, fps
    keys = np.array(sorted(hot), np.int64)
    at = np.minimum(np.searchsorted(keys, cells), len(keys) - 1)
    times = np.where(keys[at] == cells, np.array([hot[k] for k in keys.tolist()])[at], 1)
    rows = np.repeat(np.arange(len(cells)), times)
    salt = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    own = (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % times
    return cells[rows] | salt, home[rows] & (own[rows] == salt), fps[rows]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given links connect, one fewer than members in each group: (smallest member, member)."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    member = label != np.arange(len(nodes))
    return nodes[label[member]], nodes[member]


def compared(batches, threshold: int = THRESHOLD):
    """Links of a partition that is sorted by cell, those at home first. Held are the homes of one cell and a batch."""
    arrow = to_arrow_schema(LINK)
    held_cell, held = -1, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, home, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        home_cell, home_fp = cell[home], fps[home]
        if held_cell == cell[0]:
            home_cell, home_fp = np.r_[np.full(len(held), held_cell), home_cell], np.r_[held, home_fp]
        first, last = np.searchsorted(home_cell, cell, "left"), np.searchsorted(home_cell, cell, "right")
        count, found = last - first, []
        ends = np.cumsum(count)
        start = 0
        while start < len(cell):
            base = ends[start] - count[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
            n = count[start:stop]
            guest = np.repeat(np.arange(start, stop), n)
            at = np.arange(len(guest)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)
            a, b = home_fp[at], fps[guest]
            near = (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= threshold) & (a != b)
            if near.any():
                found.append(forest(a[near], b[near]))
            start = stop
        if found:
            u, v = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=arrow)
        held_cell = cell[-1]
        own = home_cell == held_cell
        held = home_fp[own]


def near_links(distinct: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """Links (u, v) that connect all fingerprints of a table of distinct ones (column fp) which differ in ``threshold`` bits or fewer."""
    spark, count = distinct.sparkSession, distinct.count()
    if blocks is None:
        blocks = 3 if count <= WIDE_FROM else 2
    covering, arrow = Covering(blocks, threshold), to_arrow_schema(CELL)
    fps = distinct.select("fp")

    def at_home(batches):
        for b in batches:
            cells = np.concatenate(covering.homes(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(cells)], names=["cell"])

    most = max(HOT_HOMES, blocks * count // HOT_ANCHORS)  # at home are blocks * count in all, so fewer than HOT_ANCHORS anchors have more
    crowded = fps.mapInArrow(at_home, "cell bigint").groupBy("cell").count().where(F.col("count") > most)
    hot = {r[0]: min(-(-r[1] // most), (1 << _SALT_BITS) - 1) for r in crowded.collect()}
    shared = spark.sparkContext.broadcast(hot)

    def replicate(batches):
        for b in batches:
            own = b.column(0).to_numpy()
            for i in range(0, len(own), 2048):
                for part in covering.anchors(own[i : i + 2048]):
                    cells, home, fp = salted(*part, shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(home), pa.array(fp)], schema=arrow)

    entries = count * sum(np.mean([len(m) for m in masks]) for _, _, _, masks in covering.blocks)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // PARTITION_ENTRIES))
    cells = fps.mapInArrow(replicate, CELL).repartition(n, "cell").sortWithinPartitions("cell", F.desc("home"))
    return cells.mapInArrow(lambda batches: compared(batches, threshold), LINK)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node reachable; alternating large and small stars. A round's tables are removed when the next is written."""
    spark = links.sparkSession
    edges, at = cut_at(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # minima are written before the joins: then either side of a join is a shuffle of its own, and the partition of a row with very many links is split
        both = edges.union(edges.select("v", "u"))
        low, low_at = cut_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large, large_at = cut_at(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down, down_at = cut_at(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        edges, new_at = cut_at(small)
        for path in (at, low_at, large_at, down_at):
            drop_table(spark, path)
        at = new_at
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, row=None) -> DataFrame:
    """(row, id, fp) of every document."""
    rows = docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(values):
        for row, key, text in values:
            yield row, key, fingerprint(text)

    return arrow_map(rows, ["row", "id", "text"], run, ["row bigint", pass_id(rows, "id"), "fp bigint"])


def classes(table: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, first) for a written (row, id, fp) table: each distinct fingerprint with the first member of its class, a struct of absent, id, row."""
    member = F.struct(F.col("id").isNull().alias("absent"), "id", "row")
    distinct = cut(table.groupBy("fp").agg(F.min(member).alias("first")))
    roots = components(near_links(distinct, threshold))
    members = cut(roots.select(F.col("node").alias("fp"), "root").join(distinct, "fp"))
    of_root = cut(members.groupBy("root").agg(F.min("first").alias("least")))
    named = members.select("fp", "root").join(of_root, "root").select("fp", "least")
    return cut(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, fingerprint, component_id."""
    table = cut(fingerprints(docs, id_col, text_col))
    out = table.join(classes(table, threshold), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The first document of each class, with its columns. Documents are written once with a row number, which decisions are joined by."""
    row = free_name(docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    table = cut(fingerprints(numbered, id_col, text_col, row))
    stay = classes(table, threshold).select(F.col("first.row").alias(row)).distinct()
    return numbered.join(stay, row, "left_semi").drop(row)
