"""Packing of documents into training windows of several lengths.

Each task packs the documents of its own partition in one pass, so no text is
shuffled and memory is a block of texts and ``BUFFER`` tokens:

1. Routing. A document's full ``max`` windows leave at once; what is left of
   it waits in the shortest tier (context size) that can hold it.
2. Packing. When more than ``BUFFER`` tokens wait, windows are packed until half
   of them are left, those of the longest tier first. A tier's longest waiting document opens a window; in
   all tiers but the shortest it is over half of the window, so a tier's windows have a gap each.
3. Gap filling. A gap is filled from the shorter tiers (in the shortest tier from itself) by best fit: the
   longest whole document that fits, again and again. What then is left of the gap takes a piece of the shortest document that is longer; the rest
   of that goes back to the tier it now fits. So windows are full, and few documents are cut.
4. At the end of the partition all that waits is packed; what doesn't fill the last window is cut into windows of
   falling powers of two, which need no padding.
5. Step groups. Windows of one length are gathered into groups of
   ``step_tokens`` tokens, so that every step of a training run takes as many
   tokens whatever its tier; the incomplete groups at the end of a partition
   are joined, longest windows first.

A task's result depends on its partition's rows and their order only, so a
task that is run again after a lost executor writes the same rows.
``sequence_id`` and ``step_group`` hold the partition's number in their upper
bits: unique, not consecutive.

Defined results: a null or empty text is a document of the end id alone; null
and repeated doc_ids are documents of their own; a very long text fills as many windows as it takes; an empty table has no pieces;
extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoded, load
from .common import arrow_map, pass_id

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 8 * 2048
#: Tokens that may wait for a window.
BUFFER = 256 * 2048
_PARTITION_BITS = 33


class Waiting:
    """Pieces (doc, start, length) by length; the lengths that there are stand as bits of one number."""

    def __init__(self):
        self.lists: dict[int, list] = {}
        self.there, self.tokens = 0, 0

    def put(self, piece) -> None:
        own = self.lists.setdefault(piece[2], [])
        own.append(piece)
        self.there |= 1 << piece[2]
        self.tokens += piece[2]

    def take(self, length: int):
        own = self.lists[length]
        piece = own.pop()
        if not own:
            self.there ^= 1 << length
        self.tokens -= length
        return piece

    def longest(self, most: int):
        """Takes a longest piece of ``most`` tokens or fewer; None if there is none."""
        found = (self.there & (2 << most) - 1).bit_length() - 1
        return self.take(found) if found > 0 else None

    def shortest(self, least: int):
        """Takes a shortest piece of more than ``least`` tokens; None if there is none."""
        found = self.there >> least + 1
        return self.take(least + (found & -found).bit_length()) if found else None


class Packer:
    """Packs a stream of (key, number of tokens) into windows; yields (key, start, length, sequence, offset, tier, group)."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS, buffer: int = BUFFER):
        self.tiers, self.step_tokens, self.buffer = sorted(tiers), step_tokens, buffer
        if any(t & (t - 1) for t in self.tiers) or step_tokens % self.tiers[-1]:
            raise ValueError("tiers must be powers of two, and a step a multiple of the longest")
        self.waits = Waiting()
        self.waiting = {t: [] for t in self.tiers}  # full windows of an incomplete group
        self.sequences = self.groups = 0

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def add(self, doc, tokens: int):
        """``doc`` is carried along with each of its pieces."""
        start, longest = 0, self.tiers[-1]
        while tokens - start >= longest:
            yield from self.full(longest, [(doc, start, longest)])
            start += longest
        if left := tokens - start:
            self.waits.put((doc, start, left))
        if self.waits.tokens > self.buffer:
            while self.waits.tokens > max(self.buffer // 2, self.tiers[-1]):  # enough for any window to be full
                yield from self.full(*self.window())

    def window(self) -> tuple[int, list]:
        """The next window's tier and pieces; it is full but where nothing else waits."""
        waits = self.waits
        window = [waits.longest(self.tiers[-1])]
        tier = self.tier(window[0][2])
        gap = tier - window[0][2]
        while gap and (piece := waits.longest(gap)):
            window.append(piece)
            gap -= piece[2]
        if gap and (piece := waits.shortest(gap)):
            doc, start, length = piece
            window.append((doc, start, gap))
            waits.put((doc, start + gap, length - gap))
        return tier, window

    def full(self, tier: int, window: list):
        group = self.waiting[tier]
        group.append(window)
        if len(group) * tier == self.step_tokens:
            self.waiting[tier] = []
            yield from self.step([(tier, w) for w in group])

    def step(self, windows: list):
        for tier, window in windows:
            offset = 0
            for doc, start, length in window:
                yield doc, start, length, self.sequences, offset, tier, self.groups
                offset += length
            self.sequences += 1
        self.groups += 1

    def end(self):
        left = []
        while self.waits.tokens:
            tier, window = self.window()
            if sum(piece[2] for piece in window) == tier:
                yield from self.full(tier, window)
            else:
                left = window
        size = sum(piece[2] for piece in left)
        short = []
        while size:
            want = room = 1 << (size.bit_length() - 1)
            window = []
            while room:
                doc, start, length = left.pop(0)
                if length > room:
                    left.insert(0, (doc, start + room, length - room))
                    length = room
                window.append((doc, start, length))
                room -= length
            short.append((want, window))
            size -= want
        last = sorted([*((t, w) for t in self.tiers for w in self.waiting[t]), *short], key=lambda x: -x[0])
        group, size = [], 0
        for tier, window in last:
            group.append((tier, window))
            size += tier
            if size == self.step_tokens:
                yield from self.step(group)
                group, size = [], 0
        if group:
            yield from self.step(group)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tiers=TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, and with ``with_ids`` the ids themselves."""

    def run(rows):
        bpe, packer = load(tokenizer_path), Packer(tiers, step_tokens)
        base = TaskContext.get().partitionId() << _PARTITION_BITS
        end = np.array([end_id], "<u4").tobytes()

        def out(pieces):
            for (key, raw), start, length, sequence, offset, tier, group in pieces:
                own = raw[4 * start : 4 * (start + length)]
                made = key, start, length, zlib.crc32(own), len(raw) // 4, base + sequence, offset, tier, base + group
                yield (*made, np.frombuffer(own, "<u4").tolist()) if with_ids else made

        for key, raw in encoded(rows, bpe):
            raw += end
            yield from out(packer.add((key, raw), len(raw) // 4))
        yield from out(packer.end())

    fields = [pass_id(docs, id_col), "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint", "tier int", "step_group bigint"]
    return arrow_map(docs, [id_col, text_col], run, fields + ["ids array<bigint>"] * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows of ``pack_documents(with_ids=True)``: sequence_id, tier, step_group, ids in order. A group is one window, so it is bounded by the longest tier."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.first("tier").alias("tier"), F.first("step_group").alias("step_group"), F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
