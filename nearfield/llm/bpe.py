"""BPE encoding and decoding with a contiguous rank array per word.

A short word that the pretokenizer cuts off is held as two flat arrays: its parts' ids,
and the boundaries between them, each with the rank of the two parts that it
parts. The boundaries are scanned for the lowest rank over and over (leftmost among
equals); that boundary is deleted, so what stands behind it moves up, its two parts become one, and the ranks of the
two boundaries beside it are looked up again. Words of up to ``BLOCK_BYTES`` bytes which a worker hasn't met before
take these steps together with all others of their length, as rows of matrices that lose a column a step; longer ones take them
alone, over lists. Words over ``LONG_WORD`` bytes aren't short: they go through a heap with the same order of
merges, so one very long run of letters costs n log n and not n^2.

Ids equal those of the ``tokenizers`` library for byte-level BPE files:
merges are looked up by pair of ids, the special tokens of the file are cut
out first wherever their strings stand in a text.

A very long text is encoded in pieces of about ``PIECE_CHARS`` characters, which end where a
single space stands between two words, as every word of the pretokenizer does that starts there; so memory is
a piece's words and the text's ids, but for a longer text without such a space.

Defined results: null text is the empty text (no ids); null ids stay null;
repeated rows each give a row; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pass_id

#: The pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 384
#: Words kept with their ids by a worker; when full it starts afresh.
CACHE_WORDS = 600_000
CACHE_WORD_CHARS = 40
#: Bytes up to which words of equal length are merged as rows of a matrix, rows of one, characters of text handled together, and of one text.
BLOCK_BYTES, BLOCK_WORDS = 48, 65_536
BLOCK_CHARS, PIECE_CHARS = 1_500_000, 1_000_000
_SLOTS = 1 << 19
_HASH = np.uint64(0x9E3779B97F4A7C15)
_NONE = 1 << 62
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1


def byte_symbols() -> list[str]:
    """The printable symbol of every byte in byte-level vocabulary files: itself if printable Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def class_ranges(prop: str) -> str:
    """The characters below U+10000 that have a property, as the inside of a character class."""
    has, out = regex.compile(prop).fullmatch, []
    for c in (*range(0xD800), *range(0xE000, 0x10000)):
        if has(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


@lru_cache(maxsize=1)
def splitters():
    """Two functions that split text as PATTERN does: one for any text, and one that is several times faster, for text without characters from U+10000 on."""
    letter, number, space = (class_ranges(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    quick = rf"[{letter}]+| [{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return regex.compile(PATTERN).findall, re.compile(quick).findall, re.compile("[\U00010000-\U0010ffff]").search


class Words(dict):
    """Words and their ids' bytes; a word that isn't there is encoded, and kept if it is short."""

    def __init__(self, bpe: RankBpe):
        super().__init__()
        self.encode_word = bpe.encode_word

    def __missing__(self, word: str) -> bytes:
        got = self.encode_word(word)
        if len(word) <= CACHE_WORD_CHARS:
            self[word] = got
        return got


class RankBpe:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.token_bytes: list[bytes] = [b""] * size
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in vocab.items():
            if token not in special:
                self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [vocab[s] for s in symbols]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << _ID_BITS | vocab[b], rank << _ID_BITS | vocab[a + b])
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.any_words, self.bmp_words, self.beyond_bmp = splitters()
        self.cache = Words(self)
        self.slot_key, self.slot_value = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, _NONE, np.int64)
        for key, value in self.pairs.items():
            at = (key * int(_HASH) & 0xFFFFFFFFFFFFFFFF) >> 45
            while self.slot_key[at] >= 0:
                at = (at + 1) % _SLOTS
            self.slot_key[at], self.slot_value[at] = key, value

    def words(self, text: str) -> list[str]:
        return (self.any_words if self.beyond_bmp(text) else self.bmp_words)(text)

    def pair_values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and new id of each pair, _NONE where there is no merge."""
        key = left << _ID_BITS | right
        at = ((key.astype(np.uint64) * _HASH) >> np.uint64(45)).astype(np.int64)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_value[at], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % _SLOTS
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_value[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_block(self, ids: np.ndarray) -> list[bytes]:
        """``merge_short`` for words of one length together: ids (words x parts). ``low`` has a column for each boundary."""
        count = len(ids)
        done: list = [None] * count
        low = self.pair_values(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, -1) if ids.shape[1] > 1 else np.zeros((count, 0), np.int64)
        words = np.arange(count)
        while True:
            every = np.arange(len(words))
            if low.shape[1]:
                i = low.argmin(1)
                best = low[every, i]
                go = best < _NONE
            else:
                go = np.zeros(len(words), bool)
            if not go.all():
                still = np.flatnonzero(~go)
                raw, size = ids[still].astype("<u4").tobytes(), 4 * ids.shape[1]
                for j, word in enumerate(words[still].tolist()):
                    done[word] = raw[size * j : size * (j + 1)]
                words, ids, low = words[go], ids[go], low[go]
                if not len(words):
                    return done
                i, best, every = i[go], best[go], np.arange(len(words))
            ids[every, i] = best & _ID_MASK
            parts, bounds = np.arange(ids.shape[1] - 1), np.arange(low.shape[1] - 1)
            ids = np.take_along_axis(ids, parts + (parts > i[:, None]), 1)
            low = np.take_along_axis(low, bounds + (bounds >= i[:, None]), 1)
            own = np.flatnonzero(i < low.shape[1])
            low[own, i[own]] = self.pair_values(ids[own, i[own]], ids[own, i[own] + 1])
            own = np.flatnonzero(i > 0)
            low[own, i[own] - 1] = self.pair_values(ids[own, i[own] - 1], ids[own, i[own]])

    def learn(self, words) -> None:
        """Puts the short ones among new words into the cache, merged length by length."""
        by_length: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            if len(word) <= CACHE_WORD_CHARS and len(raw := word.encode("utf-8")) <= BLOCK_BYTES:
                group = by_length.setdefault(len(raw), ([], []))
                group[0].append(word)
                group[1].append(raw)
        first = np.array(self.byte_id, np.int64)
        for n, (group, raws) in by_length.items():
            for at in range(0, len(group), BLOCK_WORDS):
                ids = first[np.frombuffer(b"".join(raws[at : at + BLOCK_WORDS]), np.uint8).reshape(-1, n)]
                self.cache.update(zip(group[at : at + BLOCK_WORDS], self.merge_block(ids)))

    def merge_short(self, ids: list[int]) -> list[int]:
        """Repeated scans of the contiguous rank array, which has an entry for each boundary."""
        get = self.pairs.get
        ranks = [get(a << _ID_BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i] = low & _ID_MASK
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _ID_BITS | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << _ID_BITS | ids[i + 1], _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order from a heap of (rank, place)."""
        get, n = self.pairs.get, len(ids)
        ids, right, left = array("q", ids), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << _ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := right[i]) >= n or get(ids[i] << _ID_BITS | ids[j]) != low:
                continue
            ids[i], ids[j] = low & _ID_MASK, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get(ids[i] << _ID_BITS | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := left[i]) >= 0 and (r := get(ids[h] << _ID_BITS | ids[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        byte_id = self.byte_id
        ids = [byte_id[b] for b in word.encode("utf-8")]
        ids = self.merge_short(ids) if len(ids) <= LONG_WORD else self.merge_long(ids)
        return np.array(ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        short = [i for i, text in enumerate(texts) if len(text) <= PIECE_CHARS]
        out: list[bytes] = [b""] * len(texts)
        for i, raw in zip(short, self.encode_pieces([texts[i] for i in short])):
            out[i] = raw
        for i, text in enumerate(texts):
            if len(text) > PIECE_CHARS:
                plain = [text] if self.cut_special is None else self.cut_special.split(text)
                out[i] = b"".join(np.array([self.special[x]], "<u4").tobytes() if j % 2 else b"".join(self.encode_pieces([p])[0] for p in pieces(x)) for j, x in enumerate(plain))
        return out

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        parts = []  # of each text: words, or the id of a special token
        for text in texts:
            if self.cut_special is None or not any(s in text for s in self.special):
                parts.append([self.words(text)])
            else:
                parts.append([self.special[x] if i % 2 else self.words(x) for i, x in enumerate(self.cut_special.split(text))])
        new = set()
        for text in parts:
            for words in text:
                if not isinstance(words, int):
                    new.update(words)
        self.learn([w for w in new if w not in self.cache])
        got = self.cache.__getitem__
        return [b"".join(np.array([p], "<u4").tobytes() if isinstance(p, int) else b"".join(map(got, p)) for p in text) for text in parts]

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode(self, ids) -> str:
        """Bytes of the ids as UTF-8; bytes that aren't become U+FFFD, special tokens their strings."""
        return b"".join(map(self.token_bytes.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> RankBpe:
    """One encoder for each file and worker process."""
    return RankBpe(path)


def pieces(text: str, size: int | None = None):
    """A long text in pieces that the pretokenizer would part as well: each but the last ends before a space between two characters that aren't white space."""
    at, size = 0, size or PIECE_CHARS
    while len(text) - at > size:
        m = _PARTING.search(text, at + size)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


_PARTING = re.compile(r"[^\s\x1c-\x1f\x85](?= [^\s\x1c-\x1f\x85])")


def encoded(rows, bpe: RankBpe, block_chars: int = BLOCK_CHARS):
    """(key, bytes of the ids) for (key, text) rows in order, in blocks of bounded size."""
    keys, texts, size = [], [], 0
    for key, text in rows:
        keys.append(key)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= block_chars:
            yield from zip(keys, bpe.encode_many(texts))
            keys, texts, size = [], [], 0
    yield from zip(keys, bpe.encode_many(texts))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every document: (id, ids array<bigint>, decoded string)."""

    def run(rows):
        bpe = load(tokenizer_path)
        for key, raw in encoded(rows, bpe):
            ids = np.frombuffer(raw, "<u4")
            yield key, ids.tolist(), bpe.decode(ids)

    return arrow_map(docs, [id_col, text_col], run, [pass_id(docs, id_col), "ids array<bigint>", "decoded string"], out_rows=256)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, digested on the worker that made it."""

    def run(rows):
        bpe = load(tokenizer_path)
        for key, raw in encoded(rows, bpe):
            decoded = bpe.decode(np.frombuffer(raw, "<u4"))
            yield key, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

    return arrow_map(docs, [id_col, text_col], run, [pass_id(docs, id_col), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])


def decode_ids(frame: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array column of ids; null ids decode to null."""
    import pandas as pd

    @F.pandas_udf("string")
    def dec(ids: pd.Series) -> pd.Series:
        bpe = load(tokenizer_path)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return frame.withColumn(out_col, dec(F.col(ids_col)))
