"""Secret scan: fixed patterns, and strings that a tokenizer's vocabulary finds unusually costly.

A vocabulary learned from text spells words with few tokens; random strings
need about one for every two characters. Strings of ``LEAST_CHARS`` or more
characters of the base64 alphabets are encoded, and one with fewer than
``MOST_RATIO`` characters a token is a secret (kind ``random``), unless it is a
digest of a known length, an identifier of a known form, or has no letters.
Strings without digits may be words or names run together, of which rare ones cost
much, so these need fewer than ``MOST_RATIO_WITHOUT_DIGITS``; random letters of both
cases have about 1.4. Fixed patterns come first and always stay; a string that
overlaps one isn't reported twice. Time is linear in a text's length, but for the sorting of its spans.

Spans are kind:start:end in code points, end exclusive, by start and then by
the order of ``KINDS``.

Defined results: null text has no spans; null or repeated doc_ids are scanned
each on its own; an empty table gives an empty table; very long texts are scanned whole; extra columns aren't read
(``drop_documents`` and ``redact`` return them as they were).
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import Surroundings, arrow_filter, arrow_map, pass_id

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_ASSIGNED = ("passw", "secret", "token", "key")
LEAST_CHARS, MOST_RATIO, MOST_RATIO_WITHOUT_DIGITS = 20, 2.3, 1.75
#: Characters that are encoded together.
PIECE = 2048
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_DIGITS = re.compile(r"[0-9]")
#: Digests by their length in hex digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and forms of identifiers.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})|sha(?:1|256|384|512)-[A-Za-z0-9+/]+={0,2}")
_IDENTIFIER = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9]{2}-?[0-9]{2}-?[0-9]{2}[A-Za-z0-9+-]*")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(string: str) -> bool:
    """Whether a string is a digest or an identifier, or has no letters."""
    return bool(_DIGEST.fullmatch(string) or _IDENTIFIER.fullmatch(string)) or not any(c.isalpha() for c in string)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    found = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(x in low for x in _ASSIGNED):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def random_spans(text: str, taken: list[tuple[int, int, int]], vocab) -> list[tuple[int, int, int]]:
    """taken: spans in order that these mustn't overlap."""
    found, around = [], Surroundings(taken)
    for m in _LONG.finditer(text):
        a, b = m.span()
        string = m[0].strip("=-_/+")
        if len(string) < LEAST_CHARS or known(string) or around.overlap(a, b):
            continue
        most = MOST_RATIO if _DIGITS.search(string) else MOST_RATIO_WITHOUT_DIGITS
        if len(string) < most * token_count(string, vocab):
            found.append((a, 3, b))
    return found


def token_count(string: str, vocab) -> int:
    """Tokens of a string, in pieces of ``PIECE`` characters: the encoder's time grows with the square of a word's length."""
    return sum(len(vocab.encode_ordinary(string[i : i + PIECE])) for i in range(0, len(string), PIECE))


def scan(text: str | None, vocab) -> tuple[list, list]:
    """Base spans and all spans, both in order."""
    base = sorted(base_spans(text or ""))
    return base, sorted(base + random_spans(text or "", base, vocab))


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the fixed patterns, base_sha256, spans, and ratios (characters a token of each span, in their order)."""

    def run(rows):
        vocab = vocabulary(vocabulary_path)
        for key, text in rows:
            base, every = scan(text, vocab)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            ratios = ",".join(f"{len(x) / token_count(x, vocab):.2f}" for x in (text[a:b] for a, _, b in every))
            yield key, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(every), ratios

    return arrow_map(docs, [id_col, text_col], run, [pass_id(docs, id_col), "n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string", "spans string", "ratios string"])


def drop_documents(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """The documents without secrets, with their columns. A bare digest of a known length is no reason to drop a document."""

    def keep(texts):
        vocab, out = vocabulary(vocabulary_path), []
        for text in texts:
            out.append(not any(k != 2 or not _DIGEST.fullmatch(text[a:b]) for a, k, b in scan(text, vocab)[1]))
        return out

    return arrow_filter(docs, text_col, keep)


def redact(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with a mark in place of each span or group of overlapping spans."""
    if not spans:
        return text
    out, end = [], 0
    for a, _, b in sorted(spans):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])
