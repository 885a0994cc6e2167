"""Line-first cleaning: rules judge lines, failing lines go, and a document goes if it loses too much of its text.

Lines are cut at \\n. A line with words fails if it

* is mostly signs: under half of its characters other than white space are
  letters or digits, or it has more than one of ``#*$%&|<>`` for every five words;
* shouts: a third of its words or more (five words at least) end in ``!`` or ``?``, or nearly
  all of its letters are capitals over ten words or more;
* is navigation: three or more separators (``|``, ``›``, ``»``, ``·``, ``•``)
  that stand alone and are a fifth of its words or more;
* is boilerplate: up to 25 words with one of the phrases of ``BOILERPLATE``;
* stutters: half of its words (eight words at least) equal the word before;
* repeats an earlier line of three words or more.

A document is kept if the base checks pass and the lines that stay hold at
least ``1 - MOST_LOST`` of its word characters.

Defined results: null and empty texts have no words and fail; rows with null
or repeated doc_ids are judged each on its own; extra columns aren't read
(``filter_documents`` returns them as they were).
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_filter, arrow_map, pass_id

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of the word characters that lines which fail may hold.
MOST_LOST = 0.5
SEPARATORS = frozenset("|›»·•")
#: Phrases of page furniture.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie policy|we use cookies|accept cookies|privacy policy|terms of (?:use|service)|sign up for our newsletter|subscribe to our|click here|read more|share this|log in to|skip to content|enable javascript|powered by|back to top|previous post|next post",
    re.IGNORECASE,
)
_LETTER_OR_SIGN = re.compile(r"[^\W_]")


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    windows = [joined[a:b] for a, b in zip(starts[:n].tolist(), (ends[WINDOW - 1 :] - 1).tolist())]
    if len(set(windows)) == n:
        return 0
    times = Counter(windows)
    twice = np.fromiter((times[w] > 1 for w in windows), bool, n)
    return int((np.convolve(twice, np.ones(WINDOW, np.int64)) > 0).sum())


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line with words fails a rule that looks at it alone."""
    n = len(words)
    size = sum(map(len, words))
    symbols = sum(map(line.count, SYMBOLS))
    if 5 * symbols > n and 5 * symbols - n >= 5:
        return True
    if 2 * len(_LETTER_OR_SIGN.findall(line)) < size:
        return True
    if n >= 5 and 3 * sum(w[-1] in "!?" for w in words) >= n:
        return True
    if n >= 10 and line.isupper():
        return True
    if n >= 8 and 2 * sum(map(eq, words, islice(words, 1, None))) >= n:
        return True
    marks = sum(w in SEPARATORS for w in words)
    if marks >= 3 and 5 * marks >= n:
        return True
    return n <= 25 and BOILERPLATE.search(line) is not None


def lines_kept(text: str) -> tuple[list[str], int, int]:
    """The lines that stay, how many equal an earlier line, and the word characters that stay."""
    kept, seen, again, size = [], set(), 0, 0
    for line in text.split("\n"):
        words = _words(line)
        if not words:
            kept.append(line)
            continue
        if line in seen:
            again += 1
            if len(words) >= 3:
                continue
        seen.add(line)
        if not line_fails(line, words):
            kept.append(line)
            size += sum(map(len, words))
    return kept, again, size


_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def _words(line: str) -> list[str]:
    return line.split() if line.isascii() and not _ODD(line) else _WORDS(line)


_ODD = re.compile("[\x1c-\x1f]").search


def measure(text: str | None) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    text = text or ""
    words = text.encode("utf-8").split()
    n, size = len(words), len(text) - sum(map(text.count, SPACE))
    repeated = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    _, again, left = lines_kept(text)
    return n, size, sum(map(text.count, SYMBOLS)), again, repeated, failed, not failed and left >= (1 - MOST_LOST) * size


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with ``measure``'s values."""

    def run(rows):
        for key, text in rows:
            yield key, *measure(text)

    return arrow_map(docs, [id_col, text_col], run, [pass_id(docs, id_col), "n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint", "base_failed boolean", "kept boolean"])


def clean_text(text: str | None) -> str:
    """The text without the lines that fail."""
    return "\n".join(lines_kept(text or "")[0])


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their columns."""
    return arrow_filter(docs, text_col, lambda texts: [measure(t)[-1] for t in texts])
