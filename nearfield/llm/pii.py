"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are the matches of fixed patterns (e-mail, IP, card, phone), and
names, national ids, bank accounts and local phone numbers, found by
loose shapes. Five labelers vote yes, no or nothing on each: a strict
regular expression or check digit, a gazetteer (given names, issuers of cards, calling codes, ranges of addresses,
top-level domains), the words before it, its
surroundings (other personal data nearby), and its place (inside an address
of a page or a longer number). The corpus is read once; what is learned from are the
counts of each combination of votes over all of it. Expectation-maximisation estimates
each labeler's reliability from all kinds together, and the share of true ones for each kind (a model with a hidden
true label; nothing but a weak belief that labelers beat chance is put in), and
a logistic regression on votes, kind, length and the word before (by hash) is trained with the resulting soft
labels. It scores every candidate. Matches of fixed patterns are spans whatever their score, which stands beside them; others
are spans from a score of 0.5 on. Any two capitalised
words are looked at as a name, and up to four with further given names or a second
surname, from each word on; a word that is a cue itself (Contact, Mr) is part of
none. Of names that overlap the surest stays, then the longest, then the first.

The number of combinations is at most kinds * 3^5 * ``LENGTHS`` * ``WORDS``, whatever the corpus's size. Time is
linear in a text's length, but for the sorting of its spans.

Spans are kind:start:end in code points, end exclusive, by start and then by
the order of ``KINDS``.

Defined results: null text has no spans; null or repeated doc_ids are scanned
each on its own; an empty table gives an empty table and trains nothing; very long texts are scanned whole; extra
columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Surroundings, arrow_map, cut, pass_id

KINDS = ("email", "ip", "card", "phone", "name", "national_id", "account", "local_phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Numbers joined by single dots, as long as they go on; a run of digits is looked at from its beginning only.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Characters before a candidate that are read for context.
CONTEXT = 40
LABELERS = ("shape", "gazetteer", "context", "nearby", "place")

#: Spans this near are surroundings.
NEAR = 80
#: Buckets of a candidate's length and of the word before it.
LENGTHS, WORDS = 4, 16

#: Given names; ``find_personal_data`` takes others.
GIVEN_NAMES = frozenset(
    "Adam Ahmed Alan Albert Alejandro Alessandro Alex Alexander Ali Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Antoine Anthony Antonio Arthur Ashley Barbara Benjamin Bernd Bernard Betty Brandon Brian Camille Carl Carlos Carmen Carol Carolyn Catherine Charles Charlotte Chloé Christian Christine Christopher Claire Claudia Cynthia Daniel David Deborah Dennis Diego Dieter Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fatima Felix Fernando Francisco François Frank Gary George Gerhard Giulia Gregory Hannah Hans Heinz Helen Henry Isabel Jack Jacob James Jane Janet Javier Jean Jeffrey Jennifer Jessica Joan Johann John Jonathan Jorge José Joseph Joshua Juan Judith Jürgen Julia Julie Justin Karen Karl Katherine Kathleen Kelly Kenneth Kevin Klaus Larry Laura Lauren Lena Leon Linda Lisa Louis Louise Lucas Lucía Luis Luisa Manuel Margaret Maria María Marie Mark Martha Martin Mary Matthew Melissa Michael Michelle Miguel Mohamed Mohammed Monika Nancy Nathalie Nicholas Nicolas Nicole Nina Olivia Omar Pablo Pamela Patricia Patrick Paul Pedro Peter Petra Philip Philippe Pierre Rachel Ralph Raymond Rebecca Renate Richard Robert Roberto Roger Ronald Rosa Ruth Ryan Samantha Samuel Sandra Sara Sarah Scott Sofia Sophie Stefan Stephanie Stephen Steven Susan Teresa Thomas Timothy Ursula Victor Victoria Virginia Walter Werner William Wolfgang Yusuf".split()
)
#: Words before a candidate that speak for it, by kind, and words that speak against it.
CUES = (
    re.compile(r"\b(?:e-?mail|mail|contact|write to|reach)\b", re.IGNORECASE),
    re.compile(r"\b(?:ip|address|host|server|login from|client)\b", re.IGNORECASE),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)\b", re.IGNORECASE),
    re.compile(r"\b(?:call|phone|tel|mobile|cell|fax|telefon|teléfono|téléphone)\b", re.IGNORECASE),
    re.compile(r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|señor|señora|monsieur|madame)\.?|\b(?:name is|named|signed|contact|dear|attn|called)[:,]?)\s*$", re.IGNORECASE),
    re.compile(r"\b(?:ssn|social security|national id|tax id|passport)\b", re.IGNORECASE),
    re.compile(r"\b(?:iban|account|konto|cuenta|compte|bank)\b", re.IGNORECASE),
    re.compile(r"\b(?:call|phone|tel|mobile|cell|fax|telefon|teléfono|téléphone)\b", re.IGNORECASE),
)
AGAINST = re.compile(r"\b(?:order|invoice|version|release|isbn|issn|part|model|figure|fig|table|section|street|hotel|university|river)\W*$", re.IGNORECASE)
#: Beginnings of card numbers with their lengths, calling codes of a digit or two, first octets that aren't a host's, common top-level domains.
ISSUERS = re.compile(r"4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68])[0-9]{11}|6(?:011|4[4-9]|5)[0-9]{10,13}|35[0-9]{14}")
CALLING = re.compile(r"1|7|2[07]|3[0-4689]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
DOMAINS = re.compile(r"\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|ch|at|nl|be|pl|mx|ar|br|jp|cn|in|au)$", re.IGNORECASE)
_CAPITALISED = r"[A-ZÀ-Þ][a-zà-ÿ]+"
_FURTHER = rf" (?:[A-Z]\. )?({_CAPITALISED})(?![\w'-])"
#: A capitalised word with others after it, which are only looked at: the next match may start at the second word.
_NAME = re.compile(rf"(?<![\w'-])({_CAPITALISED})(?={_FURTHER})")
_NEXT_NAME = re.compile(_FURTHER)
#: Words of a name, and those of them after the first that needn't be given names.
MOST_NAME_WORDS, MOST_SURNAMES = 4, 2
CANDIDATES = (
    (5, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (6, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    (7, re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    found = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:  # the part before an @ has none, so each stands for itself
        if m := _DOMAIN.match(text, at):
            low = at
            while low > end and (c := text[low - 1]) in _LOCAL_CHARS:
                low -= 1
            if low < at:
                found.append((low, 0, m.end()))
                at = end = m.end()
                continue
        at += 1
    if _DIGITS.search(text):
        for m in _DOTTED.finditer(text):
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):  # from left to right, four at a time
                own = parts[i : i + 4]
                end = at + sum(map(len, own)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                    found.append((at, 1, end))
                at = end + 1
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def iban_valid(string: str) -> bool:
    s = string.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def strict(kind: int, string: str, digits: str) -> tuple[str, str]:
    """The votes of the strict regular expression or check digit, and of the gazetteer for all kinds but names."""
    yes = lambda x: "y" if x else "n"
    if kind == 0:
        local, domain = string.rsplit("@", 1)
        good = local[0] not in ".-" and local[-1] != "." and ".." not in local and re.search(r"\.[A-Za-z]{2,}$", domain) is not None
        return yes(good), "y" if DOMAINS.search(domain) else "-"
    if kind == 1:
        parts = string.split(".")
        first = int(parts[0])
        return yes(all(p == "0" or p[0] != "0" for p in parts)), "n" if first in (0, 127) or first >= 240 else "y" if first > 9 else "-"
    if kind == 2:
        return yes(13 <= len(digits) <= 19 and len(set(digits)) > 2), yes(ISSUERS.fullmatch(digits))
    if kind == 3:
        return yes(10 <= len(digits) <= 15), yes(CALLING.match(digits))
    if kind == 5:
        return yes(string[:3] not in ("000", "666") and string[0] != "9" and string[4:6] != "00" and string[-4:] != "0000"), "-"
    if kind == 6:
        return yes(iban_valid(string)), "-"
    return yes(digits[0] in "23456789" and digits[3] in "23456789"), "-"


def votes(text: str, kind: int, a: int, b: int, around: Surroundings, own: int | None = None, given=GIVEN_NAMES) -> str:
    """Each labeler's vote on a candidate: y, n, or - for none; then the buckets of its length (one for all names, which compete by it otherwise) and of the word before."""
    string, before = text[a:b], text[max(0, a - CONTEXT) : a]
    if kind == 4:
        shape, named = "-", "y" if string.split(" ", 1)[0] in given else "n"
    else:
        shape, named = strict(kind, string, "".join(_DIGITS.findall(string)))
    context = "y" if CUES[kind].search(before) else "n" if AGAINST.search(before) else "-"
    nearby = "y" if around.near(a, b, NEAR, own) else "-"
    word = before[before.rfind(" ") + 1 :]
    place = "n" if "/" in word or "=" in word or "\\" in word or text[b : b + 1] in ("/", "=", "_") else "-"
    last = before.split()[-1:]
    bucket = xxhash.xxh64_intdigest(last[0].lower().encode("utf-8", "replace")) % (WORDS - 1) + 1 if last else 0
    return f"{shape}{named}{context}{nearby}{place}{0 if kind == 4 else min((b - a) // 8, LENGTHS - 1)}{bucket:02d}"


def name_runs(text: str, known=GIVEN_NAMES):
    """(start, ends) of each word that may begin a name: the ends of two words, and of three and four where the further ones may belong to it."""
    for m in _NAME.finditer(text):
        if CUES[4].fullmatch(m[1]):
            continue
        ends, given, others, at = [], m[1] in known, 0, m.end()
        while len(ends) < MOST_NAME_WORDS - 1 and (w := _NEXT_NAME.match(text, at)):
            is_given = w[1] in known
            others += not (given and is_given)
            if CUES[4].fullmatch(w[1]) or ends and (is_given and not given or others > MOST_SURNAMES or AGAINST.fullmatch(w[1])):
                break
            given, at = given and is_given, w.end()
            ends.append(at)
        if ends:
            yield m.start(), ends


def candidates(text: str, base: list[tuple[int, int, int]], given=GIVEN_NAMES) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, votes): the fixed patterns' spans in order, then others that don't overlap them; names only with a vote for them, for any two capitalised words have the shape, and they may overlap."""
    around = Surroundings(base)
    found = [(a, kind, b, votes(text, kind, a, b, around, i)) for i, (a, kind, b) in enumerate(base)]
    for a, ends in name_runs(text, given):
        for b in ends:
            v = votes(text, 4, a, b, around, given=given)
            if "y" not in v[1:3]:
                break  # the gazetteer and the words before vote alike on all names that start here
            if not around.overlap(a, b):
                found.append((a, 4, b, v))
    if _DIGITS.search(text) is None:
        return found
    for kind, pattern in CANDIDATES:
        for m in pattern.finditer(text):
            a, b = m.span()
            if not around.overlap(a, b):
                found.append((a, kind, b, votes(text, kind, a, b, around)))
    return found


def without_overlaps(names: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the names (score, start, end) that stay: the surest, then the longest, then the first."""
    out, taken = [], set()
    for _, a, b in sorted(names, key=lambda s: (-s[0], s[1] - s[2], s[1])):
        if taken.isdisjoint(range(a, b)):
            taken.update(range(a, b))
            out.append((a, b))
    return out


def estimate(counts: dict[tuple[int, str], int], rounds: int = 100) -> dict[tuple[int, str], float]:
    """The probability that a candidate with these votes is personal data, from expectation-maximisation over all combinations.

    How often each labeler votes y rather than n on true and on false candidates is one pair of numbers for all kinds; the share of true ones is
    each kind's own. The prior is a few votes' worth: labelers are better than chance. A vote that isn't cast is no evidence.
    """
    keys = list(counts)
    n = np.array([counts[k] for k in keys], float)
    seen = np.array([["yn-".index(c) for c in v[: len(LABELERS)]] for _, v in keys])
    kind = np.array([k for k, _ in keys])
    prior = np.repeat(np.array([[3.0, 0.5], [0.5, 3.0]])[:, None] * 4, len(LABELERS), 1)
    belief, rate = prior / prior.sum(2, keepdims=True), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        sure = np.log(np.concatenate([belief, np.ones((2, len(LABELERS), 1))], 2))
        both = [np.log(share[kind]) + sum(sure[t, j, seen[:, j]] for j in range(len(LABELERS))) for t, share in ((0, rate), (1, 1 - rate))]
        true = 1 / (1 + np.exp(np.clip(both[1] - both[0], -50, 50)))
        rate = np.clip((np.bincount(kind, n * true, len(KINDS)) + 2) / (np.bincount(kind, n, len(KINDS)) + 4), 0.01, 0.99)
        for t, weight in ((0, n * true), (1, n * (1 - true))):
            for j in range(len(LABELERS)):
                total = prior[t, j] + np.bincount(seen[:, j], weight, 3)[:2]
                belief[t, j] = total / total.sum()
    return dict(zip(keys, true.tolist()))


def features(kind: int, v: str) -> np.ndarray:
    """A constant, the kind, the votes, the length and the word before."""
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + LENGTHS + WORDS)
    x[0] = x[1 + kind] = 1
    for j, c in enumerate(v[: len(LABELERS)]):
        if c != "-":
            x[1 + len(KINDS) + 2 * j + (c == "n")] = 1
    rest = v[len(LABELERS) :] or "000"
    x[1 + len(KINDS) + 2 * len(LABELERS) + int(rest[0])] = x[1 + len(KINDS) + 2 * len(LABELERS) + LENGTHS + int(rest[1:])] = 1
    return x


def train(counts: dict[tuple[int, str], int], steps: int = 2000) -> np.ndarray:
    """Weights of the span classifier: logistic regression on EM's soft labels, each combination weighed by its count, each kind's sum by its root so that rare kinds count."""
    soft = estimate(counts)
    keys = list(soft)
    x = np.array([features(*k) for k in keys])
    y, n, kind = np.array([soft[k] for k in keys]), np.array([counts[k] for k in keys], float), np.array([k for k, _ in keys])
    n /= np.sqrt(np.bincount(kind, n, len(KINDS)))[kind]
    n, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(steps):
        w -= 1.0 * (x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + 1e-4 * w)
    return w


def written(spans) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given_names=GIVEN_NAMES) -> DataFrame:
    """The one pass over the texts: id, counts, base spans, and candidates with their votes."""

    def run(rows):
        for key, text in rows:
            base = base_spans(text or "")
            n = [sum(k == i for _, k, _ in base) for i in range(4)]
            yield key, *n, written(base), [{"start": a, "kind": k, "end": b, "votes": v} for a, k, b, v in candidates(text or "", base, given_names)]

    return arrow_map(docs, [id_col, text_col], run, [pass_id(docs, id_col), *(f"n_{k} bigint" for k in KINDS[:4]), "base string", "candidates array<struct<start: bigint, kind: int, end: bigint, votes: string>>"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given_names=GIVEN_NAMES) -> DataFrame:
    """One row per document: id, counts of the fixed patterns, base_sha256, spans, and scores (the classifier's for each span, in their order)."""
    scanned = cut(scan_documents(docs, id_col, text_col, given_names))
    pairs = scanned.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count()
    counts = {(r[0], r[1]): r[2] for r in pairs.collect()}  # a row for each combination
    weights = train(counts) if counts else None

    def run(rows):
        score: dict[tuple[int, str], float] = {}
        for *front, base, found in rows:
            spans, names = [], []
            for c in found:
                key = c["kind"], c["votes"]
                if key not in score:
                    score[key] = float(1 / (1 + np.exp(-np.clip(features(*key) @ weights, -30, 30))))
                span = c["start"], c["kind"], c["end"], score[key]
                if c["kind"] < 4 or c["kind"] != 4 and score[key] >= 0.5:
                    spans.append(span)
                elif score[key] >= 0.5:
                    names.append((score[key], c["start"], c["end"]))
            sure = {(a, b): p for p, a, b in names}
            spans = sorted([*spans, *((a, 4, b, sure[a, b]) for a, b in without_overlaps(names))])
            yield *front, hashlib.sha256(base.encode()).hexdigest(), written(spans), ",".join(f"{s[3]:.3f}" for s in spans)

    cols = [id_col, *(f"n_{k}" for k in KINDS[:4])]
    return arrow_map(scanned, [*cols, "base", "candidates"], run, [pass_id(docs, id_col), *(f"n_{k} bigint" for k in KINDS[:4]), "base_sha256 string", "spans string", "scores string"])
