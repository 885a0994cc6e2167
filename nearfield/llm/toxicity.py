"""Toxicity by a counterfactually regularised classifier.

A logistic regression over hashed features of a text's different words: the
word and its beginnings of 4, 5 and 6 letters, so that inflected forms share
what is learned. It is fitted on at most ``MOST_LABELLED`` labelled rows (those
with the smallest hashes of doc_id), never on rows whose crc32(doc_id as text)
is a multiple of ``FOLDS``. Counterfactuals: in each labelled text that names a
group, the identity term is swapped for two others of its category and for none, and the
squared difference of the two scores is added to the loss; all terms are
also swapped in a bare sentence each. So the model can lean neither on which group a
text names nor on that it names one, and neutral mentions aren't taken for attacks. Terms are lists of four
languages here; ``train`` takes others.

Features are kept if their counts differ between classes by more than chance;
the model is an array of 2^``HASH_BITS`` weights whatever the corpus's size.

Defined results: null and empty texts get the score of the bias; rows with
null doc_ids count as held out; very long texts are read whole; unlabelled corpora, or labels of one class,
give the share of toxic labels (0 without any) as everyone's score; repeated
rows each give a row; an empty table gives an empty table; extra columns aren't read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, pass_id

FOLDS = 5
#: The most labelled rows that the classifier is fitted on.
MOST_LABELLED = 12_000
HASH_BITS = 20
PENALTY, RIDGE, STEPS = 2.0, 1e-4, 150
#: Standard errors by which a feature's counts must differ between classes.
LEAST_DIFFERENCE = 3.0
#: Texts that a feature must stand in.
LEAST_TEXTS = 3
MARKS = ".,;:!?\"'()[]{}«»¿¡…-–—*#$%&|<>_~`"
CACHE_WORDS = 500_000

#: Identity terms, by category; terms of a line are swapped for each other.
IDENTITIES = tuple(
    tuple(terms.split())
    for terms in (
        "man woman men women male female boy girl transgender nonbinary hombre mujer homme femme mann frau",
        "christian muslim jewish hindu buddhist atheist catholic protestant sikh cristiano musulmán judío chrétien musulman juif christlich muslimisch jüdisch",
        "black white asian latino hispanic african european arab indian indigenous negro blanco noir blanc schwarz weiß",
        "gay straight lesbian bisexual heterosexual homosexual queer",
        "american mexican chinese german french spanish russian turkish polish japanese immigrant refugee foreigner citizen",
        "old young elderly teenager disabled blind deaf autistic",
    )
)


def words_of(text: str | None) -> set[str]:
    """The different words of a whole text, lower case and without marks around them."""
    return {w.strip(MARKS) for w in (text or "").lower().split()} - {""}


def word_features(word: str) -> list[int]:
    mask = (1 << HASH_BITS) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(f"{n}{word[:n]}".encode("utf-8", "replace")) & mask for n in (4, 5, 6) if len(word) >= n] + [digest(f"w{word}".encode("utf-8", "replace")) & mask]


def features(words) -> list[int]:
    return [f for w in words for f in word_features(w)]


def is_held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@lru_cache(maxsize=8)
def category_of(identities: tuple[tuple[str, ...], ...]) -> dict[str, int]:
    return {term: i for i, terms in enumerate(identities) for term in terms}


def counterfactuals(term: str, terms: tuple[str, ...]) -> list[tuple[str, str]]:
    """A term and what it is swapped for: the next two of its category, and nothing."""
    i = terms.index(term)
    return [(term, terms[(i + 1) % len(terms)]), (term, terms[(i + 2) % len(terms)]), (term, "")]


def swaps(words: set[str], identities=IDENTITIES) -> list[tuple[str, str]]:
    """The counterfactuals of each identity term of a text."""
    known = category_of(identities)
    return [pair for term in sorted(words & known.keys()) for pair in counterfactuals(term, identities[known[term]])]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, identities=IDENTITIES) -> DataFrame:
    """Features and swaps of the labelled rows that are fitted on; their number has a fixed bound, which makes them safe to broadcast and to collect."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")

    def run(values):
        for _key, text, toxic in values:
            words = words_of(text)
            yield toxic, features(sorted(words)), [x for pair in swaps(words, identities) for x in pair]

    return arrow_map(rows, ["id", "text", "toxic"], run, ["toxic int", "features array<int>", "swaps array<string>"], out_rows=256)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def telling(feature: np.ndarray, pos: np.ndarray, neg: np.ndarray, bad: int, n: int) -> np.ndarray:
    """The features whose counts (in toxic and other texts) differ by more than chance."""
    rate = (pos + neg) / n
    z = (pos / bad - neg / (n - bad)) / np.sqrt(rate * (1 - rate) * (1 / bad + 1 / (n - bad)) + 1e-12)
    return np.sort(feature[(np.abs(z) >= min(LEAST_DIFFERENCE, math.sqrt(bad) / 2)) & (pos + neg >= LEAST_TEXTS)])


def fit(toxic: np.ndarray, lists: list[np.ndarray], pairs: list[tuple[str, str]], used: np.ndarray | None = None, penalty: float = PENALTY, identities=IDENTITIES) -> Model:
    """Logistic loss plus ``penalty`` times the mean squared difference of counterfactual scores, by full-batch Adagrad. used: the features to learn; chosen here where None."""
    size = 1 << HASH_BITS
    weights, n, bad = np.zeros(size, np.float32), len(toxic), int(toxic.sum())
    if not bad or bad == n:
        share = min(max(bad / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model(weights, math.log(share / (1 - share)))
    at = np.concatenate(lists)
    doc = np.repeat(np.arange(n), [len(x) for x in lists])
    if used is None:
        once = np.unique(doc.astype(np.int64) << HASH_BITS | at)  # a document counts once for each feature
        of, own = once & size - 1, toxic[once >> HASH_BITS]
        used = telling(np.arange(size), np.bincount(of, own, size), np.bincount(of, 1 - own, size), bad, n)
    if not len(used):
        return Model(weights, math.log(bad / (n - bad)))
    pair_list = pairs + [pair for terms in identities for term in terms for pair in counterfactuals(term, terms)]
    number = np.full(size, -1, np.int64)
    number[used] = np.arange(len(used))
    col = number[at]
    doc, col = doc[col >= 0], col[col >= 0]
    diff_row, diff_col, diff_sign = [], [], []
    for i, (a, b) in enumerate(pair_list):
        for word, sign in ((a, 1.0), (b, -1.0)):
            for c in number[word_features(word)].tolist() if word else ():
                if c >= 0:
                    diff_row.append(i)
                    diff_col.append(c)
                    diff_sign.append(sign)
    diff_row, diff_col, diff_sign = np.array(diff_row, np.int64), np.array(diff_col, np.int64), np.array(diff_sign)
    w, b = np.zeros(len(used)), math.log(bad / (n - bad))
    sum_w, sum_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):
        score = np.bincount(doc, w[col], n) + b
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - toxic) / n
        grad = np.bincount(col, error[doc], len(used)) + RIDGE * w
        if len(diff_row):
            gap = np.bincount(diff_row, diff_sign * w[diff_col], len(pair_list))
            grad += np.bincount(diff_col, 2 * penalty / len(pair_list) * gap[diff_row] * diff_sign, len(used))
        sum_w += grad**2
        sum_b += error.sum() ** 2
        w -= 0.3 * grad / np.sqrt(sum_w)
        b -= 0.3 * error.sum() / math.sqrt(sum_b)
    weights[used] = w
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, identities=IDENTITIES) -> Model:
    """Features are counted and chosen on the executors; the driver gets the chosen ones of each labelled row."""
    rows = cut(training_rows(docs, labels, id_col, text_col, identities))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == n:
        return fit(np.r_[np.ones(bad), np.zeros(n - bad)], [], [])
    counts = rows.select("toxic", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("pos"), F.count("*").alias("all"))
    table = counts.where(F.col("all") >= LEAST_TEXTS).toArrow()  # at most 2^HASH_BITS rows of three numbers
    feature, pos, every = (table.column(c).to_numpy().astype(np.int64) for c in ("feature", "pos", "all"))
    used = telling(feature, pos, every - pos, bad, n)

    def chosen(values):
        for toxic, found, swapped in values:
            found = np.array(found, np.int64)
            yield toxic, found[np.isin(found, used)].tolist(), swapped

    table = arrow_map(rows, ["toxic", "features", "swaps"], chosen, ["toxic int", "features array<int>", "swaps array<string>"]).toArrow()
    pairs = [(a, b) for s in table.column("swaps").to_pylist() for a, b in zip(s[::2], s[1::2])]
    lists = [np.asarray(x.values, np.int64) for x in table.column("features")]
    return fit(table.column("toxic").to_numpy().astype(float), lists, pairs, used, penalty, identities)


class Scorer:
    """Scores of texts; the sum of a word's weights is kept per worker."""

    def __init__(self, model: Model):
        self.weights, self.bias, self.known = model.weights, model.bias, {}

    def score(self, text: str | None) -> float:
        known, total = self.known, self.bias
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in sorted(words_of(text)):
            value = known.get(word)
            if value is None:
                value = known[word] = float(self.weights[word_features(word)].sum())
            if value:
                total += value
        return 1 / (1 + math.exp(-min(max(total, -30.0), 30.0)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted. The model's size is fixed, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(values):
        scorer = Scorer(Model(*shared.value))
        for key, text in values:
            score = scorer.score(text)
            yield key, score, int(score >= 0.5)

    out = arrow_map(docs, [id_col, text_col], run, [pass_id(docs, id_col), "score double", "predicted int"])
    return out.select(id_col, is_held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", "predicted")
