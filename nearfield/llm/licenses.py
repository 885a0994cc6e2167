"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a run of lines up to one without words. It is judged by its pieces: its lines, and the sentences of
its folded text (white space made single spaces), so that notices broken into lines are read as one; long pieces are
taken in windows of ``WINDOW`` words that overlap by more than any phrase has. A piece's word n-grams (one and two words) that have a weight
in a sparse multinomial logistic regression are summed per licence family, one
of the classes being "unknown". The model is trained on this file's phrases
(a fixed, small set) and on variants with words left out. The weights' size is
scaled by one temperature, so that its probabilities fit variants of phrases that a
model of the other phrases has never seen, and a family needs ``LEAST_PROBABILITY``. A prediction is
confirmed if the piece holds ``LEAST_SHARED`` of the word pairs of one of the family's
phrases. A paragraph has the families of its pieces.

Every n-gram with a weight holds a cue word, and a piece without n-grams is
"unknown" by the bias alone, so paragraphs and pieces without a cue word are left out by one
regular expression before they are taken apart. Weights and phrases are tables of
a few thousand rows whatever the corpus's size, and are broadcast. What is
shuffled are the n-grams of pieces with cue words, added up before the shuffle.

Defined results: null and empty texts have no families; rows with null or repeated
doc_ids are judged each on its own; very long texts, paragraphs and lines are read whole; an empty table gives an empty table; extra
columns aren't read.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
LEAST_PROBABILITY, LEAST_SHARED = 0.7, 0.6
#: Words of a piece that are judged together, and after how many the next such window begins.
WINDOW, STEP = 240, 180
#: What parts paragraphs, and the sentences of a folded one.
PARTING, SENTENCE = r"\n[\x20\t\x0b\f\r]*\n", r"(?<=[.!?;:])\x20(?=[A-Z\"(\[])"

#: Phrases of licences, by family.
PHRASES = {
    "agpl": ("GNU Affero General Public License version 3", "licensed under the GNU Affero General Public License", "released under the AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "released under the Apache License 2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Use of this source code is governed by a BSD-style license", "released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "licensed under the 3-clause BSD license"),
    "cc0": ("Creative Commons CC0 1.0 Universal", "dedicated to the public domain under CC0", "released under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under CC BY-NC-SA 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the GPL version 2", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under GPLv3"),
    "isc": ("released under the ISC License", "licensed under the ISC license", "SPDX-License-Identifier: ISC"),
    "lgpl": ("GNU Lesser General Public License version 2.1", "under the terms of the GNU Lesser General Public License", "released under the LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "licensed under the MIT license", "SPDX-License-Identifier: MIT", "The MIT License (MIT)"),
    "mpl": ("subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited", "proprietary and confidential, unauthorized copying prohibited", "Copyright, all rights reserved"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "released under the Unlicense", "SPDX-License-Identifier: Unlicense"),
    UNKNOWN: (
        "he lost his driver license on the way to the airport",
        "a fishing license is required for anyone over sixteen",
        "the restaurant applied for a liquor license last year",
        "permission to land was granted by the tower",
        "version 2.0 of the software was released in march",
        "the general public was not admitted to the hearing",
        "students at mit presented their work",
        "the apache helicopter landed near the base",
        "the software comes with a warranty of two years",
        "the source of the river is in the mountains",
        "the document is distributed to all members of the committee",
        "her rights as a citizen were reserved for another chapter",
        "the film was released under a different title",
        "the company has licensed the technology to a partner",
        "the creative team met with people from the commons",
        "attribution of the painting to the master is disputed",
        "free copy of the newspaper for any person who asks",
    ),
}
#: Identifiers of SPDX by family (every version, -only, -or-later and the older forms without them), of which each makes a tag.
SPDX = {
    "agpl": "AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0+ AGPL-3.0-only AGPL-3.0-or-later",
    "apache": "Apache-1.0 Apache-1.1 Apache-2.0",
    "bsd": "0BSD BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSD-2-Clause-Patent BSD-3-Clause-Clear",
    "cc0": "CC0-1.0",
    "cc-by": "CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0",
    "cc-by-nc": "CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0",
    "cc-by-nd": "CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0",
    "cc-by-sa": "CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0",
    "gpl": "GPL-1.0 GPL-1.0+ GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later",
    "isc": "ISC",
    "lgpl": "LGPL-2.0 LGPL-2.0+ LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later",
    "mit": "MIT MIT-0",
    "mpl": "MPL-1.0 MPL-1.1 MPL-2.0",
    "unlicense": "Unlicense",
}
#: Other versions and short forms, by family.
VERSIONS = {
    "agpl": ("licensed under AGPLv3", "released under the AGPL version 3"),
    "apache": ("licensed under Apache 2.0", "Licensed under the Apache License, Version 1.1"),
    "bsd": ("licensed under the 2-clause BSD license", "released under the BSD 2-Clause License"),
    "cc-by": ("licensed under a Creative Commons Attribution 3.0 Unported License",),
    "cc-by-nc": ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License", "licensed under CC BY-NC-ND 4.0"),
    "cc-by-sa": ("licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",),
    "gpl": ("licensed under GPLv2", "licensed under the GNU GPL v2", "licensed under the GNU GPL v3", "GNU General Public License v2.0", "GNU General Public License v3.0", "under the terms of the GNU General Public License version 2 only", "under the terms of the GNU General Public License version 3 or later"),
    "lgpl": ("licensed under LGPLv2", "licensed under LGPLv3", "GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU Library General Public License version 2"),
    "mpl": ("licensed under the Mozilla Public License 1.1", "Mozilla Public License Version 2.0"),
}
for _family, _names in SPDX.items():
    PHRASES[_family] = tuple(dict.fromkeys((*PHRASES[_family], *VERSIONS.get(_family, ()), *(f"SPDX-License-Identifier: {n}" for n in _names.split()))))
FAMILIES = tuple(PHRASES)
#: Words of licence phrases that ordinary prose shares; an n-gram of such words alone is no feature.
COMMON = frozenset("a an and any are as at by file for free from in is it may not of on or person use used this that the to under using version with work you your copy charge except without all other 1 2 3 4 5 0 v 16 clear library patent".split())
_TOKEN = r"[a-z0-9]+"
#: Seconds of training are bounded: phrases, variants of each, steps.
VARIANTS, STEPS, L1, HELD_OUT = 12, 400, 2e-4, 4


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def ngrams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


@lru_cache(maxsize=1)
def cues() -> frozenset[str]:
    """Words of licence phrases that aren't common ones."""
    return frozenset(w for f in FAMILIES if f != UNKNOWN for p in PHRASES[f] for w in tokens(p)) - COMMON


def cued(grams: set[str]) -> set[str]:
    return {g for g in grams if not cues().isdisjoint(g.split())}


def variants(words: list[str], rng: random.Random) -> list[list[str]]:
    """A phrase as it is, with words left out, and inside other words."""
    out = [words]
    for _ in range(VARIANTS):
        kept = [w for w in words if rng.random() > 0.15] or words
        noise = [rng.choice(("the", "and", "project", "see", "file", "code", "our", "page", "text")) for _ in range(rng.randrange(6))]
        at = rng.randrange(len(noise) + 1)
        out.append(noise[:at] + kept + noise[at:])
    return out


def fitted(rows: list[tuple[set[str], int]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each n-gram by family, and the biases: proximal gradient with an L1 penalty."""
    x, y = indicators(rows, names), np.eye(len(FAMILIES))[[k for _, k in rows]]
    w, b, step = np.zeros((len(names), len(FAMILIES))), np.zeros(len(FAMILIES)), 4.0
    for _ in range(STEPS):
        p = softmax(x @ w + b)
        w -= step * (x.T @ (p - y)) / len(x)
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        b -= step * (p - y).mean(0)
    return w, b


def indicators(rows: list[tuple[set[str], int]], names: list[str]) -> np.ndarray:
    place, x = {g: i for i, g in enumerate(names)}, np.zeros((len(rows), len(names)))
    for i, (grams, _) in enumerate(rows):
        x[i, [place[g] for g in grams if g in place]] = 1
    return x


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights of each n-gram by family, and the biases, over a temperature: the one that fits every ``HELD_OUT``-th phrase of a family best when a model of the others judges it."""
    rng = random.Random(17)
    fit, held = [], []
    for k, family in enumerate(FAMILIES):
        for i, phrase in enumerate(PHRASES[family]):
            (held if i % HELD_OUT == HELD_OUT - 1 else fit).extend((cued(ngrams(v)), k) for v in variants(tokens(phrase), rng))
    unknown = FAMILIES.index(UNKNOWN)
    fit += [({word}, unknown) for word in sorted(cues())]  # a cue word alone says nothing
    fit += [(set(), unknown)] * 10
    names = sorted(set().union(*(g for g, _ in fit + held)))
    w, b = fitted(fit, names)
    z, every, own = indicators(held, names) @ w + b, np.arange(len(held)), np.array([k for _, k in held])
    loss = {t: -np.log(np.maximum(softmax(z / t)[every, own], 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    best = min(loss, key=loss.get)
    w, b = fitted(fit + held, names)
    return {g: w[i] / best for i, g in enumerate(names) if np.abs(w[i]).max() > 1e-3}, b / best


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def templates() -> list[tuple[str, int, str, int]]:
    """(pair of words, number of the phrase, family, pairs in the phrase) of every licence phrase; one word of its own where there are no pairs."""
    out, number = [], 0
    for family in FAMILIES:
        for phrase in PHRASES[family] if family != UNKNOWN else ():
            words = tokens(phrase)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            out += [(p, number, family, len(pairs)) for p in pairs]
            number += 1
    return out


def cue_pattern() -> str:
    """Cue words in any case; MIT in capitals only, for it is a common word of German prose, and alone it says nothing."""
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(cues() - {"mit"}, key=lambda w: (-len(w), w))) + "|(?-i:MIT))(?![a-z0-9])"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, families (confirmed ones, joined by comma), n_license (confirmed families of all paragraphs), n_unconfirmed, family, probability and coverage of the surest piece."""
    spark = docs.sparkSession
    weights, bias = trained()
    k = len(FAMILIES)
    pairs: dict[str, list] = {}
    sizes, families = {}, {}
    for pair, number, family, size in templates():
        pairs.setdefault(pair, []).append(number)
        sizes[number], families[number] = size, family
    size_of, family_of = (F.array(*[F.lit(of[i]) for i in range(len(of))]) for of in (sizes, families))
    entries = [{"gram": g, "weight": [float(v) for v in weights[g]] if g in weights else None, "phrases": pairs.get(g)} for g in sorted({*weights, *pairs})]
    kind = "array<struct<gram: string, weight: array<double>, phrases: array<int>>>"
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(entries)), kind)))  # some hundred rows, from this file alone

    cue = cue_pattern()
    told = lambda x: x.rlike(cue)
    paragraphs = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), PARTING), told)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), paragraphs.alias("paragraphs"))
    rows = rows.select("row", "id", F.posexplode_outer("paragraphs").alias("paragraph", "text"))
    folded = F.regexp_replace("text", r"[\x20\t-\r]+", " ")
    pieces = F.filter(F.array_union(F.split("text", "\n"), F.split(folded, SENTENCE)), told)
    rows = rows.select("row", "id", "paragraph", F.posexplode_outer(pieces).alias("piece", "text"))
    rows = rows.select("row", "id", "paragraph", "piece", F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0)).alias("words"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - STEP), F.lit(1)), F.lit(STEP))
    rows = rows.select("row", "id", "paragraph", "piece", "words", F.explode_outer(F.when(F.size("words") > 0, begins)).alias("begin"))
    rows = rows.select("row", "id", "paragraph", "piece", "begin", F.slice("words", F.col("begin"), F.lit(WINDOW)).alias("words"))
    grams = F.when(F.size("words") > 0, F.array_union(F.col("words"), F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))))
    rows = rows.select("row", "id", "paragraph", "piece", "begin", F.explode_outer(grams).alias("gram"))
    met = rows.join(F.broadcast(known), "gram", "left")
    # one row per window: sums of weights by family, and how much of each phrase it holds
    unit = ["row", "id", "paragraph", "piece", "begin"]
    sums = [F.sum(F.coalesce(F.col("weight")[i], F.lit(0.0))).alias(f"w{i}") for i in range(k)]
    scored = met.groupBy(*unit).agg(*sums, F.flatten(F.collect_list("phrases")).alias("phrases"))  # numbers, at most one for each pair of each phrase of this file
    logits = F.array(*[F.col(f"w{i}") + F.lit(float(bias[i])) for i in range(k)])
    scored = scored.select(*unit, "phrases", logits.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("class", F.array_position("z", F.col("top")).cast("int") - 1)
    scored = scored.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("top"))))
    scored = scored.withColumn("family", F.when(F.col("probability") < LEAST_PROBABILITY, UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("class") + 1)))
    scored = scored.withColumn("own", F.filter("phrases", lambda p: F.element_at(family_of, p + 1) == F.col("family")))
    shares = F.transform(F.array_distinct("own"), lambda p: F.size(F.filter("own", lambda q: q == p)) / F.element_at(size_of, p + 1))
    scored = scored.withColumn("coverage", F.coalesce(F.array_max(shares), F.lit(0.0)))
    found = F.col("begin").isNotNull() & (F.col("family") != UNKNOWN)
    sure = found & (F.col("coverage") >= LEAST_SHARED)
    best = F.max(F.when(found, F.struct((F.col("coverage") >= LEAST_SHARED).alias("sure"), "probability", "coverage", "family")))
    hit = F.struct("paragraph", "family")
    out = scored.groupBy("row", "id").agg(F.collect_set(F.when(sure, hit)).alias("sure"), F.collect_set(F.when(found & ~sure, hit)).alias("unsure"), best.alias("best"))
    return out.select(
        F.col("id").alias(id_col), F.array_join(F.array_sort(F.array_distinct(F.col("sure.family"))), ",").alias("families"), F.size("sure").cast("bigint").alias("n_license"),
        F.size(F.array_except("unsure", "sure")).cast("bigint").alias("n_unconfirmed"), F.col("best.family").alias("family"), F.col("best.probability").alias("probability"), F.col("best.coverage").alias("coverage"),
    )
