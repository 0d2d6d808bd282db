"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a run of adjacent lines, none of them blank, that each hold a word of some licence's notice; so a notice
wrapped over several lines is one paragraph, and a notice between lines of prose is one of its own. Its features are the
word n-grams (one and two words, lower-cased, outer punctuation removed) that also occur in the notices below and hold
at least one word that is not a stop word. A softmax regression with an L1 penalty, so that few weights remain, scores
the licence families, the class ``unknown`` (some licence, of none of these families) and the class ``none``.

``unknown`` is trained on notices of other licences, and on the families' notices with their own words replaced; its
temperature is set on notices of licences that the training has not seen, together with held-out variants of the
families' notices, so that probabilities are calibrated for licences never met. A predicted family is confirmed if one
of its notices has at least half of its words in the paragraph; an unconfirmed or unsure one is ``unknown``.

The training also takes paragraphs of at most ``sample`` documents (those whose hashes are lowest) that name no licence.
Every line of every text is scanned.
"""

from __future__ import annotations

import random
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Notices by which texts name their licence.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "SPDX-License-Identifier: MIT", "Licensed under the MIT license", "The MIT License (MIT)"],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "Dedicated to the public domain under CC0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission of the publisher.", "Proprietary and confidential."],
}
#: Lines with such words that name no licence.
NOT_LICENCES = ["A driving license is required for this position.", "The software version is shown on the first page.", "Copyright law differs from country to country.", "You may use this file to test the program.", "He studied at MIT and works for a foundation.", "The apache helicopter is used by many countries.", "Permission to enter is granted by the owner.", "The terms of the agreement are published every year.", "Free of charge for any person under twelve.", "This work is a copy of an older work.", "The public library holds source code in binary forms.", "Fishing license fees are due in March."]
#: Notices of other licences, from which the class unknown is trained.
OTHERS = ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0.", "Licensed under the Microsoft Public License.", "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose and to alter it and redistribute it freely.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "This package is distributed under the Artistic License 2.0.", "The contents of this file are subject to the terms of the Common Development and Distribution License.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Use of this software is governed by the Business Source License.", "Released under the PostgreSQL License.", "Licensed under the Python Software Foundation License, version 2.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib", "This work is released into the public domain by its author.", "Distributed under the terms of the PHP License, version 3.01.", "See the file COPYING for the license terms of this program."]
#: Notices of licences that only the calibration sees.
UNSEEN = ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Open Software License version 3.0.", "Licensed under the Academic Free License version 3.0.", "Released under the Q Public License.", "Licensed under the Server Side Public License, version 1.", "SPDX-License-Identifier: OSL-3.0", "Licensed under the Universal Permissive License v 1.0.", "This file is distributed under the terms of the Sleepycat License."]
STOP = frozenset("a an and any are as at be by for from in is it its may no not of on or other part that the this to under was were which with without you your".split())
NONE, UNKNOWN = "none", "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN, NONE)
EDGES = "\"'.,;:!?()[]{}<>"


def clean_words(line: str) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in line.lower().split()) if w]


def ngrams(words: list[str]) -> set[str]:
    two = {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in STOP or b not in STOP}
    return {w for w in words if w not in STOP} | two


def _notices() -> list[str]:
    return [t for texts in TEMPLATES.values() for t in texts] + OTHERS


def fit(negatives: list[str], rounds: int = 400, rate: float = 0.5, l1: float = 2e-4, seed: int = 7) -> dict[str, list[float]]:
    """Weights of n-grams (and of the bias, "") by family, divided by the temperature.

    negatives: paragraphs of other text; those that are equal to a notice or hold one are left out.
    """
    rng = random.Random(seed)
    own = {" ".join(clean_words(t)) for t in _notices()}
    negatives = [n for n in negatives if not any(f" {t} " in f" {' '.join(clean_words(n))} " for t in own)]
    filler = [w for n in negatives for w in clean_words(n) if w not in STOP] or ["lorem", "ipsum", "dolor"]
    shared = Counter(w for texts in [*TEMPLATES.values(), OTHERS] for w in {w for t in texts for w in clean_words(t)})
    rows: list[tuple[list[str], int]] = []
    held: list[bool] = []

    def variants(texts: list[str], k: int, n: int, replaced: bool = False, all_held: bool = False) -> None:
        for t in texts:
            for v in range(n):
                w = clean_words(t)
                if replaced:  # another licence's notice in the same words
                    w = [x if shared[x] > 1 else rng.choice(filler) for x in w]
                if v % 2 and len(w) > 5:
                    del w[rng.randrange(len(w))]
                if v > 1:
                    w = rng.choices(filler, k=rng.randrange(6)) + w + rng.choices(filler, k=rng.randrange(6))
                rows.append((w, k))
                held.append(all_held or v % 4 == 3)

    for k, texts in enumerate(TEMPLATES.values()):
        variants(texts, k, 8)
        variants([t for t in texts if len({x for x in clean_words(t) if shared[x] > 1} - STOP) > 1], len(TEMPLATES), 4, replaced=True)
    variants(OTHERS, len(TEMPLATES), 8)
    variants(UNSEEN, len(TEMPLATES), 4, all_held=True)
    for r, n in enumerate(NOT_LICENCES * 4 + negatives):
        rows.append((clean_words(n), len(TEMPLATES) + 1))
        held.append(r % 4 == 3)
    grams = sorted({g for t in _notices() for g in ngrams(clean_words(t))})
    at = {g: i + 1 for i, g in enumerate(grams)}
    x, y, test = np.zeros((len(rows), len(grams) + 1)), np.array([k for _, k in rows]), np.array(held)
    x[:, 0] = 1
    for r, (w, _) in enumerate(rows):
        x[r, [at[g] for g in ngrams(w) if g in at]] = 1
    weight = 1 / np.bincount(y, minlength=len(FAMILIES))[y] + 1 / len(rows)
    goal = np.eye(len(FAMILIES))[y]

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    w, (xs, gs, ws) = np.zeros((x.shape[1], len(FAMILIES))), (x[~test], goal[~test], weight[~test][:, None] / weight[~test].sum())
    for _ in range(rounds):
        w += rate * 4 * xs.T @ ((gs - soft(xs @ w)) * ws)
        w[1:] = np.sign(w[1:]) * np.maximum(0, np.abs(w[1:]) - rate * l1)
    z = x[test] @ w
    loss = {t: -np.log(np.maximum(1e-12, soft(z / t)[np.arange(len(z)), y[test]])).mean() for t in (0.1, 0.15, 0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    w /= min(loss, key=loss.get)
    return {"": w[0].tolist()} | {g: w[i].tolist() for g, i in at.items() if np.abs(w[i]).max() > 1e-6}


def sample_lines(docs: DataFrame, sample: int = 200, lines: int = 20) -> list[str]:
    """The first lines of at most so many documents (bounds of the training): its examples of other text.

    Documents are ranked by hash alone; only those chosen send texts to the driver, and equal rows count once.
    """
    keyed = docs.filter("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    few = keyed.select("h").distinct().orderBy("h").limit(sample)
    rows = keyed.join(F.broadcast(few), "h").dropDuplicates(["h"]).select("h", F.slice(F.split("text", "\n"), 1, lines).alias("lines")).collect()
    return [x for r in sorted(rows, key=lambda r: r.h) for x in r.lines if x.strip()]


def _words(line: Column) -> Column:
    """clean_words() as a column."""
    trimmed = F.transform(F.split(F.lower(line), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES)))
    return F.filter(trimmed, lambda w: w != "")


def paragraphs(docs: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, row (hash of the text), paragraph (number of its first line), words.

    Lines without a word of ``known`` go first; only the few others are shuffled, and those of a text that follow one
    another are a paragraph (a blank line has no word, so it parts them). Repeated rows give theirs once.
    """
    single = F.array(*map(F.lit, known))
    # posexplode_outer, as the filter that Spark infers for posexplode repeats the expression below it
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    lines = keyed.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("line", "words"))
    kept = lines.withColumn("words", _words(F.col("words"))).filter(F.arrays_overlap("words", single))
    island = F.col("line") - F.dense_rank().over(Window.partitionBy("doc_id", "row").orderBy("line"))
    runs = kept.withColumn("island", island).groupBy("doc_id", "row", "island").agg(F.min("line").cast("long").alias("paragraph"), F.sort_array(F.collect_set(F.struct("line", "words"))).alias("l"))
    return runs.select("doc_id", "row", "paragraph", F.flatten("l.words").alias("words"))


def scan(docs: DataFrame, weights: dict[str, list[float]], sure: float = 0.5, alike: float = 0.5) -> DataFrame:
    """documents -> one row for each paragraph that names a licence: doc_id, paragraph, family, probability, similarity.

    paragraph is the number of its first line, from 0; family is one of TEMPLATES or ``unknown`` (some licence, of no
    family here, or unconfirmed, or unsure). Null and empty texts have no findings; repeated rows give one, different
    texts under one doc_id (or none) are scanned each; of equally probable families the first listed is taken; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = sorted({w for t in _notices() for w in clean_words(t) if w not in STOP})
    kept = paragraphs(docs, known)
    two = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))).otherwise(F.array().cast("array<string>"))
    grams = kept.select("doc_id", "row", "paragraph", "words", F.array_distinct(F.concat("words", two)).alias("grams"))
    # as many rows as the notices have n-grams
    table = spark.createDataFrame([(g, w) for g, w in weights.items() if g], "gram string, w array<double>")
    hit = grams.select("doc_id", "row", "paragraph", "words", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    # repeated rows meet here: each n-gram counts once
    one = hit.groupBy("doc_id", "row", "paragraph").agg(F.first("words").alias("words"), F.collect_set(F.struct("gram", "w")).alias("g"))
    added = lambda i: lambda s, x: s + F.get(x["w"], i)
    z = F.array(*[F.aggregate("g", F.lit(b), added(i)) for i, b in enumerate(weights[""])])
    scored = one.select("doc_id", "paragraph", "words", z.alias("z"))
    exp = scored.select("doc_id", "paragraph", "words", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    best = F.array_position("e", F.array_max("e"))
    share = exp.select("doc_id", "paragraph", "words", (F.get("e", (best - 1).cast("int")) / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("probability"), F.get(F.array(*map(F.lit, FAMILIES)), (best - 1).cast("int")).alias("family")).filter(F.col("family") != NONE)
    alikes = reduce(lambda rest, f: F.when(F.col("family") == f, _closest(f)).otherwise(rest), TEMPLATES, F.lit(0.0))
    found = share.select("doc_id", "paragraph", "family", "probability", alikes.alias("similarity"))
    family = F.when((F.col("probability") >= sure) & (F.col("similarity") >= alike), F.col("family")).otherwise(UNKNOWN)
    return found.select("doc_id", "paragraph", family.alias("family"), "probability", "similarity")


def _closest(family: str) -> Column:
    """The greatest share of a template's distinct words that the line has."""
    return F.greatest(*[F.size(F.array_intersect("words", t)) / F.size(t) for t in (F.array(*map(F.lit, sorted(set(clean_words(x))))) for x in TEMPLATES[family])], F.lit(0.0))
