"""Licence notices by a trained paragraph classifier.

A paragraph is a line of a document. It is read in half-overlapping windows of ``SCALES`` words, or as a whole where it is shorter than a scale. The features of a window are
the word 1- to 3-grams that begin in it, hashed. A softmax regression over these sparse features gives each window a
probability for each licence family and for ``unknown``. It is trained here: on variations of
the templates below (words dropped and exchanged, cut out, put among words of the corpus) and, for unknown, on windows of a bounded sample of corpus lines and on
distractors. The threshold is calibrated: the lowest probability at which no held-out corpus window
and no held-out distractor is taken for a licence.

The classifier proposes: every window of every document is scored, and one at the threshold proposes the families that have ``PROPOSED`` of its licence probability or
more. A template confirms: the proposal counts if at least ``CONFIRM`` of the word pairs of a template of a proposed family stand in the line within
``REACH`` words around the window; of several proposed families the one most alike. What the classifier doesn't propose is no result, and neither is what no template confirms.
Scores are sums over places, so a line costs the same a word whatever its length.

Cases: null and empty documents have no paragraphs. Repeated rows give repeated results. A paragraph gives a row for each notice in it, the
most similar first: its word pairs are taken by it, and what another notice is confirmed by must stand elsewhere. A null id is carried along. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from .common import slices, small_batches

GAP = 4
UNKNOWN = "unknown"
#: Short notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GNU GPL version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": ("Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "cc0": ("This work is dedicated to the public domain.", "Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "proprietary": ("All rights reserved.", "Copyright (c) 2020 Example Corporation. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
#: Lines that speak of licences and rights without granting anything.
DISTRACTORS = ("The driver's license was released under police protection.", "Her licence to teach was renewed for the second time.", "All rights and duties under this rule were explained to the public.", "The general public was free to use the software library.", "He was granted permission to leave the building, free of charge.", "The version of the story that was published last year.", "This work is the subject of a long and public debate.", "You may not use the pool except in the evening.", "They reserved all the rooms on the right side.", "The common attribution of this work to the master is disputed.", "A license was required under the act, version of record.", "The source of the form is public; the terms are not.", "Copyright law is a subject of its own.", "The commons were open to creative people of the region.", "Conditions are met in the following forms of use.")
CLASSES = (UNKNOWN, *TEMPLATES)
FEATURES, SCALES, REACH, CONFIRM, PROPOSED = 18, (12, 24, 48), 48, 0.6, 0.05
#: Words that notices exchange for one another.
EXCHANGED = (("license", "licence"), ("licensed", "released", "distributed", "published", "available"), ("software", "program", "library", "work", "project", "code"), ("version", "v", "v."), ("under", "under"), ("terms", "conditions"), ("file", "work"))


def places(words: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(3, words): feature of the 1- to 3-gram that begins at each word, and whether it ends within the word's line; ``end`` is the end of that line."""
    column, inside = np.zeros((3, len(words)), np.int64), np.zeros((3, len(words)), bool)
    for n in (1, 2, 3):
        g = grams.rolled(words, n)
        column[n - 1, : len(g)] = (g >> grams.U(64 - FEATURES)).astype(np.int64)
        inside[n - 1] = np.arange(len(words)) + n <= end
    return column, inside


def windows(first: np.ndarray) -> np.ndarray:
    """(line, begin, end) of all windows; ``first`` has the first word of each line and the number of words."""
    lo, size = first[:-1], np.diff(first)
    out, whole = [], np.zeros(len(lo), bool)
    for scale in SCALES:
        once = np.flatnonzero((size > 0) & (size <= scale) & ~whole)
        whole[once] = True
        out.append(np.stack([once, lo[once], lo[once] + size[once]], 1))
        long = np.flatnonzero(size > scale)
        step = scale // 2
        # the last window reaches the end of the line
        count = -(-(size[long] - scale) // step) + 1
        line = np.repeat(long, count)
        begin = lo[line] + (np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)) * step
        out.append(np.stack([line, begin, np.minimum(begin + scale, lo[line] + size[line])], 1))
    return np.concatenate(out)


class Templates:
    """The word pairs (of one word: the word) of all templates."""

    def __init__(self):
        self.pairs: list[tuple[str, np.ndarray]] = []
        for family, texts in TEMPLATES.items():
            for t in texts:
                w = grams.Words([t], bare=True).hashes
                self.pairs.append((family, np.unique(grams.rolled(w, min(2, len(w))))))
        self.all = np.unique(np.concatenate([p for _, p in self.pairs]))
        self.has = np.zeros((len(self.pairs), len(self.all)), np.float32)
        for k, (_, p) in enumerate(self.pairs):
            self.has[k, np.searchsorted(self.all, p)] = 1 / len(p)

    def similarity(self, words: np.ndarray, free: np.ndarray | slice = slice(None)) -> dict[str, float]:
        """Family -> best share of a template's pairs that stand in the words, at the ``free`` places."""
        own = grams.rolled(words, 2)[free]
        at = np.minimum(np.searchsorted(self.all, own), len(self.all) - 1)
        found = np.zeros(len(self.all), np.float32)
        found[at[self.all[at] == own]] = 1
        out: dict[str, float] = {}
        for (family, _), share in zip(self.pairs, (self.has @ found).tolist()):
            out[family] = max(share, out.get(family, 0.0))
        return out

    def notice(self, words: np.ndarray, free: np.ndarray, family: str, lo: int, hi: int) -> tuple[int, int]:
        """First and end place of the pairs of the family's templates around those of the best one from ``lo`` to ``hi``, without gaps of more than ``GAP`` places."""
        own = grams.rolled(words, 2)
        best = max((p for f, p in self.pairs if f == family), key=lambda p: np.isin(p, own[lo:hi][free[lo:hi]]).mean())
        places = np.flatnonzero(np.isin(own, np.concatenate([p for f, p in self.pairs if f == family])) & free)
        runs = np.split(places, np.flatnonzero(np.diff(places) > GAP) + 1)
        run = max(runs, key=lambda r: int(np.isin(best, own[r[(r >= lo) & (r < hi)]]).sum()))
        return int(run[0]), int(run[-1]) + 1


class Classifier:
    def __init__(self):
        self.weights = np.zeros((1 << FEATURES, len(CLASSES)), np.float32)
        self.bias = np.zeros(len(CLASSES), np.float32)
        self.threshold = 0.5

    def probabilities(self, words: grams.Words, spans: np.ndarray) -> np.ndarray:
        """(windows, classes): a window's weights are differences of sums over the places of all lines."""
        n = len(words.hashes)
        column, inside = places(words.hashes, np.repeat(words.first[1:], np.diff(words.first)))
        total = np.zeros((n + 1, len(CLASSES) + 1))
        for c, ok in zip(column, inside):
            total[1:, :-1] += self.weights[c] * ok[:, None]
            total[1:, -1] += ok
        np.cumsum(total, axis=0, out=total)
        own = total[spans[:, 2]] - total[spans[:, 1]]
        z = own[:, :-1] / np.sqrt(np.maximum(own[:, -1:], 1)) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> None:
        """Adagrad over one window at a time; a row has the features of a window, as often as they occur."""
        squares = np.full((1 << FEATURES, len(CLASSES)), 1e-3, np.float32)
        order = np.random.default_rng(seed)
        counted = [(*np.unique(c, return_counts=True), 1 / np.sqrt(max(len(c), 1))) for c in rows]
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                c, times, scale = counted[i]
                z = times @ self.weights[c] * scale + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                g = (times * scale)[:, None] * p
                squares[c] += g * g
                self.weights[c] -= rate * g / np.sqrt(squares[c]) + 1e-6 * self.weights[c]
                self.bias -= 0.01 * p


def _varied(rng: np.random.Generator, lines: list[str], each: int) -> tuple[list[str], list[int]]:
    """Variations of templates and distractors, as texts of one window."""
    texts, labels = [], []
    pool = [w for line in lines for w in line.split()] or ["word"]
    around = lambda most: [pool[i] for i in rng.integers(0, len(pool), rng.integers(0, most + 1))]
    swap = {w: group for group in EXCHANGED for w in group}
    sources = [(CLASSES.index(f), t) for f, ts in TEMPLATES.items() for t in ts] + [(0, t) for t in DISTRACTORS]
    for label, text in sources:
        for k in range(each):
            words = text.split()
            if k:
                words = [str(rng.choice(swap[w.lower()])) if w.lower() in swap and rng.random() < 0.15 else w for w in words]
                if len(words) > 6 and rng.random() < 0.3:
                    del words[int(rng.integers(0, len(words)))]
                scale = int(rng.choice(SCALES))
                if len(words) > scale:
                    at = int(rng.integers(0, len(words) - scale + 1))
                    words = words[at : at + scale]
                room = scale - len(words)
                before = around(room) if rng.random() < 0.6 else []
                words = before + words + (around(room - len(before)) if rng.random() < 0.6 else [])
            t = " ".join(words)
            texts.append(t.upper() if rng.random() < 0.1 else t.lower() if rng.random() < 0.1 else t)
            labels.append(label)
    return texts, labels


def train(docs: DataFrame, *, id: str = "doc_id", text: str = "text", sample: int = 300, each: int = 12, seed: int = 9) -> Classifier:
    """Fits on template variations and on windows of lines of about ``sample`` documents, chosen by a hash of the id, a documented bound.

    The driver gets at most 400 lines of each, by hash, and of a line 4,800 characters, so the bound holds in bytes, too; ``20 * sample`` of them are used. Lines that a template confirms
    are not used as ``unknown``. A quarter of both is held out for the threshold.
    """
    rows = docs.select(F.xxhash64(F.col(id).cast("string")).alias("h"), F.col(text).alias("text")).where("text is not null")
    # a share by hash: no partition sends more than its own part of the sample
    chosen = rows.where(F.col("h") / F.lit(float(2**64)) + 0.5 < sample / max(1, rows.count()))
    mixed = F.sort_array(F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, 4800).alias("line"))))
    lines = sorted({x.line for r in chosen.select(F.slice(mixed, 1, 400).alias("lines")).collect() for x in r.lines if x.line.strip()})
    templates = Templates()
    rng = np.random.default_rng(seed)
    lines = [lines[i] for i in rng.permutation(len(lines))[: 20 * sample]]
    plain = [x for x in lines if max(templates.similarity(grams.Words([x], bare=True).hashes).values(), default=0) < CONFIRM]
    texts, labels = _varied(rng, plain, each)
    for x in plain:
        own = x.split()
        size = min(len(own), int(rng.choice(SCALES)))
        at = int(rng.integers(0, len(own) - size + 1))
        texts.append(" ".join(own[at : at + size]))
    labels = np.array(labels + [0] * len(plain))
    words = grams.Words(texts, bare=True)
    column, inside = places(words.hashes, np.repeat(words.first[1:], np.diff(words.first)))
    rows = [column[:, a:b][inside[:, a:b]] for a, b in zip(words.first[:-1], words.first[1:])]
    held = rng.random(len(rows)) < 0.25
    model = Classifier()
    fit = np.flatnonzero(~held)
    model.fit([rows[i] for i in fit], labels[fit])
    whole = np.stack([np.arange(len(texts)), words.first[:-1], words.first[1:]], 1)
    out = held & (labels == 0) & (np.diff(words.first) > 0)
    wrong = 1 - model.probabilities(words, whole[out])[:, 0]
    model.threshold = float(min(0.95, max(0.5, wrong.max(initial=0.0) + 0.02)))
    return model


FOUND = [T.StructField("paragraph", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())]


def proposals(words: grams.Words, model: Classifier) -> list[tuple[int, int, int, float, tuple[str, ...]]]:
    """(line, begin, end, licence probability, families) of the windows that the classifier takes for licences, by line and begin."""
    spans = windows(words.first)
    p = model.probabilities(words, spans)
    licence = 1 - p[:, 0]
    hit = np.flatnonzero(licence >= model.threshold)
    hit = hit[np.lexsort((spans[hit, 2], spans[hit, 1]))]
    return [(*map(int, spans[i]), float(licence[i]), tuple(f for f, x in zip(CLASSES[1:], p[i, 1:]) if x >= PROPOSED * licence[i])) for i in hit]


def confirmed(words: np.ndarray, first: int, end: int, proposed: list[tuple[int, int, float, tuple[str, ...]]], templates: Templates) -> list[tuple[int, str, float, float]]:
    """(first word, family, probability, similarity) of the notices of the line from ``first`` to ``end`` that proposals name and templates confirm."""
    free = np.ones(end - first, bool)
    spans = [(max(first, a - REACH), min(end, b + REACH)) for a, b, _, _ in proposed]

    def judged(i: int) -> tuple[float, str]:
        lo, hi = spans[i]
        alike = templates.similarity(words[lo:hi], free[lo - first : hi - first - 1]) if hi - lo > 1 else {}
        return max(((alike.get(f, 0.0), f) for f in proposed[i][3]), default=(0.0, ""))

    best = [judged(i) for i in range(len(proposed))]
    found = []
    while True:
        i = max(range(len(proposed)), key=lambda i: (best[i][0], proposed[i][2], -i), default=None)
        if i is None or best[i][0] < CONFIRM - 1e-6:
            return found
        (share, family), (a, b, p, _), (lo, hi) = best[i], proposed[i], spans[i]
        at, to = templates.notice(words[lo:hi], free[lo - first : hi - first - 1], family, a - lo, max(a + 1, b - 1) - lo)
        found.append((lo + at - first, family, p, share))
        free[lo + at - first : lo + to - first] = False
        for k, (c, d) in enumerate(spans):
            if c < lo + to and lo + at < d:
                best[k] = judged(k)


def paragraphs(texts: list[str], model: Classifier, templates: Templates) -> list[tuple[int, int, int, str, float, float]]:
    """(text, paragraph, first word, family, probability, similarity) of the notices in texts."""
    split = [t.split("\n") for t in texts]
    owner = [(i, k) for i, parts in enumerate(split) for k in range(len(parts))]
    words = grams.Words([line for parts in split for line in parts], bare=True)
    if len(words.hashes) < 2:
        return []
    lines: dict[int, list] = {}
    for k, *rest in proposals(words, model):
        lines.setdefault(k, []).append(tuple(rest))
    return [(*owner[k], *x) for k, proposed in sorted(lines.items()) for x in confirmed(words.hashes, int(words.first[k]), int(words.first[k + 1]), proposed, templates)]


def scan(docs: DataFrame, model: Classifier, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, paragraph, first_word, family, probability, similarity) of the licence notices in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), *FOUND])

    def run(batches):
        templates = Templates()
        for batch in batches:
            ids = batch.column(0)
            for start, texts in slices(batch, "__text", 1_000_000):
                found = paragraphs(texts, shared.value, templates)
                cols = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([start + i for i in cols[0]], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.float64()), pa.array(cols[5], pa.float64())], names=[id, "paragraph", "first_word", "family", "probability", "similarity"])

    return small_batches(docs).select(F.col(id), F.col(text).alias("__text")).mapInArrow(run, schema)
