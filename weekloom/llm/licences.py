"""Licence statements in documents, by a trained classifier of paragraphs.

A sparse logistic regression over hashed words and word pairs names the licence family of every
line. It learns from notices made out of templates and from lines of the corpus that resemble no
template; the probability below which a line is of no known family is calibrated on lines kept
from learning. A prediction stands only if the line also holds enough of a template of its family.

Notices are also wrapped, or stand inside long lines of prose. So stretches of a paragraph (lines up
to one without words) that hold enough of a template within twice its length are classified too,
whatever lines they lie on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.decontamination import ALNUM
from weekloom.llm.sampling import smallest_digests
from weekloom.llm.words import LOWER, Texts, blocks, joined, mixed, runs

BITS = 14
NEWLINE = 0x0A
#: Lines of the corpus that a model may learn from or be calibrated on, at most.
SAMPLE_LINES = 4000

# Common public notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0."),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0."),
    "cc0": (
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain.",
        "Released under CC0 1.0 Universal, public domain dedication."),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT"),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
FAMILIES = tuple(TEMPLATES)


class Paragraphs:
    """The lines of a block of texts and the hashes of their words (lower case, ASCII signs split)."""

    def __init__(self, texts: Texts):
        data = texts.mapped(LOWER).data
        ends = np.flatnonzero(data == NEWLINE)
        held = np.diff(texts.offsets) > 0
        sizes = np.diff(np.searchsorted(ends, texts.offsets)) + held
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.number = runs(sizes)
        bounds = np.append(0, np.sort(np.concatenate([ends, texts.offsets[1:][held]]), kind="stable"))
        low = Texts(data, bounds)
        starts, ends, self.first = low.words(ALNUM)
        self.words = low.hashes(starts, ends)

    def __len__(self) -> int:
        return len(self.number)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed words and pairs of words with the line of each."""
        of = np.repeat(np.arange(len(self)), np.diff(self.first))
        pairs = joined(self.words, 2)
        inside = of[1:] == of[:-1] if len(of) else np.zeros(0, dtype=bool)
        shift = np.uint64(64 - BITS)
        return (np.concatenate([mixed(self.words, 3) >> shift, pairs[inside] >> shift]).astype(np.int64),
                np.concatenate([of, of[:-1][inside]]))

    @classmethod
    def of_words(cls, pieces: list[np.ndarray]) -> "Paragraphs":
        """Pieces of words, as lines of one text."""
        out = cls.__new__(cls)
        out.text, out.number = np.zeros(len(pieces), dtype=np.int64), np.arange(len(pieces))
        out.first = np.cumsum([0, *map(len, pieces)])
        out.words = np.concatenate([np.zeros(0, dtype=np.uint64), *pieces])
        return out

    def paragraphs(self) -> np.ndarray:
        """Number of each line's paragraph: lines of one text without a line without words between."""
        blank = np.diff(self.first) == 0
        new = np.ones(len(self), dtype=bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | blank[1:] | blank[:-1]
        return np.cumsum(new)

    def stretches(self, confirmed: float) -> list[tuple[int, int, int, np.ndarray]]:
        """(family, first word, word after the last, template) of what holds enough of a template."""
        if len(self.words) < 2:
            return []
        of = np.repeat(self.paragraphs(), np.diff(self.first))
        pairs = joined(self.words, 2)
        at = np.searchsorted(ALL_PAIRS, pairs).clip(max=len(ALL_PAIRS) - 1)
        hits = np.flatnonzero((ALL_PAIRS[at] == pairs) & (of[1:] == of[:-1]))
        out = []
        for label, family in enumerate(FAMILIES):
            for template in SHINGLES[family]:
                mine = hits[np.isin(pairs[hits], template)]
                need = needed(len(template), confirmed)
                if len(mine) < need:
                    continue
                low, high = mine[:len(mine) - need + 1], mine[need - 1:]
                close = np.flatnonzero((high - low <= 2 * len(template)) & (of[low] == of[high]))
                # Overlapping stretches are one.
                ends = np.maximum.accumulate(high[close]) if len(close) else close
                cuts = np.flatnonzero(low[close][1:] > ends[:-1]) + 1
                for group in np.split(close, cuts) if len(close) else []:
                    a, b = int(low[group[0]]), int(high[group[-1]]) + 2
                    if holds(template, np.unique(pairs[a:b - 1]), confirmed):
                        out.append((label, a, b, template))
        return out

    def words_of(self, i: int) -> np.ndarray:
        return self.words[self.first[i]:self.first[i + 1]]


def shingles(words: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring words, or the only word."""
    return np.unique(joined(words, 2) if len(words) > 1 else words)


def hashed_words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return Paragraphs(Texts(raw, np.array([0, len(raw)]))).words


def template_share(words: np.ndarray, family: str | None = None) -> float:
    """Largest share of a template's word pairs that a line holds; a template of one or two pairs
    is held as a whole or not at all."""
    have = shingles(words)
    chosen = FAMILIES if family is None else (family,)
    shares = ((len(t), float(np.isin(t, have).mean())) for f in chosen for t in SHINGLES[f])
    return max(share if size > 2 else float(share == 1) for size, share in shares)


def needed(size: int, confirmed: float) -> int:
    """Pairs of a template of ``size`` pairs that confirm it; all of them if it has one or two."""
    return max(1, int(np.ceil(confirmed * size - 1e-9))) if size > 2 else size


def holds(template: np.ndarray, have: np.ndarray, confirmed: float) -> bool:
    return int(np.isin(template, have).sum()) >= needed(len(template), confirmed)


SHINGLES = {f: [shingles(hashed_words(t)) for t in texts] for f, texts in TEMPLATES.items()}
ALL_PAIRS = np.unique(np.concatenate([t for texts in SHINGLES.values() for t in texts]))
#: Words on each side of a stretch that the classifier sees with it.
AROUND = 3


@dataclass
class Model:
    """Weights of each feature and class (families, then none), biases, and the least probability
    at which a family is believed."""

    weights: np.ndarray
    bias: np.ndarray
    threshold: float

    def probabilities(self, paragraphs: Paragraphs) -> np.ndarray:
        """Class probabilities of each line; a line's features count by their share."""
        which, line = paragraphs.features()
        order = np.argsort(line, kind="stable")
        which, line = which[order], line[order]
        sizes = np.bincount(line, minlength=len(paragraphs))
        logits = np.tile(self.bias, (len(paragraphs), 1))
        held = np.flatnonzero(sizes)
        if len(held):
            begin = np.cumsum(sizes)[held] - sizes[held]
            logits[held] += np.add.reduceat(self.weights[which], begin, axis=0) / np.sqrt(sizes[held])[:, None]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def notices(random: np.random.Generator, filler: list[str], each: int) -> list[tuple[str, int]]:
    """Variations of the templates: words lost, filler before and after."""
    out = []
    for label, family in enumerate(FAMILIES):
        for _ in range(each):
            words = TEMPLATES[family][random.integers(len(TEMPLATES[family]))].split()
            words = [w for w in words if random.random() > 0.05] or words
            if filler and random.random() < 0.5:
                line = filler[random.integers(len(filler))].split()[:random.integers(1, 30)]
                words = line + words if random.random() < 0.5 else words + line
            out.append((" ".join(words), label))
    return out


def fit(lines: list[str], each: int = 120, epochs: int = 12, rate: float = 1.0, seed: int = 11) -> Model:
    """Learn from notices and ``lines`` of the corpus; every fifth line calibrates the threshold."""
    random = np.random.default_rng(seed)
    unknown = [t for t in lines if template_share(hashed_words(t)) < 0.4]
    apart, learned = unknown[::5], [t for i, t in enumerate(unknown) if i % 5]
    none = len(FAMILIES)
    rows = notices(random, learned, each) + [(t, none) for t in learned]
    encoded = [Paragraphs(_texts([t])) for t, _ in rows]
    labels = np.array([k for _, k in rows])
    weights = np.zeros((1 << BITS, none + 1))
    had = np.full((1 << BITS, none + 1), 1e-6)
    bias = np.zeros(none + 1)
    features = [p.features()[0] for p in encoded]
    for epoch in range(epochs):
        order = random.permutation(len(rows))
        for low in range(0, len(order), 32):
            for i in order[low:low + 32]:
                which = features[i]
                scale = 1 / np.sqrt(max(len(which), 1))
                logits = bias + weights[which].sum(axis=0) * scale
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[labels[i]] -= 1
                once = np.unique(which)
                had[once] += np.square(error * scale)
                weights[once] -= rate * 0.1 * error * scale / np.sqrt(had[once]) + 1e-5 * weights[once]
                bias -= rate * 0.01 * error
    model = Model(weights, bias, 0.5)
    # A line of no family passes at most once in a thousand.
    wrong = model.probabilities(Paragraphs(_texts(apart)))[:, :none].max(axis=1) if apart else np.zeros(1)
    model.threshold = float(min(0.99, max(0.5, np.quantile(wrong, 0.999))))
    return model


def _texts(rows: list[str]) -> Texts:
    raw = [r.encode("utf-8", "surrogatepass") for r in rows]
    return Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))


def sampled_lines(docs: DataFrame, key: str, text: str, n: int) -> list[str]:
    """At most ``n`` lines, one of each document with a small digest of its key, cut at 2000 characters."""
    lines = F.split("text", "\n")
    place = F.pmod(F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))), F.size(lines)).cast("int")
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    drawn = smallest_digests(held.select("key", F.substring(F.get(lines, place), 1, 2000).alias("line")), "key", n)
    rows = drawn.where(F.length("line") > 0).collect()
    return [r.line for r in sorted(rows, key=lambda r: (r.key is not None, r.key, r.line))]


def found_notices(lines: Paragraphs, model: Model, confirmed: float) -> list[tuple[int, int, str]]:
    """(first line, last line, family) of all notices, in order; lines count through the block."""
    odds = model.probabilities(lines)
    label, sure = odds.argmax(axis=1), odds.max(axis=1)
    single = {(int(i), FAMILIES[label[i]]) for i in np.flatnonzero((label < len(FAMILIES)) & (sure >= model.threshold))
              if template_share(lines.words_of(i), FAMILIES[label[i]]) >= confirmed}
    stretches = lines.stretches(confirmed)
    of = np.repeat(np.arange(len(lines)), np.diff(lines.first))
    part = lines.paragraphs()
    pieces = []
    for _, a, b, _ in stretches:
        # The paragraph's lines, and its words.
        first, last = np.searchsorted(part, part[of[a]], "left"), np.searchsorted(part, part[of[a]], "right")
        pieces.append(lines.words[max(a - AROUND, lines.first[first]):min(b + AROUND, lines.first[last])])
    odds = model.probabilities(Paragraphs.of_words(pieces))
    spans: list[tuple[int, int, str]] = []
    for (k, a, b, template), row in zip(stretches, odds, strict=True):
        if row.argmax() == k and row[k] >= model.threshold:
            low, high, family = int(of[a]), int(of[b - 1]), FAMILIES[k]
            # Lines that are notices each by themselves stay so, unless they hold more together.
            apart = all((i, family) in single for i in range(low, high + 1))
            if not apart or np.isin(template, shingles(lines.words[a:b])).sum() > max(
                    np.isin(template, shingles(lines.words_of(i))).sum() for i in range(low, high + 1)):
                spans.append((low, high, family))
    out: list[tuple[int, int, str]] = []
    for low, high, family in sorted(spans, key=lambda x: (x[2], x[0], x[1])):
        if out and out[-1][2] == family and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]), family)
        else:
            out.append((low, high, family))
    covered = {(i, family) for low, high, family in out for i in range(low, high + 1)}
    return sorted(out + [(i, i, family) for i, family in single - covered])


def licence_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", confirmed: float = 0.5,
                 sample: int = SAMPLE_LINES, model: Model | None = None) -> DataFrame:
    """Per document: key, n_lines, n_notices, families (sorted, comma-joined) and places (numbers,
    from 0, of the lines that notices cover; one that is wrapped covers several).

    Null and empty texts have no lines; repeated rows each get a row; an empty table gives none;
    other columns are ignored. The model, unless given, learns from at most ``sample`` lines.
    """
    if model is None:
        model = fit(sampled_lines(docs, key, text, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in blocks(batches, "text", 1 << 20):
            lines = Paragraphs(texts)
            found: list[list[str]] = [[] for _ in range(len(texts))]
            places: list[set[int]] = [set() for _ in range(len(texts))]
            for low, high, family in found_notices(lines, model, confirmed):
                found[lines.text[low]].append(family)
                places[lines.text[low]].update(lines.number[low:high + 1].tolist())
            yield pa.RecordBatch.from_arrays([
                part["key"], pa.array(np.bincount(lines.text, minlength=len(texts)).astype(np.int64)),
                pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted(set(f))) for f in found]),
                pa.array([sorted(n) for n in places], pa.list_(pa.int32()))],
                ["key", "n_lines", "n_notices", "families", "places"])

    return frame.mapInArrow(scan, "key long, n_lines long, n_notices long, families string, places array<int>").withColumnRenamed("key", key)
