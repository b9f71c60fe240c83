"""Licence scan: a trained classifier of word windows, confirmed by templates.

A paragraph is a line with words, and these are counted and numbered. A notice may
be wrapped over several or stand inside a long one, so lines are joined (up to one
without words) and scored as overlapping windows of ``SIZES`` words, a quarter of a
window apart: any run of three quarters of a window is whole in one of them. The
features of a window are the hashes of its lower-cased words, word pairs and
triples; a logistic regression for each licence family gives the log-odds. They are
trained here, by follow-the-regularised-leader, on variants of the families' notices
(made by rule: words left out, cut off, filled up to a window with prose) and, as the
unknown class, on windows of a sample of the documents: ``sample_chars`` characters
from a hash-chosen place of each of ``sample_rows`` texts. The threshold of each family
and size is calibrated on samples and variants that were not learnt from: the least
one that no unknown window reaches and half of the way to the variants, but no more
than nine in ten of the variants that a template confirms reach. Below all thresholds
the class is ``unknown``.

A prediction counts only if a template confirms it: enough word pairs of one of the
family's notices must stand in the window, in order. Of findings whose words overlap,
the one with the larger share of pairs counts, then that with the larger odds; its
paragraph is the line of its first pair. Every word of every document is scored.

Defined results: null and empty texts have no paragraphs (empty lines are none)
and no licences. Rows are never dropped; repeated rows get equal results. Without
documents there is nothing to train on and the result is empty. Columns of the input
that are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

import bisect
import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ngram_model import Ftrl, sigmoid
from .words import HASH, Words, blocks, byte_class, mix, released

SLOTS = 1 << 16
SCALE = 8.0
SAMPLE_ROWS, SAMPLE_CHARS, EPOCHS = 2048, 2000, 6
#: Words of the windows; a notice is learnt in the least one of which it fills up to three quarters.
SIZES = (8, 16, 32, 64)
BLOCK_BYTES = 1 << 20
#: Share of a template's word pairs that must be found.
CONFIRM = 0.6

# Short notices of common licence families, in public use.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
FAMILIES = tuple(sorted(TEMPLATES))
#: ASCII but for letters, digits and the hyphen separates words.
_SEPARATORS = byte_class(bytes(x for x in range(128) if not (chr(x).isalnum() or chr(x) == "-")))
_WORD = re.compile(r"[^\x00-\x2C\x2E-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _paragraphs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines of the texts, and the text of each line."""
    cuts = np.union1d(np.flatnonzero(buf == 10) + 1, offsets)
    if not len(buf):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    return cuts, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def _joined(w: Words, owner: np.ndarray) -> Words:
    """The same words, with runs of lines of one text up to a line without words as the texts."""
    begins = np.ones(w.n_texts, bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (w.counts[:-1] == 0)
    out = copy.copy(w)
    out.first = np.append(w.first[:-1][begins], w.first[-1])
    out.n_texts, out.counts = len(out.first) - 1, np.diff(out.first)
    out.text = np.repeat(np.arange(out.n_texts), out.counts)
    return out


def _slots(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and triples: the slot of the gram that begins at each word, and whether there is one."""
    h = w.hashes()
    out = []
    for n in (1, 2, 3):
        grams = h if n == 1 else HASH.grams(h, n)
        out.append(((mix(grams + np.uint64(n)) >> np.uint64(48)).astype(np.int64), w.windows(n)[: len(grams)]))
    return out


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    each = _slots(w)
    return np.concatenate([x[ok] for x, ok in each]), np.concatenate([w.text[: len(x)][ok] for x, ok in each])


def _windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of each text, and the word after its last."""
    step = size // 4
    many = np.where(w.counts > 0, np.maximum(0, w.counts - size + step - 1) // step + 1, 0)
    text = np.repeat(np.arange(w.n_texts), many)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * step
    low = w.first[:-1][text] + np.minimum(place, np.maximum(0, w.counts[text] - size))
    return low, np.minimum(low + size, w.first[1:][text])


def _log_odds(w: Words, weights: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each set of windows, one row for each of them, one column for each family."""
    each, out = _slots(w), [np.zeros((len(low), len(weights))) for low, _ in bounds]
    for j, own in enumerate(weights):
        sums = []
        for slots, ok in each:
            total = np.zeros(len(w.starts) + 1)
            np.cumsum(np.where(ok, own[slots], 0.0), out=total[1 : len(slots) + 1])
            sums.append(total)
        for odds, (low, high) in zip(out, bounds, strict=True):
            found, count = np.zeros(len(low)), np.zeros(len(low), np.int64)
            for n, total in enumerate(sums):
                end = np.maximum(low, high - n)
                found += total[end] - total[low]
                count += end - low
            odds[:, j] = SCALE * found / np.maximum(1, count) + own[SLOTS]
    return out


def _whole(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(w.first[:-1], w.first[1:])]


def _of(texts: list[str]) -> Words:
    raw = [x.encode() for x in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64), _SEPARATORS, lower=True)


def _word_pairs(words: list[str]) -> list[tuple[str, str]]:
    found = [re.sub(r"\d+", "0", x.lower()) for x in words]
    return list(zip(found, found[1:]))


def _pairs(text: str) -> list[tuple[str, str]]:
    return _word_pairs(_WORD.findall(text))


_TEMPLATE_PAIRS = {family: [_pairs(x) for x in texts] for family, texts in TEMPLATES.items()}
_NOTICES = [(frozenset(x), len(x)) for notices in _TEMPLATE_PAIRS.values() for x in notices]


def aligned(own: list[tuple[str, str]], family: str) -> tuple[float, int, int]:
    """Largest share of a notice's word pairs that stand in ``own`` in order, and the places of the first and the last."""
    best, have = (0.0, 0, 0), set(own)
    for notice in _TEMPLATE_PAIRS[family]:
        if sum(x in have for x in notice) / len(notice) <= best[0]:
            continue
        # Most pairs in order up to each place, of these the latest beginning.
        row = [(0, -1)] * (len(own) + 1)
        for pair in notice:
            before, row = row, [(0, -1)]
            for k, x in enumerate(own):
                most = max(before[k + 1], row[k])
                if x == pair:
                    hits, first = before[k]
                    most = max(most, (hits + 1, first if hits else k))
                row.append(most)
        hits, first = row[-1]
        if hits / len(notice) > best[0]:
            best = (hits / len(notice), first, next(k for k, x in enumerate(row) if x[0] == hits) - 1)
    return best


def confirmed(paragraph: str, family: str) -> float:
    """Largest share of a notice's word pairs that stand in the paragraph, one after another."""
    return aligned(_pairs(paragraph), family)[0]


def _like_notice(line: str) -> bool:
    """Whether a line has so many pairs of a notice, in any order, that it can't stand for the unknown class."""
    own = set(_pairs(line))
    return any(len(notice & own) >= CONFIRM / 2 * n for notice, n in _NOTICES)


def _size(notice: str) -> int:
    return next(k for k, size in enumerate(SIZES) if 4 * len(_WORD.findall(notice)) <= 3 * size or size == SIZES[-1])


def _variants(text: str, prose: list[list[str]], seed: int, count: int) -> list[str]:
    """Forms of a notice, most of them with words left out and filled up with prose to at most a window."""
    rng = np.random.default_rng(seed)
    words, size, out = text.split(), SIZES[_size(text)], [text, text.lower(), text.upper()]
    while len(out) < count:
        keep = [x for x in words if rng.random() > 0.08]
        keep = keep[: max(3, int(len(keep) * rng.uniform(0.7, 1.3)))]
        around = prose[int(rng.integers(0, len(prose)))] if rng.random() > 0.2 else []
        at = int(rng.integers(0, len(around) + 1))
        around = around[at : at + int(rng.integers(0, max(1, size - len(_WORD.findall(" ".join(keep)))) + 1))]
        cut = int(rng.integers(0, len(around) + 1))
        out.append(" ".join([*around[:cut], *keep, *around[cut:]]))
    return out


def train_licences(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row for each family) and thresholds (a row for each size); the unknown class is learnt from a piece of at most sample_chars characters, from anywhere, of each of at most sample_rows texts."""
    known = docs.where("text is not null")
    order = F.xxhash64(F.lit("paragraph"), "text")
    place = F.pmod(F.xxhash64(F.lit("place"), "text"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int") + 1
    piece = F.substring("text", place, F.lit(sample_chars))
    rows = known.groupBy(F.pmod(F.xxhash64("text"), F.lit(sample_rows)).alias("class")).agg(F.min_by(piece, order).alias("text"))
    prose = []
    for r in rows.orderBy("class").toLocalIterator():
        own = " ".join(x for x in r.text.split("\n") if not _like_notice(x))
        prose += [own] if own.strip() else []
    learn, hold = prose[::2] or ["the"], prose[1::2] or ["the"]
    rng = np.random.default_rng(6)
    unknown = []
    for own in map(str.split, learn):
        for size in rng.choice(SIZES, 2).tolist():
            at = int(rng.integers(0, max(1, len(own) - size + 1)))
            unknown.append(" ".join(own[at : at + size]))
    weights, thresholds = np.zeros((len(FAMILIES), SLOTS + 1)), np.full((len(SIZES), len(FAMILIES)), np.inf)
    filler = [x.split() for x in learn], [x.split() for x in hold]
    made = {f: [x for i, t in enumerate(TEMPLATES[f]) for x in _variants(t, filler[0], i, 40)] for f in FAMILIES}
    texts = [(x, f) for f in FAMILIES for x in made[f]] + [(x, None) for x in unknown]
    w = _of([x for x, _ in texts])
    slots, lines = _features(w)
    by = np.argsort(lines, kind="stable")
    bounds = np.searchsorted(lines[by], np.arange(w.n_texts + 1))
    vectors = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, count = np.unique(slots[by[a:b]], return_counts=True)
        vectors.append((np.append(own, SLOTS), np.append(SCALE * count / max(1, b - a), 1.0)))
    shuffled = np.random.default_rng(5).permutation(len(texts)).tolist()
    for i, family in enumerate(FAMILIES):
        model = Ftrl(l1=0.01, slots=SLOTS)
        for _ in range(EPOCHS):
            for j in shuffled:
                model.learn(*vectors[j], float(texts[j][1] == family))
        weights[i] = model.weights()
    w = _of(hold)
    most = [x.max(axis=0, initial=-np.inf) for x in _log_odds(w, weights, [_windows(w, size) for size in SIZES])]
    for i, family in enumerate(FAMILIES):
        kept: dict[int, list[str]] = {}
        for n, notice in enumerate(TEMPLATES[family]):
            kept.setdefault(_size(notice), []).extend(x for x in _variants(notice, filler[1], 1000 + n, 20) if confirmed(x, family) >= CONFIRM)
        for k, own in kept.items():
            w = _of(own)
            odds = _log_odds(w, weights, _whole(w))[0][:, i]
            thresholds[k, i] = min(most[k][i] + max(0.0, (np.median(odds) - most[k][i]) / 2), np.quantile(odds, 0.1))
    return weights, thresholds


def _found(w: Words, raw: np.ndarray, odds: list[np.ndarray], bounds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, float, float]]:
    """(first word, family, odds, confirmation) of the notices of a block, in the order of their words."""
    made: dict[int, dict[tuple[int, int, int], tuple[float, float]]] = {}
    for own, (low, high) in zip(odds, bounds, strict=True):
        for i in np.flatnonzero(own.max(axis=1, initial=-np.inf) > 0).tolist():
            a, b = int(low[i]), int(high[i])
            pairs = _word_pairs([bytes(raw[x:y]).decode(errors="replace") for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)])
            for j in np.flatnonzero(own[i] > 0).tolist():
                share, first, last = aligned(pairs, FAMILIES[j])
                if share >= CONFIRM:
                    of_text, key = made.setdefault(int(w.text[a]), {}), (a + first, a + last + 1, j)
                    of_text[key] = max(of_text.get(key, (0.0, 0.0)), (share, float(own[i, j])))
    out = []
    for of_text in made.values():
        taken: list[tuple[int, int]] = []  # apart from one another, in order
        for (a, b, j), (share, own) in sorted(of_text.items(), key=lambda x: (-x[1][0], -x[1][1], x[0])):
            at = bisect.bisect(taken, (a, b))
            if (at and taken[at - 1][1] >= a) or (at < len(taken) and taken[at][0] <= b):
                continue
            taken.insert(at, (a, b))
            out.append((a, j, own, share))
    return sorted(out)


def scan_licences(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> DataFrame:
    """Columns of ``docs`` and n_paragraphs and licences: array of (paragraph from 0, family, score, confirmation)."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, thresholds))
    docs = docs.drop("n_paragraphs", "licences")
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("score", pa.float64()), ("confirmation", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        for batch in batches:
            for a, b, buf, offsets in blocks(batch, text, BLOCK_BYTES):
                cuts, owner = _paragraphs(buf, offsets)
                w = Words(buf, cuts, _SEPARATORS, lower=True)
                full = w.counts > 0
                number = np.cumsum(full)
                before = np.append(0, number)[np.searchsorted(owner, np.arange(b - a))]
                joined = _joined(w, owner)
                bounds = [_windows(joined, size) for size in SIZES]
                odds = [x - least for x, least in zip(_log_odds(joined, weights, bounds), thresholds, strict=True)]
                found: list[list] = [[] for _ in range(b - a)]
                for word, j, own, share in _found(joined, buf, odds, bounds):
                    line = int(w.text[word])
                    at = int(owner[line])
                    found[at].append({"paragraph": int(number[line] - 1 - before[at]), "family": FAMILIES[j], "score": float(sigmoid(own)), "confirmation": share})
                many = np.bincount(owner[full], minlength=b - a)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(many, pa.int64()), pa.array(found, kind)], names=[*inner, "n_paragraphs", "licences"])

    plain = docs.toDF(*inner)
    schema = ", ".join(f"{c} {kind}" for c, kind in plain.dtypes) + ", n_paragraphs long, licences array<struct<paragraph:long,family:string,score:double,confirmation:double>>"
    return plain.mapInArrow(released(run), schema).toDF(*names, "n_paragraphs", "licences")


def op9_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licences(docs, *train_licences(docs))
    families = F.array_join(F.array_sort(F.array_distinct("licences.family")), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), F.coalesce(F.array_max("licences.score"), F.lit(0.0)).alias("score"))
