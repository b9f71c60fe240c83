"""Hashed word n-gram features and follow-the-regularised-leader logistic regression.

A text's features are the hashes of its words, word pairs, word forms (case and
punctuation at both ends) and form n-grams, and the word triples that it has
repeated. Each counts 1/number of features, so a score is the mean weight of the
features: one gather and one sum, whatever the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import HASH, Words, mix

#: Slots of the weight vector; one more holds the bias.
SLOTS = 1 << 18
#: Share of a feature of its text is multiplied by this, so that weights stay moderate.
SCALE = 16.0

_FORM = np.arange(256, dtype=np.uint64)
_FORM[97:123], _FORM[65:91], _FORM[48:58], _FORM[128:] = 97, 65, 48, 97
_REPEATED = 0


def _forms(w: Words) -> np.ndarray:
    second = np.minimum(w.starts + 1, w.ends - 1)
    first, second, last = (_FORM[w.buf[x]] for x in (w.starts, second, w.ends - 1))
    return mix((first << np.uint64(16)) | (second << np.uint64(8)) | last)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text of each feature."""
    h, form = w.hashes(), _forms(w)
    slots, texts = [], []

    def add(values: np.ndarray, n: int, kind: int) -> None:
        grams = values if n == 1 else HASH.grams(values, n)
        valid = w.windows(n)[: len(grams)]
        slots.append((mix(grams[valid] + np.uint64(kind)) >> np.uint64(46)).astype(np.int64))
        texts.append(w.text[: len(grams)][valid])

    for kind, (values, n) in enumerate(((h, 1), (h, 2), (form, 1), (form, 2), (form, 3))):
        add(values, n, kind)
    triples = HASH.grams(h, 3)
    valid = w.windows(3)[: len(triples)]
    text, triples = w.text[: len(triples)][valid], triples[valid]
    order = np.lexsort((triples, text))
    again = np.flatnonzero((np.diff(triples[order].astype(np.int64)) == 0) & (np.diff(text[order]) == 0)) + 1
    slots.append(np.full(len(again), _REPEATED))
    texts.append(text[order][again])
    return np.concatenate(slots), np.concatenate(texts)


def scores(w: Words, weights: np.ndarray) -> np.ndarray:
    """Log-odds of each text; weights: SLOTS + 1 entries, the last is the bias."""
    slots, texts = features(w)
    total = np.bincount(texts, weights[slots], w.n_texts)
    return SCALE * total / np.maximum(1, np.bincount(texts, minlength=w.n_texts)) + weights[SLOTS]


def examples(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots and values of each text, the bias last."""
    slots, texts = features(w)
    order = np.argsort(texts, kind="stable")
    slots, bounds = slots[order], np.searchsorted(texts[order], np.arange(w.n_texts + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, count = np.unique(slots[a:b], return_counts=True)
        yield np.append(own, SLOTS), np.append(SCALE * count / max(1, b - a), 1.0)


class Ftrl:
    """Follow the proximal regularised leader, one learning rate for each weight."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, slots: int = SLOTS):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(0.0, np.abs(z) - self.l1)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        g = (sigmoid(w @ values) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[slots] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))
