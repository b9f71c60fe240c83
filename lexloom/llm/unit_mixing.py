"""Online logistic context mixing over the units of a text, in contexts that reach across them.

Each frequent unit of the training texts has a prefix code by its count there (``Code``),
and one more code word, the escape, says that a unit is spelled byte by byte instead. The
bits of the code words are predicted one after another from three hashed contexts (the bits
of this unit alone, and with them the one and the two units before it in the text).
Each context's slot holds how often a 0 and a 1 followed; the slots' log-odds are added
with weights from a gate (how many of the longer contexts were seen, and the bit's place).

Learning goes once over the training texts, in each task on its own: a step's bits are
predicted from what came before it, then weights and counts are updated. The counts of all
tasks are added (one vector of ``SLOTS`` pairs, ``treeReduce``), the weights averaged.
Scoring predicts, then updates too: every text begins with the learnt weights, and they
follow it from one stretch of units to the next. Stretches grow along a text (``STRETCH``,
twice, three times as many units and so on), and those of many texts are worked on together.
So a score depends on the text and on the training texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .words import HASH, blocks, mix, released, text_column

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Bits of the number of slots of each context: of no unit before, of one, and of two.
SIZES = (19, 20, 20)
STARTS = np.cumsum([0, *(1 << bits for bits in SIZES)])
SLOTS = int(STARTS[-1])
#: For each number of longer contexts that were seen, eight classes of the bit's place.
GATES = len(SIZES) * 8
#: Added to both counts of a slot; bound of log-odds, and their steps as they are sent.
PRIOR, LIMIT, SCALE = 0.05, 12.0, 10.0
#: Units that are learnt from at a time, units whose texts are worked on together, units of a text's first stretch.
STEP, BLOCK, STRETCH = 1 << 10, 1 << 14, 24
#: Rates of updates while learning and while scoring, and the bits that a stretch's update is shrunk by.
RATE, OWN_RATE, SHRINK = 0.1, 0.5, 8.0


class Code:
    """Prefix code of the entries of positive count; the last entry is the escape and stands for all others too."""

    def __init__(self, counts: np.ndarray):
        used = np.flatnonzero(counts > 0)
        self.symbol = np.where(counts > 0, np.arange(len(counts)), len(counts) - 1)
        self.length, self.bits = np.zeros(len(counts), np.int64), np.zeros(len(counts), _U)
        if len(used) > 1:
            lengths = np.ceil(np.log2(counts.sum() / counts[used])).astype(np.int64)
            order = np.argsort(lengths, kind="stable")
            left = (lengths.max() - lengths[order]).astype(_U)
            steps = _U(1) << left
            self.length[used] = lengths
            # Behind a leading 1, so that a code word's beginnings differ by length too.
            self.bits[used[order]] = ((np.cumsum(steps, dtype=_U) - steps) >> left) | (_U(1) << lengths[order].astype(_U))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with up to ``BLOCK`` units, and one row at least: a batch may hold many more."""
    for a, b, _, _ in blocks(batch, "codes", 4 * BLOCK):
        for at in range(a, b, 1024):
            yield batch.slice(at, min(1024, b - at))


class Units:
    """Units of some texts, one after another: entry, text, place in the text, and the key of each context."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        """batch: codes (numbers of dictionary entries below ``size``, others are places in rare) and rare, as ``pieces.coded`` gives them."""
        buf, ends = text_column(batch, "codes")
        found = np.frombuffer(buf[ends[0] : ends[-1]].tobytes(), np.int32).astype(np.int64)
        self.bounds = (ends - ends[0]) // 4
        self.text = np.repeat(np.arange(batch.num_rows), np.diff(self.bounds))
        self.place = np.arange(len(found)) - self.bounds[:-1][self.text]
        rare = batch.column(batch.schema.get_field_index("rare"))
        self.rare = rare.flatten()
        first = np.append(0, np.cumsum(rare.value_lengths().to_numpy(zero_copy_only=False)))
        self.entry = np.minimum(found, size)
        others = np.flatnonzero(found >= size)
        self.other = first[self.text[others]] + found[others] - size  # the rare piece of each unit outside the dictionary
        self.others = np.append(0, np.cumsum(np.bincount(self.text[others], minlength=batch.num_rows)))
        own = mix(found.astype(_U) + _U(1))
        if len(others):
            spelled, at = text_column(pa.RecordBatch.from_arrays([self.rare], names=["piece"]), "piece")
            own[others] = HASH.words(spelled, at[:-1], at[1:])[self.other]
        self.keys = [np.zeros(len(found), _U)]
        for k in range(1, len(SIZES)):
            before = np.zeros(len(found), _U)
            before[k:] = own[:-k]
            before[self.place < k] = 0
            self.keys.append(mix(self.keys[-1] * _GOLD + before + _U(k)))

    def bits(self, at: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Of the units ``at``: the unit of each bit (its place in ``at``), the bit, its slots, and the class of its place."""
        symbol = code.symbol[self.entry[at]]
        length = code.length[symbol]
        who, bits = (np.repeat(x, length) for x in (np.arange(len(at)), code.bits[symbol]))
        left = np.repeat(np.cumsum(length), length) - np.arange(len(who))
        depth, left = np.repeat(length, length) - left, left.view(_U)
        node = (bits >> left) * _GOLD
        slots = [((np.repeat(key[at], length) + node) >> _U(64 - size)).view(np.int64) + start for key, size, start in zip(self.keys, SIZES, STARTS, strict=False)]
        return who, ((bits >> (left - _U(1))) & _U(1)).view(np.int64), slots, np.minimum(depth, 7)


def _gate(odds: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Slots that nothing was counted in have no odds."""
    return sum((x != 0).astype(np.int64) for x in odds[1:]) * 8 + place


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones.astype(np.float32) + np.float32(PRIOR)) / (zeros.astype(np.float32) + np.float32(PRIOR)))


def mixed(odds: list[np.ndarray], weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sum of the odds, x, and 1 + exp(-x), one over the probability of a 1."""
    x = sum(weights[k].take(at) * own for k, own in enumerate(odds))
    np.minimum(np.maximum(x, -LIMIT, out=x), LIMIT, out=x)
    return x, 1 + np.exp(-x)


def _updated(weights: np.ndarray, odds: list[np.ndarray], error: np.ndarray, at: np.ndarray, rate: float, shrink: float) -> None:
    size = weights.shape[1]
    total = np.bincount(at, minlength=size) + shrink
    for k, own in enumerate(odds):
        weights[k] += (rate * np.bincount(at, error * own, size) / total).astype(weights.dtype)


def first_weights() -> np.ndarray:
    return np.full((len(SIZES), GATES), 1.0 / len(SIZES))


class Model:
    """What is learnt, as it is sent to the tasks: the code, weights of the gates, and log-odds of the slots in steps of 1 / ``SCALE``."""

    def __init__(self, code: Code, counts: np.ndarray, weights: np.ndarray):
        self.code, self.weights = code, weights.astype(np.float32)
        self.odds = np.rint(np.clip(_odds(counts[::2], counts[1::2]), -LIMIT, LIMIT) * SCALE).astype(np.int8)


def learnt(rows: DataFrame, sent, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the slots (0 and 1 in turn) and weights, from rows (codes, rare) of the training texts; sent: a broadcast ``Code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights, n = np.zeros(2 * SLOTS, np.int32), first_weights().astype(np.float32), 0
        for units in (Units(part, size) for batch in batches for part in _parts(batch)):
            for at in range(0, len(units.text), STEP):
                _, y, slots, place = units.bits(np.arange(at, min(at + STEP, len(units.text))), sent.value)
                pairs = [counts.view(np.int64).take(s).view(np.int32) for s in slots]  # both counts of a slot at once
                odds = [_odds(x[::2], x[1::2]) for x in pairs]
                gate = _gate(odds, place)
                _, below = mixed(odds, weights, gate)
                _updated(weights, odds, y.astype(np.float32) - 1 / below, gate, RATE, 1e-9)
                for s in slots:
                    np.add.at(counts, 2 * s + y, np.int32(1))
                n += len(y)
        packed = zstandard.compress(counts.astype(np.float32).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([np.append(weights.ravel().astype(float) * n, n).tobytes()], pa.binary())], names=["counts", "sums"])

    def added(a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        counts = sum(np.frombuffer(zstandard.decompress(x), np.float32) for x in (a[0], b[0]))
        return zstandard.compress(counts.tobytes(), 1), a[1] + b[1]

    made = rows.select("codes", "rare").mapInArrow(released(run), "counts binary, sums binary").rdd
    if not made.getNumPartitions():
        return np.zeros(2 * SLOTS, np.float32), first_weights()
    packed, sums = made.map(lambda r: (bytes(r["counts"]), np.frombuffer(r["sums"]))).treeReduce(added, depth=3)
    weights = sums[:-1].reshape(len(SIZES), GATES) / sums[-1] if sums[-1] else first_weights()
    return np.frombuffer(zstandard.decompress(packed), np.float32), weights


def log_probabilities(units: Units, model: Model) -> np.ndarray:
    """log10-probability of the code words of each text."""
    n, place, text = len(units.bounds) - 1, units.place, units.text
    # Stretch s begins at unit STRETCH * s * (s + 1) / 2.
    stretch = ((np.sqrt(1 + 8 * (place // STRETCH)) - 1) // 2).astype(np.int32)
    order = np.argsort(stretch, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(stretch)))
    weights, scores = np.tile(model.weights, n), np.zeros(n)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for c in range(a, b, BLOCK):  # of a very long stretch
            at = order[c : min(c + BLOCK, b)]
            who, y, slots, place_class = units.bits(at, model.code)
            own = text[at][who]
            odds = [model.odds.take(s).astype(np.float32) * np.float32(1 / SCALE) for s in slots]
            gate = own * GATES + _gate(odds, place_class)
            x, below = mixed(odds, weights, gate)
            y = y.astype(np.float32)
            scores -= np.bincount(own, np.log(below) + (1 - y) * x, n)
            _updated(weights, odds, y - 1 / below, gate, OWN_RATE, SHRINK)
    return scores / np.log(10)


def text_sums(rows: DataFrame, columns: tuple[str, ...], sent, sent_columns, keep: int) -> DataFrame:
    """c0, c1, ... (``keep`` of them), row, s0, s1, ... and rare of ``rows``: the sums over each text's units, and its units outside the dictionary.

    sent: a broadcast ``Model``; sent_columns: a broadcast array of each of ``columns`` over
    the dictionary's entries. To ``score`` come the log-probabilities of the code words.
    """
    names = [*(f"c{i}" for i in range(keep)), "row"]
    kinds = dict(rows.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in names) + "".join(f"s{k} double, " for k in range(len(columns))) + "rare array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, values = sent.value, [np.append(x, 0.0) for x in sent_columns.value]  # the last place stands for the rare pieces
        for part in (part for batch in batches for part in _parts(batch)):
            units = Units(part, len(values[0]) - 1)
            sums = [np.bincount(units.text, x[units.entry], part.num_rows) for x in values]
            sums[columns.index("score")] += log_probabilities(units, model)
            rare = pa.ListArray.from_arrays(pa.array(units.others, pa.int32()), units.rare.take(pa.array(units.other)))
            kept = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), rare], names=[*names, *(f"s{k}" for k in range(len(columns))), "rare"])

    return rows.mapInArrow(released(run), schema)
