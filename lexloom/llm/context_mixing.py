"""Language-model scores by online logistic context mixing over bits.

A text is a sequence of units: a word and the separator after it, or the text's end.
Frequent units have code words, whose bits are mixed in contexts that reach across units,
with weights that follow the scored text (``unit_mixing``). Any other unit is announced by
an escape and spelled: the bits of its bytes are predicted one after another from five
hashed contexts within the unit (the last 1, 2, 3 and 5 bytes and all bytes so far): each
context's slot holds how often a 0 and a 1 followed in the training texts. The contexts'
log-odds are added with weights from a gate (how many of the long contexts were seen,
and the bit's place), which are learnt online by logistic updates, and an adaptive
probability map refines the sum. What spelling a unit costs depends on the unit alone: these
passes run over the corpus's distinct units, weighted by their counts (``pieces``).

What is gathered from all training texts: counts of words and units (shuffles), the
slots (one vector of ``SLOTS`` pairs a task, merged by ``treeReduce``), and the map's
sums. While weights are learnt, each unit's own occurrence is taken out of its counts,
so that the long contexts are not trusted for having seen that very occurrence.

Defined results: null and empty texts are an end alone. Without any training text all
bits are equally likely and each token of the base has the odds of an unknown one.
Repeated rows count and are returned each. An empty table gives an empty one. Texts
are read whole, however long, and units too (blocks of ``BLOCK_BYTES``). Columns of the
input that are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import pieces, unit_mixing
from .quality import crc_class
from .scratch import written
from .words import HASH, blocks, integers, mix, release, released

#: Behind a separator, [\x20\x09-\x0D]: what follows is a unit of its own, empty where the text ends there.
CUT = "(?<=[\\x20\\x09-\\x0D])"
#: The byte that ends a text: none of UTF-8.
END = 0xFF
#: Bytes of context (0: all of the unit so far) and bits of the number of its slots.
CONTEXTS = ((1, 16), (2, 18), (3, 20), (5, 20), (0, 20))
STARTS = np.cumsum([0, *(1 << bits for _, bits in CONTEXTS)])
SLOTS = int(STARTS[-1])
#: Contexts whose sight opens a gate, and the number of gates (for each number of them seen and each of the eight bits).
LONG = (2, 3, 4)
GATES = (len(LONG) + 1) * 8
#: Added to both counts of a slot.
PRIOR = 0.05
#: Levels of log-odds of the probability map, from -LIMIT to LIMIT.
LEVELS, LIMIT = 33, 12.0
#: Bytes of units that are worked on at a time, bytes between two updates of the weights, and the updates' rate.
BLOCK_BYTES, STEP_BYTES, RATE = 1 << 17, 1 << 13, 0.1
#: What is added up over a text's units.
SUMS = ("n_tokens", "n_known", "base_score", "score", "n_bytes")
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Bits:
    """Slots, bits and gates' places of the bytes of some units, one after another."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        ended = offsets[1:] == offsets[:-1]
        last = buf[np.maximum(offsets[1:] - 1, 0)] if len(buf) else np.zeros(len(ended), np.uint8)
        ended |= ~((last == 32) | ((last >= 9) & (last <= 13)))
        # Units without a separator get the end byte.
        self.offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + ended)])
        self.bytes = np.full(self.offsets[-1], END, np.uint8)
        self.bytes[np.arange(len(buf)) + np.repeat(self.offsets[:-1] - offsets[:-1], np.diff(offsets))] = buf
        self.unit = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))
        place = np.arange(len(self.bytes)) - self.offsets[:-1][self.unit]
        packed = np.zeros(len(self.bytes), _U)
        keys = {}
        for k in range(1, 6):
            before = np.zeros(len(self.bytes), _U)
            before[k:] = self.bytes[:-k]
            packed |= np.where(place >= k, before, 0).astype(_U) << _U(8 * (k - 1))
            keys[k] = packed.copy()
        at = np.arange(len(self.bytes))
        keys[0] = HASH.runs(HASH.table[self.bytes], self.offsets[:-1][self.unit], at)
        self.bases = [mix(keys[n] + _U((n + 1) * int(_GOLD) % (1 << 64))) for n, _ in CONTEXTS]

    def bit(self, j: int, span: slice = slice(None)) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Bit j (0 the highest) of each byte, its slots, and the node: the bits before it behind a leading 1."""
        own = self.bytes[span]
        node = (own.astype(_U) | _U(256)) >> _U(8 - j)
        slots = [((base[span] + node * _GOLD) >> _U(64 - bits)).astype(np.int64) + start for base, (_, bits), start in zip(self.bases, CONTEXTS, STARTS, strict=False)]
        return (own >> np.uint8(7 - j)) & 1, slots, node.astype(np.int64)


class Mixer:
    """Weights of each gate, and the sums of the probability map."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.full((GATES, len(CONTEXTS)), 1.0 / len(CONTEXTS)) if weights is None else weights
        self.seen = np.zeros((2, 256 * LEVELS)) if seen is None else seen  # weight and weight of ones

    def mixed(self, odds: list[np.ndarray], seen: list[np.ndarray], j: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Gate, log-odds of each context, and their weighted sum; seen: whether each long context was."""
        gate = sum(x.view(np.int8) for x in seen).astype(np.int64) * 8 + j
        weights = self.weights.astype(np.float32)
        return gate, odds, np.clip(sum(weights[gate, k] * x for k, x in enumerate(odds)), -LIMIT, LIMIT)

    def _level(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return node * LEVELS + np.rint((x + LIMIT) * ((LEVELS - 1) / (2 * LIMIT))).astype(np.int64)

    def learn(self, gate: np.ndarray, odds: np.ndarray, x: np.ndarray, y: np.ndarray, node: np.ndarray, times: np.ndarray) -> None:
        cell = self._level(x, node)
        self.seen[0] += np.bincount(cell, times, 256 * LEVELS)
        self.seen[1] += np.bincount(cell, times * y, 256 * LEVELS)
        error = (y - _sigmoid(x)) * times
        total = np.maximum(np.bincount(gate, times, GATES), 1e-9)
        for k in range(len(CONTEXTS)):
            self.weights[:, k] += RATE * np.bincount(gate, error * odds[k], GATES) / total

    def probability(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Of a 1: the mean of the sum's and the map's."""
        own = _sigmoid(x)
        cell = self._level(x, node)
        return (own + (self.seen[1][cell] + 2 * own) / (self.seen[0][cell] + 2)) / 2


def _unit_blocks(batch: pa.RecordBatch) -> Iterator[tuple[Bits, slice]]:
    for a, b, buf, offsets in blocks(batch, "piece", BLOCK_BYTES):
        yield Bits(buf, offsets), slice(a, b)


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.tobytes(), 1)


def _unpacked(content: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(content), np.int64)


def slot_counts(units: DataFrame) -> np.ndarray:
    """How often a 0 and a 1 followed in each slot, over units (piece, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS, np.int64)
        for batch in batches:
            n = integers(batch, "n")
            for bits, rows in _unit_blocks(batch):
                times = n[rows][bits.unit].astype(np.float64)
                rows_of = [bits.bit(j) for j in range(8)]
                for k, (_, size) in enumerate(CONTEXTS):
                    at = np.concatenate([(slots[k] - STARTS[k]) * 2 + y for y, slots, _ in rows_of])
                    total[2 * STARTS[k] : 2 * STARTS[k + 1]] += np.bincount(at, np.tile(times, 8), 2 << size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], names=["counts"])

    vectors = units.select("piece", "n").mapInArrow(released(run), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(2 * SLOTS, np.int64)
    return _unpacked(vectors.map(lambda row: bytes(row["counts"])).treeReduce(lambda a, b: _packed(_unpacked(a) + _unpacked(b)), depth=3))


class Counts:
    """Slots as they are sent: counts beyond float32's integers lose digits, not order."""

    def __init__(self, counts: np.ndarray):
        self.zeros, self.ones = (counts[i::2].astype(np.float32) for i in (0, 1))

    def __getstate__(self):
        return {"zeros": self.zeros, "ones": self.ones}

    @cached_property
    def odds(self) -> np.ndarray:
        return _odds(self.zeros, self.ones)

    @cached_property
    def seen(self) -> np.ndarray:
        return self.zeros + self.ones > 0


def learnt(units: DataFrame, counts) -> Mixer:
    """Weights, averaged over the tasks by what they saw, and the summed probability map; counts: a broadcast ``Counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, own = Mixer(), counts.value
        for batch in batches:
            n = integers(batch, "n")
            for bits, rows in _unit_blocks(batch):
                times = n[rows][bits.unit].astype(np.float64)
                for at in range(0, len(bits.bytes), STEP_BYTES):
                    span = slice(at, at + STEP_BYTES)
                    for j in range(8):
                        y, slots, node = bits.bit(j, span)
                        zeros, ones = [own.zeros[x] - (1 - y) for x in slots], [own.ones[x] - y for x in slots]
                        seen = [zeros[k] + ones[k] > 0 for k in LONG]
                        mixer.learn(*mixer.mixed(list(map(_odds, zeros, ones)), seen, j), y, node, times[span])
        row = np.concatenate([mixer.weights.ravel() * mixer.seen[0].sum(), mixer.seen.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes()], pa.binary())], names=["sums"])

    rows = units.where("n > 0").select("piece", "n").mapInArrow(released(run), "sums binary").rdd
    if not rows.getNumPartitions():
        return Mixer()
    total = rows.map(lambda row: np.frombuffer(row["sums"])).treeReduce(np.add, depth=3)
    size = GATES * len(CONTEXTS)
    seen = total[size:].reshape(2, -1)
    return Mixer(total[:size].reshape(GATES, -1) / seen[0].sum(), seen) if seen[0].sum() else Mixer()


def unit_scores(units: DataFrame, counts, mixer: Mixer) -> DataFrame:
    """Columns of ``units`` and score: the log10-probability of each unit."""
    schema = ", ".join(f"{c} {kind}" for c, kind in units.dtypes) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts.value
        for batch in batches:
            made = [np.zeros(0)]
            for bits, _ in _unit_blocks(batch):
                each = np.zeros(len(bits.bytes))
                for j in range(8):
                    y, slots, node = bits.bit(j)
                    odds = [own.odds[s] for s in slots]
                    _, _, x = mixer.mixed(odds, [own.seen[slots[k]] for k in LONG], j)
                    p = mixer.probability(x, node)
                    each += np.log10(np.where(y == 1, p, 1 - p))
                made.append(np.bincount(bits.unit, each, len(bits.offsets) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made))], names=[*batch.schema.names, "score"])

    return units.mapInArrow(released(run), schema)


def _word(piece: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_replace(piece, "[\\x20\\x09-\\x0D]$", ""), upper, upper.lower())


def language_scores(docs: DataFrame, train: Column, frequent: int | None = None) -> DataFrame:
    """Columns of ``docs`` but text, and n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    train: the condition on the documents to learn from.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    keep = tuple(c for c in docs.columns if c != "text")
    train = F.coalesce(train, F.lit(False))
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    split = F.explode(pieces.pieces_of(F.col("text"), CUT)).alias("piece")
    units = whole.select(split, train.cast("long").alias("own_")).groupBy("piece").agg(F.sum("own_").alias("n"), F.count("own_").alias("n_all"))
    # Cases and separators of a word meet; in the order of a hash, so that learning sees no order.
    units = units.withColumn("word", _word(F.col("piece"))).withColumn("c", F.sum("n").over(Window.partitionBy("word")))
    units = written(units.sortWithinPartitions(F.xxhash64("piece")), "units")
    trained = whole.where(train).count()
    words = units.where("word != ''").groupBy("word").agg(F.max("c").alias("c")).agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = (words["n"] or 0) + trained, (words["v"] or 0) + (trained > 0)

    counts = spark.sparkContext.broadcast(Counts(slot_counts(units.where("n > 0"))))
    release()
    mixer = learnt(units, counts)
    below = n + 0.1 * (v + 1)
    is_word = F.col("word") != ""
    records = unit_scores(units.select("piece", "n", "n_all", "word", "c"), counts, mixer).select(
        "piece",
        F.col("n_all").alias("n"),
        F.coalesce(F.col("n"), F.lit(0)).alias("own"),
        is_word.cast("long").alias("n_tokens"),
        (is_word & (F.col("c") > 0)).cast("long").alias("n_known"),
        F.when(is_word, F.log10((F.col("c") + 0.1) / F.lit(below))).otherwise(0.0).alias("base_score"),
        "score",
        F.octet_length("piece").alias("n_bytes"),
    )
    records = written(records, "unit-records")
    counts.unpersist()
    # The units that have a code word are chosen by the training texts alone; others that come often only have their records sent.
    frequent = pieces.FREQUENT if frequent is None else frequent
    least = pieces.least_level(records.where("own > 0"), frequent * 3 // 4, "own")
    whole_units = (F.col("own") > 0) & (pieces.level("own") >= least)
    records = records.withColumn("own", F.when(whole_units, F.col("own")).otherwise(0))
    spelled = records.where("own = 0")
    least = pieces.least_level(spelled, frequent // 4)
    sent = spark.sparkContext.broadcast(pieces.Dictionary(records.where((F.col("own") > 0) | (pieces.level() >= least)).select("piece", "own", *SUMS)))
    others = spelled.where(pieces.level() < least).select("piece", "n", *SUMS)
    own = sent.value.column("own").to_numpy()
    escapes = (units.agg(F.sum("n")).first()[0] or 0) - int(own.sum())
    code = unit_mixing.Code(np.append(own, max(1, escapes)))
    values = [sent.value.column(c).to_numpy().astype(np.float64) for c in SUMS]
    values[SUMS.index("score")][own > 0] = 0.0  # their code words count instead

    kept = whole.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], train.alias("train"), "text")
    rows = pieces.coded(kept, CUT, "", sent, tuple(kept.columns[:-1]), "unit-codes")
    sent.unpersist()
    sent_code = spark.sparkContext.broadcast(code)
    model = unit_mixing.Model(code, *unit_mixing.learnt(rows.where(f"c{len(keep)}"), sent_code, len(own)))
    sent_model, sent_values = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(values)
    del model, values, own
    release()
    sums = written(unit_mixing.text_sums(rows, SUMS, sent_model, sent_values, len(keep)), "text-sums")
    made = pieces.summed(sums, others, SUMS, keep)
    end = math.log10((trained + 0.1) / below)
    return made.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.col("n_tokens").cast("long") + 1).alias("n_tokens"),
        (F.col("n_known").cast("long") + int(trained > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + end).alias("base_score"),
        "score",
        (F.col("score") * (-1 / math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = language_scores(docs, crc_class(10) != 0)
    return made.withColumn("held_out", F.coalesce(crc_class(10) == 0, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
