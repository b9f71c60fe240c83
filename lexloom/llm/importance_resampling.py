"""Target-distribution importance resampling over hashed n-gram buckets.

Two passes over whole texts in Arrow batches. The first counts, in each task, the
buckets of all features in one vector (``np.bincount``); ``treeReduce`` adds the
vectors of the tasks, so neither a task nor the driver ever holds more than some
tens of them, whatever the number of texts. The log-ratio of the two distributions
gives a gain for each bucket. The second pass gathers the broadcast gains (one vector
of ``BUCKETS`` entries) of each document's features and sums them with ``np.bincount``.

The draw adds a Gumbel number, fixed by the document's id, to each weight and takes the
highest scores (sampling without replacement by weight). Ranks come from ranges of the
order: range-partitioned rows are written once, rows of a range are numbered within
it, and the sizes of the ranges before are added. No task holds more than a range.

Defined results: null and empty texts have no features, weight 0, and are never drawn.
A null doc_id is hashed as the empty string. Repeated rows are scored alike and ranked
one after another, in any order among themselves, as are rows with the same score and
doc_id. Texts are read whole, however long, a block of bytes at a time. An empty table
gives an empty one; an empty target gives all buckets the gains of no target words.
Columns of the input that are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import written
from .words import Words, blocks, byte_class, released

BUCKETS = 10_000
#: Bytes that separate words, once A-Z are lower case: [\x00-\x2F\x3A-\x60\x7B-\x7F]. Words decides on bytes before that.
SEPARATORS = byte_class(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Bytes of text worked on at a time.
BLOCK_BYTES = 1 << 20
#: Runs of up to so many bytes are hashed together, longer ones one by one.
SHORT = 64


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_TABLE = _crc_table()


def crc32_of_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of buf[starts[i]:ends[i]], a byte of all runs at a time, longest first."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(sizes <= SHORT)
    short = short[np.argsort(-sizes[short], kind="stable")]
    at, size = starts[short], sizes[short]
    state = np.full(len(short), 0xFFFFFFFF, np.uint32)
    alive = len(short) - np.searchsorted(size[::-1], np.arange(SHORT), side="right")  # runs with more bytes than that
    for k in range(SHORT):
        n = alive[k]
        if not n:
            break
        state[:n] = _TABLE[(state[:n] ^ buf[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out[short] = ~state
    return out


def _joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between them: bytes, starts, ends."""
    sizes = w.ends - w.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    made = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    made[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = w.buf[np.arange(sizes.sum()) + np.repeat(w.starts - (np.cumsum(sizes) - sizes), sizes)]
    return made, starts, ends


def bucketed(w: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each run of 1 to ``longest`` words."""
    buf, starts, ends = (w.buf, w.starts, w.ends) if longest == 1 else _joined(w)
    made, texts = [], []
    for n in range(1, longest + 1):
        first = np.flatnonzero(w.windows(n))
        made.append(crc32_of_runs(buf, starts[first], ends[first + n - 1]) % buckets)
        texts.append(w.text[first])
    return np.concatenate(made).astype(np.int64), np.concatenate(texts)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buf, offsets in blocks(batch, "text", BLOCK_BYTES):
                total += np.bincount(bucketed(Words(buf, offsets, SEPARATORS, lower=True), longest, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(released(run), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda row: np.frombuffer(row["counts"], np.int64)).treeReduce(np.add, depth=3)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log-ratio) of the smoothed shares of each bucket, in doubles."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """Columns of ``docs`` and n_words, n_features and weight: the floored mean gain of its features, 0 without any."""
    docs = docs.drop("n_words", "n_features", "weight")
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.zeros((3, 0), np.int64)]
            for _, _, buf, offsets in blocks(batch, text, BLOCK_BYTES):
                w = Words(buf, offsets, SEPARATORS, lower=True)
                slots, texts = bucketed(w, longest, len(sent.value))
                count = np.bincount(texts, minlength=w.n_texts)
                total = np.bincount(texts, sent.value[slots], w.n_texts)  # integers below 2^53: exact
                made.append(np.stack([w.counts, count, total.astype(np.int64) // np.maximum(1, count)]))
            columns = [pa.array(x, pa.int64()) for x in np.concatenate(made, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n_words", "n_features", "weight"])

    plain = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)])
    schema = ", ".join(f"{c} {kind}" for c, kind in plain.dtypes) + ", n_words long, n_features long, weight long"
    return plain.mapInArrow(released(run), schema).select(*[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)], "n_words", "n_features", "weight")


def with_score(weighted: DataFrame, seed: str) -> DataFrame:
    """Column score: the weight and a Gumbel number from SHA-256 of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Column rank: 1, 2, ... of the highest scores among rows of enough words, as many as ``percent`` of those; else null.

    Give narrow rows: they are shuffled by ranges of score and written.
    """
    scored = written(scored.drop("rank"), "scored")
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    total = scored.where(able).count()
    drawn = percent * total // 100
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    # Ties of score and doc_id are told apart by their place in the file, so that they don't crowd in one range.
    placed = scored.where(able).withColumn("place_", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("place_"))
    placed = written(placed.withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = {r["range_"]: r["count"] for r in placed.groupBy("range_").count().collect()}  # one row for each range
    before, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(starts, "own_range_ int, before_ long"))
    number = F.row_number().over(Window.partitionBy("range_").orderBy(*order, "place_")) + F.col("before_")
    numbered = placed.join(offsets, F.col("range_") == F.col("own_range_")).withColumn("rank", number.cast("long"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    columns = [F.col(f"`{c}`") for c in scored.columns]
    return numbered.select(*columns, rank).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, seed: str = "2024", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text) for the texts of ``target``."""
    source = bucket_counts(docs, longest, buckets)
    gains = bucket_gains(source, bucket_counts(target, longest, buckets))
    weighted = importance_weights(docs.select("doc_id", "text"), gains, longest).drop("text")
    return ranked(with_score(weighted, seed), percent, least_words)


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, all columns, with their rank; of rows that repeat a doc_id, all if one is drawn."""
    ranks = resampled(docs, target, **options).where("rank is not null").groupBy(F.col("doc_id").alias("drawn_id_")).agg(F.min("rank").alias("rank"))
    docs = docs.drop("rank")
    return docs.join(ranks, docs["doc_id"].eqNullSafe(ranks["drawn_id_"])).drop("drawn_id_")


ORACLE_SQL = """
WITH features AS (
  SELECT doc_id, rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
), targets AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark
), bits AS (
  SELECT word, list_transform(range(0, 4 * length(h)), lambda i: (('0x' || substr(h, 2 * (i // 8)::INT + 1, 2))::BIGINT >> (i % 8)::BIGINT) & 1) AS bit
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM features UNION SELECT word FROM targets))
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bit), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT) % 10000 AS bucket
  FROM bits
), s AS (SELECT bucket, count(*) AS s FROM features JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM targets JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT *, row_number() OVER () AS rid FROM documents) d LEFT JOIN weights USING (rid)
), placed AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resampled(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
