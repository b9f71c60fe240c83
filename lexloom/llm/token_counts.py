"""Token counts through a cache of digests.

A text's key is the SHA-256 of its UTF-8 bytes; a tokenizer version's is the
SHA-256 of its file, its library and the library's version. The texts' distinct
keys are joined to the cache (a Parquet table of tokenizer, digest and count),
only the distinct misses are encoded, and their counts are appended to the cache.
The content is normalised by nothing but null becoming the empty text, as any
other change could change the count.

Digests that more than a thousandth of all rows have (a third may be one text) are
at most a thousand, so their counts are broadcast, and those rows are spread over the
join that all others take.

The query keeps its cache at ``cache_path``, by default ``lexloom-token-cache`` under
``spark.checkpoint.dir``: a later run over the same texts encodes nothing.

Defined results: null counts as the empty text, of 0 bytes and 0 tokens. Repeated
rows and texts are encoded once and each row is returned. Rows of the cache that
repeat a key are equal, so one of them is taken. An empty table gives an empty one
and appends nothing. Texts are encoded whole, however long. Columns of the input that
are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import shared_dir, written
from .words import released

CACHE = "tokenizer string, digest binary, n_tokens long"
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 1 << 20
#: Rows of one digest from which it counts as hot, and the share of all rows that it must have besides.
HOT_ROWS, HOT_SHARE = 1000, 1000


def tokenizer_digest(path: str) -> str:
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    version = importlib.metadata.version(library)
    return hashlib.sha256(f"{library} {version} ".encode() + Path(path).read_bytes()).hexdigest()


def _encoder(name: str, content: bytes):
    """Function from texts to their numbers of tokens."""
    if name.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _count(name: str, content: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(name, content)
        for batch in batches:
            made, part, size = [], [], 0
            for text in batch.column(1):
                part.append(text.as_py())
                size += len(part[-1])
                if size >= BATCH_BYTES:
                    made += count(part)
                    part, size = [], 0
            if part:
                made += count(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["digest", "n_tokens"])

    return released(run)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """Columns of ``docs`` and n_bytes and n_tokens. Appends to the cache what it lacks."""
    docs = docs.drop("n_bytes", "n_tokens")
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = Path(tokenizer_path).read_bytes()  # on the driver; the tasks get the bytes
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))

    keyed = docs.select(digest.alias("digest"), text.alias("text"))
    # Equal texts meet in the map tasks first: a third of all rows may be one text.
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(_cached(spark, cache_path, version), "digest", "left_anti")
    counted = misses.select("digest", "text").mapInArrow(_count(tokenizer_path, content), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    known = _cached(spark, cache_path, version).withColumnRenamed("digest", "known_digest_")
    # At most HOT_SHARE digests have so many rows.
    counts = docs.groupBy(digest.alias("digest")).count().where(F.col("count") > HOT_ROWS)
    counts = written(counts, "frequent-digests")
    hot = counts.where(F.col("count") > docs.count() // HOT_SHARE) if not counts.isEmpty() else counts
    hot = F.broadcast(hot.join(known, F.col("digest") == F.col("known_digest_")).select(F.col("digest").alias("hot_digest_"), F.col("n_tokens").alias("hot_tokens_")))
    rows = docs.withColumns({"own_digest_": digest, "n_bytes": F.octet_length(text).cast("long")})
    rows = rows.join(hot, F.col("own_digest_") == F.col("hot_digest_"), "left")
    # A hot row has its count: it goes to any task.
    anywhere = F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")
    rows = rows.withColumn("own_digest_", F.when(F.col("hot_digest_").isNull(), F.col("own_digest_")).otherwise(anywhere))
    joined = rows.join(known, F.col("own_digest_") == F.col("known_digest_"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "n_bytes", F.coalesce("hot_tokens_", "n_tokens").alias("n_tokens"))


def _cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path)
    rows = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def op10_query(spark, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_path or f"{shared_dir(spark)}/lexloom-token-cache")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
