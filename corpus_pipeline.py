"""Documents to token counts in five stages, each an operator of lexloom.llm.

Each stage reads what the one before has written. All but the last return the
columns of ``documents``. Rows are dropped by the quality classifier, as near
copies, or as contaminated; repeated passages are cut out of the texts, and a text
from which nothing was cut stays as it was, byte for byte.

In every stage: null and empty texts count as texts without words; rows with a null
doc_id are kept or dropped by their texts as others are; of rows that repeat a doc_id
each is judged by its own text; an empty table gives an empty one; texts are read
whole, however long; further columns pass through, also where an operator has a
result of the same name.

The stages bound the rows of the session's Arrow batches (``BATCH_ROWS``): whole texts
stand in them twice, in an executor's JVM and in the Python workers of its tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm import bpe, decontaminate, jaccard_join, quality, scratch, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 2048


def _small_batches(stage: Callable) -> Callable:
    """The stage, with the session's Arrow batches bounded; the bound stays, as the stage's rows are made after it has returned."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def _with_extras(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of ``docs``; further ones are out of the operators' way meanwhile."""
    inner = [c if c in COLUMNS else f"extra_{i}_" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*inner)).select(inner).toDF(*docs.columns)


@_small_batches
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, trained on the labelled ones, takes for good.

    Null and empty texts have the classifier's bias for a score. Without any label all
    score 0.5 and are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    def stage(docs: DataFrame) -> DataFrame:
        return quality.score_quality(docs, quality.train_quality(docs, labels)).where("predicted = 1")

    return _with_extras(docs, stage)


@_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the least doc_id, of each class of similarity 0.8 over five-word shingles.

    Texts without words are classes of their own and stay; of rows with the same doc_id
    and text one stays. A null doc_id is kept only where its class has no other.
    """
    kept = jaccard_join.near_duplicates(docs, n=5, percent=80).where("first")
    once = kept.groupBy("row").count()
    rows = docs.withColumn("row_key_", jaccard_join.row_key()).join(once.select(F.col("row").alias("kept_row_")), F.col("row_key_") == F.col("kept_row_"), "left_semi")
    # Equal rows share a key; only where there are such must they meet.
    if not once.where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["row_key_"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


@_small_batches
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut windows of 13 words that an earlier document has; n_chars follows the text.

    Rows with a null doc_id lose nothing and cost nobody anything; rows of one doc_id
    are no earlier than each other.
    """

    def stage(docs: DataFrame) -> DataFrame:
        cut = substring_dedup.remove_repeated_passages(docs)
        changed = F.col("n_removed") > 0
        made = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
        if "n_chars" in docs.columns:
            made["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
        return cut.withColumns(made)

    return _with_extras(docs, stage)


@_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no window of ten words of the benchmark occurs; texts without words stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_extras(docs, lambda docs: decontaminate.contamination(docs, benchmark).where("n_hit = 0"))


@_small_batches
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to; null and empty texts have no tokens. Further columns end here."""
    return bpe.round_trip(docs.select(*[c for c in ("doc_id", "lang", "source", "text") if c in docs.columns]))


STAGES = [
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("tokens", encode_tokens),
]
#: The classifier is trained and BPE is a fold over ranks: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
