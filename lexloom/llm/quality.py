"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Training takes a bounded sample of the labelled rows (``train_rows``; one row, that
of the smallest hash, from each of so many hash classes of doc_id). The sample is
dealt over ``shards``; each shard runs its own passes of online updates and the
weights are averaged. Scoring reads every text whole, once, without a shuffle.

Defined results: null and empty texts are scored by the bias alone. Labels null,
or of documents that are not there, teach nothing; several labels of one doc_id
count as their mean, 0.5 or more as good. Without any label the score is 0.5.
Rows are never dropped; repeated rows are scored alike. Columns of the
input that are named like a result's are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ngram_model import SLOTS, Ftrl, examples, scores, sigmoid
from .words import Words, blocks, integers, released, released_group

TRAIN_ROWS, SHARDS, EPOCHS = 8192, 4, 4
BLOCK_BYTES = 1 << 18


def _train(epochs: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending")])
        model, seen = Ftrl(), []
        for batch in table.combine_chunks().to_batches():
            labels = integers(batch, "label")
            for a, b, buf, offsets in blocks(batch, "text", BLOCK_BYTES):
                seen += [(slots, values, label) for (slots, values), label in zip(examples(Words(buf, offsets)), labels[a:b].tolist(), strict=True)]
        for _ in range(epochs):
            for slots, values, label in seen:
                model.learn(slots, values, label)
        weights = model.weights()
        own = np.flatnonzero(weights)
        return pa.table({"slot": pa.array(own, pa.int64()), "weight": pa.array(weights[own], pa.float64())})

    return run


def train_quality(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, train_rows: int = TRAIN_ROWS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from documents (doc_id, text) and labels (doc_id, quality); learn_from: condition on doc_id."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    order = F.xxhash64(F.lit("order"), "doc_id")
    known = known.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(train_rows)).alias("class")).agg(F.min_by(F.struct("doc_id", "label"), F.struct(order, "doc_id")).alias("x")).select("x.*")
    # At most train_rows rows are broadcast.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    texts = texts.select("text", "label", order.alias("order")).withColumn("shard", F.pmod("order", F.lit(shards)))
    parts = texts.groupBy("shard").applyInArrow(released_group(_train(epochs)), "slot long, weight double")
    mean = parts.groupBy("slot").agg((F.sum("weight") / shards).alias("weight")).toPandas()  # SLOTS + 1 rows at most
    weights = np.zeros(SLOTS + 1)
    weights[mean["slot"].to_numpy(np.int64)] = mean["weight"]
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` and ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sigmoid(scores(Words(buf, offsets), sent.value)) for _, _, buf, offsets in blocks(batch, text, BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))], names=[*batch.schema.names, "score"])

    plain = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)])
    schema = ", ".join(f"{c} {kind}" for c, kind in plain.dtypes) + ", score double"
    made = plain.mapInArrow(released(run), schema)
    return made.select(*[F.col(i).alias(c) for c, i in zip(names, inner, strict=True)], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_class(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = train_quality(docs, labels, learn_from=crc_class(3) != 1)
    scored = score_quality(docs, weights)
    return scored.select("doc_id", F.coalesce(crc_class(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
