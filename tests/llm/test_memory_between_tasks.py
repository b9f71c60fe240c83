"""What Python workers hold after a group, and the size of the pipeline's Arrow batches."""

import pyarrow as pa
import pytest

import corpus_pipeline
from lexloom.llm import jaccard_join, quality, substring_dedup, words

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_groups_release_their_memory(monkeypatch):
    seen = []
    monkeypatch.setattr(words, "release", lambda: seen.append(True))
    table = pa.table({"x": [1, 2]})
    assert words.released_group(lambda t: t.slice(1))(table).to_pydict() == {"x": [2]}
    assert seen == [True]
    for module in (jaccard_join, quality, substring_dedup):
        assert module.released_group is words.released_group


@pytest.mark.parametrize("own, left", [("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("100", 100)])
def test_stages_bound_the_rows_of_a_batch(spark, sf, own, left):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, own)
    try:
        docs = spark.createDataFrame([(i, f"one two three four five {i}" if i % 2 else "one two three four five six") for i in range(3000)], "doc_id long, text string")
        kept = corpus_pipeline.cut_repeated_passages(spark, docs, sf)
        assert int(spark.conf.get(BATCH)) == left
        assert kept.count() == 3000
    finally:
        spark.conf.set(BATCH, before)
