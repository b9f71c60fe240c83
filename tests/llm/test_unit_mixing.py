"""contexts of op12 reach across words, and its weights follow the text that is scored."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.llm import context_mixing as cm, unit_mixing as um


def scores(spark, train, texts, frequent=None):
    rows = [(i, x) for i, x in enumerate(train)] + [(1000 + i, x) for i, x in enumerate(texts)]
    made = cm.language_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000, frequent)
    found = {r.doc_id: r.score for r in made.collect()}
    return [found[1000 + i] for i in range(len(texts))]


def test_what_a_word_says_about_the_next(spark):
    """The same units in another order: red goes before apple, blue before pear."""
    draw = random.Random(1)
    train = [" ".join(draw.choice(("red apple", "blue pear", "green plum")) for _ in range(40)) + " " for _ in range(60)]
    usual, unusual = "red apple blue pear green plum " * 6, "red pear blue plum green apple " * 6
    a, b = scores(spark, train, [usual, unusual])
    assert a > b + 5
    # Also where some units have no code word, but are spelled.
    a, b = scores(spark, train, [usual, unusual], 6)
    assert a > b + 1


def test_weights_follow_the_text(spark):
    """With weights that stand still, each further stretch of a repeated unit costs the same."""
    draw = random.Random(2)
    train = [" ".join(draw.choice("abcdefgh") for _ in range(60)) + " " for _ in range(60)]
    a, b, c = scores(spark, train, ["c " * n for n in (300, 600, 900)])
    assert (c - b) > (b - a) + 0.5


def test_code_words_are_a_distribution():
    draw = np.random.default_rng(3)
    counts = np.append(draw.integers(0, 50, 30), 5)
    code = um.Code(counts)
    made = [um.log_probabilities(um.Units(pa.RecordBatch.from_arrays([pa.array([np.array([x], np.int32).tobytes()]), pa.array([["new"]], pa.list_(pa.string()))], names=["codes", "rare"]), 30), um.Model(code, draw.integers(0, 9, 2 * um.SLOTS), um.first_weights()))[0] for x in [*np.flatnonzero(counts[:-1]), 30]]
    assert 0.3 < (10.0 ** np.array(made)).sum() <= 1 + 1e-5


def test_long_texts_and_many_short_ones_score_alike(spark):
    """Neither neighbours in a block nor the block's bounds change a score."""
    draw = random.Random(4)
    long = " ".join(draw.choice("abcdefgh") for _ in range(150_000))
    train = [long[i : i + 200] for i in range(0, 4000, 200)]
    many = scores(spark, train, [long[:4000], *[long[:50]] * 5000, long, long[:4000], long[:50]])
    assert np.allclose(many[0], many[-2], rtol=1e-6) and np.allclose(many[1:5001], many[-1], rtol=1e-6)
    assert many[-3] < many[0]
