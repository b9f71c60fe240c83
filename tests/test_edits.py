"""Undo logs against a stack, bounded lists against a walk, on random rows."""

import random

from pyspark.sql import functions as F

from lexloom.operators import edits


def test_undo_against_a_stack(spark):
    rng = random.Random(2)
    rows, wanted = [], []
    for key in (None, *range(5)):
        stack, undone = [], {}
        bias = rng.choice([0.3, 0.5, 0.6])
        for at in range(400):
            undo = None if rng.random() < 0.02 else rng.random() < bias
            rows.append((key, at, undo))
            if not undo:
                stack = [*stack, at][-4:]
            elif stack:
                undone[stack.pop()] = at
        wanted += [(key, at, undone.get(at)) for k, at, undo in rows if k == key and not undo]
    log = spark.createDataFrame(rows, "k int, at int, undo boolean")
    made = edits.with_undone(log, "k", "at", F.col("undo"), limit=4).select("k", "at", "undone_by").collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, wanted))
    assert edits.standing(log, "k", "at", F.col("undo"), limit=4).count() == sum(x[2] is None for x in wanted)
    assert edits.with_undone(log.limit(0), "k", "at", F.col("undo")).collect() == []


def test_newest_few_against_a_walk(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3]), at, rng.choice([None, [], [None], [rng.choice("abcdef"), rng.choice("uvwxyz")]]) if rng.random() < 0.9 else ["q"]) for at in range(900)]
    lists = {}
    for key, at, marks in rows:
        own, marks = lists.setdefault(key, []), set(marks or ()) - {None}
        if not any(marks & other for _, other in own):
            if len(own) >= 3:
                own.pop(0)
            own.append((at, marks))
    made = edits.newest_few(spark.createDataFrame(rows, "k int, at int, marks array<string>"), "k", "at", "marks", 3).collect()
    assert sorted(repr((r.k, r.at, r.place)) for r in made) == sorted(repr((k, at, i + 1)) for k, own in lists.items() for i, (at, _) in enumerate(own))
    assert edits.newest_few(spark.createDataFrame([], "k int, at int, marks array<string>"), "k", "at", "marks").collect() == []
