"""Streams that stop and go on, rows out of order, control rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.streaming import state, tables

EVENTS = "k long, at long, kind string"


def folder_of(spark, tmp_path, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def random_files(seed, files=4, size=300):
    rng = random.Random(seed)
    at = iter(range(files * size))
    return [[(rng.randrange(40), next(at), rng.choice("abcdr")) for _ in range(size)] for _ in range(files)]


def test_merge_goes_on_in_a_new_session(spark, tmp_path, monkeypatch):
    files = random_files(1)
    where = folder_of(spark, tmp_path, files[:2])
    folder = str(tmp_path / "table")
    state.merge_batches(state.event_stream(spark, where), "k", "at", "m", folder)
    wanted = {k: max(at for kk, at, _ in files[0] + files[1] if kk == k) for k, _, _ in files[0] + files[1]}
    # The data of a batch is there, its manifest is not: the stream breaks, and starts again elsewhere.
    folder_of(spark, tmp_path, files[2:3])
    other = spark.newSession()
    with monkeypatch.context() as m:
        m.setattr(tables.KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            state.merge_batches(state.event_stream(other, where), "k", "at", "m", folder)
    table = tables.KeyedTable(other, folder, "k long, at long", ["k"])
    assert dict(rows_of(table.rows())) == wanted
    folder_of(spark, tmp_path, files[3:])
    made = state.merge_batches(state.event_stream(spark.newSession(), where), "k", "at", "m", folder)
    every = [r for f in files for r in f]
    assert dict(rows_of(made)) == {k: max(at for kk, at, _ in every if kk == k) for k, _, _ in every}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), "k long, n long", ["k"], buckets=8)
    put = lambda rows, n: table.merge(spark.createDataFrame(rows, "k long, n long"), n, lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n")))
    put([(k, 1) for k in range(40)], 0)
    put([(3, 5)], 1)
    first = table.manifest()
    assert sorted(set(first.values())) == [0, 1] and list(first.values()).count(1) == 1
    put([(3, 5)], 1)  # again: as if it had been done once
    assert table.manifest() == first and dict(rows_of(table.rows())) == {k: 6 if k == 3 else 1 for k in range(40)}


def test_rows_of_a_task_count_in_order(spark, tmp_path):
    n = 25_000
    rows = [(1, n - i, "done" if n - i == 100 else "log") for i in range(n)]
    where = folder_of(spark, tmp_path, [rows])
    made = state.latest(state.run_to_end(state.task_progress(state.event_stream(spark, where), "k", "kind", "at", "done", "failed"), "t", "update"), "k", "n")
    assert rows_of(made) == [(1, "done", 100)]


def test_control_rows_at_their_place(spark, tmp_path):
    files = [[(1, 1, "log"), (2, 2, "failed"), (3, 3, "log")], [(1, 4, "cancel"), (2, 5, "done"), (3, 7, "cancel"), (3, 6, "done"), (1, 8, "done"), (4, 9, "cancel")]]
    where = folder_of(spark, tmp_path, files)
    progress = lambda events: state.task_progress(events, "k", "kind", "at", "done", "failed", cancel="cancel")
    made = rows_of(state.latest(state.run_to_end(progress(state.event_stream(spark, where)), "t", "update"), "k", "n"))
    assert made == [(1, "cancelled", 2), (2, "failed then done", 2), (3, "done", 2), (4, "cancelled", 1)]
    assert rows_of(progress(spark.read.parquet(where))) == made


def test_generations_by_a_walk(spark, tmp_path):
    files = [[(None if kind == "r" and at % 5 == 0 else k % 4, at, kind) for k, at, kind in f] for f in random_files(3, size=60)]
    made = state.log_counts(state.event_stream(spark, folder_of(spark, tmp_path, files)), "k", "kind", "at", "r", "g", str(tmp_path / "g"))
    # Files come in the order of their writing.
    generation, seen = {}, {}
    for k, at, kind in (r for f in files for r in f):
        if kind == "r":
            for own in range(4) if k is None else [k]:
                generation[own] = generation.get(own, 0) + 1
            continue
        key = (k, generation.get(k, 0), kind)
        first, n = seen.get(key, (at, 0))
        seen[key] = (first, n + 1)
    assert rows_of(made) == sorted((*k, *v) for k, v in seen.items())
