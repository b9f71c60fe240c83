"""Logs of edits: changes and the undos that take them back, and lists that keep the newest few of a kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Changes that can be taken back, and entries of a kind that a list keeps.
UNDO_LIMIT, LIST_LIMIT = 60, 10


def with_undone(log: DataFrame, key: str, order: str, undo: Column, limit: int = UNDO_LIMIT) -> DataFrame:
    """The changes of a log with ``undone_by``: the order of the undo that takes each back, or null.

    An undo takes back the newest change that still stands, unless ``limit`` changes have
    stood above that one since: the stack has forgotten it. As windows: a running sum
    with a floor gives each row its level of the stack; at one level changes and undos
    follow each other in turn; and a change ``limit`` levels higher is a mark between them.
    Order is distinct within a key; a null undo condition counts as a change. The first
    window holds one key's whole log, of narrow rows.
    """
    so_far = Window.partitionBy(key).orderBy(order)
    rows = log.withColumn("undo_", F.coalesce(undo, F.lit(False)))
    total = F.sum(F.when(F.col("undo_"), -1).otherwise(1)).over(so_far)
    rows = rows.withColumn("total_", total)
    floor = F.least(F.lit(0), F.min("total_").over(so_far))
    floor_before = F.coalesce(F.lag("floor_").over(so_far), F.lit(0))
    rows = rows.withColumn("floor_", floor).withColumn("void_", F.col("undo_") & (F.col("floor_") < floor_before))
    # The level of a change is the height of the stack with it, that of an undo the height before.
    rows = rows.withColumn("level_", F.col("total_") - F.col("floor_") + F.col("undo_").cast("long")).where("not void_").drop("void_", "total_", "floor_")
    marks = rows.where(~F.col("undo_") & (F.col("level_") > limit)).select(key, order, (F.col("level_") - limit).alias("level_"), F.lit(2).alias("kind_"))
    own = rows.select(key, order, "level_", F.col("undo_").cast("int").alias("kind_"))
    at_level = Window.partitionBy(key, "level_").orderBy(order)
    pairs = own.unionByName(marks).withColumns({"next_": F.lead(order).over(at_level), "next_kind_": F.lead("kind_").over(at_level)})
    undone = pairs.where("kind_ = 0 and next_kind_ = 1").select(F.col(key).alias("of_"), F.col(order).alias("change_"), F.col("next_").alias("undone_by"))
    changes = log.where(~F.coalesce(undo, F.lit(False)))
    return changes.join(undone, F.col(key).eqNullSafe(F.col("of_")) & (F.col(order) == F.col("change_")), "left").drop("of_", "change_")


def standing(log: DataFrame, key: str, order: str, undo: Column, limit: int = UNDO_LIMIT) -> DataFrame:
    """The changes that no undo has taken back."""
    return with_undone(log, key, order, undo, limit).where("undone_by is null").drop("undone_by")


def newest_few(rows: DataFrame, key: str, order: str, marks: str, most: int = LIST_LIMIT) -> DataFrame:
    """The entries (all columns, and place from 1) that a list of each key has in the end.

    Entries come in ``order``. One that shares an element of ``marks`` (an array of
    strings) with an entry of its key that is in the list then is left out; otherwise it
    is put at the end, and the key's first one goes where ``most`` are there already. So
    an entry that went may come again. Rows of a key are read in order as they stream
    through a task: what is held is ``most`` entries, however many rows a key has. A null
    key is a key; null marks are none; rows of one order come in any order.
    """
    names = rows.columns
    inner = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    sorted_rows = inner.repartition(at[key]).sortWithinPartitions(at[key], at[order])
    k, m = names.index(key), names.index(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []  # entries: marks and the row itself, a batch of one

        def out() -> list[pa.RecordBatch]:
            return [pa.RecordBatch.from_arrays([*row.columns, pa.array([i + 1], pa.int64())], names=[*row.schema.names, "place"]) for i, (_, row) in enumerate(kept)]

        for batch in batches:
            keys, own = batch.column(k).to_pylist(), batch.column(m).to_pylist()
            for i, (x, y) in enumerate(zip(keys, own, strict=True)):
                if now is None or x != now[0]:
                    yield from out()
                    now, kept = (x,), []
                y = set(y or ()) - {None}
                if not any(y & z for z, _ in kept):
                    kept = [*kept[len(kept) >= most :], (y, batch.slice(i, 1))]
        yield from out()

    made = sorted_rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in inner.dtypes) + ", place long")
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "place")
