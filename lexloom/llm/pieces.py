"""Texts as sequences of distinct pieces, for results that depend on a piece alone.

Work on a piece is done once for the whole corpus: ``counted`` gives the distinct
pieces and how often they occur (equal pieces meet in the map tasks first, so a hot
one is no load), the caller makes a record of each, and ``coded`` writes every text as
codes of its pieces. The most frequent pieces (``FREQUENT`` at most, a bound whatever
the corpus) are looked up in a dictionary sent to all tasks; the rare ones stay with
their row and fetch their records by a join on the piece (``fetched``). A rare piece
has no more occurrences than the least frequent one of the dictionary, so no key of
that join is hot. Nothing is approximated: every piece gets its own record.
"""

from __future__ import annotations

import io
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import written
from .words import release, released

#: Entries of the dictionary that is sent to all tasks, at most.
FREQUENT = 1 << 19


def pieces_of(text: Column, pattern: str) -> Column:
    """The text cut at each place that the pattern (of lookarounds alone, of the same meaning in Java and Python) matches."""
    return F.split(text, pattern)


def counted(texts: DataFrame, pieces: Column, weight: Column | None = None) -> DataFrame:
    """Distinct piece and n, the sum of the rows' weights (1 where none is given)."""
    rows = texts.select(F.explode(pieces).alias("piece"), (F.lit(1) if weight is None else weight).cast("long").alias("weight_"))
    return rows.groupBy("piece").agg(F.sum("weight_").alias("n"))


def level(n: str = "n") -> Column:
    """Sixteen levels for each power of two: the counts' order, with few enough values to be listed."""
    return F.floor(F.log2(F.col(n) + 1) * 16).cast("int")


def least_level(records: DataFrame, most: int, n: str = "n") -> int:
    """The level from which on there are ``most`` records or somewhat fewer."""
    least, total = 1 << 30, 0
    for row in sorted(records.groupBy(level(n).alias("level")).count().collect(), reverse=True):  # some hundred levels
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return least


def parted(records: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The records of the most frequent pieces, ``most`` or somewhat fewer, and all others."""
    least = least_level(records, FREQUENT if most is None else most)
    return records.where(level() >= least), records.where(level() < least)


class Dictionary:
    """Records of the frequent pieces, as it is sent to the tasks; a worker builds the index once."""

    def __init__(self, records: DataFrame):
        table = records.drop("n").toArrow().combine_chunks()  # FREQUENT rows at most
        self.size, self.content = table.num_rows, {}
        for name in table.column_names:  # each by itself: a task takes up those that it needs
            sink = io.BytesIO()
            part = table.select([name])
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            self.content[name] = sink.getvalue()

    def __getstate__(self):
        return {"size": self.size, "content": self.content}

    def column(self, name: str) -> pa.Array:
        column = pa.ipc.open_stream(self.content[name]).read_all().combine_chunks()[name]
        return column.chunk(0) if column.num_chunks else pa.array([], column.type)

    @cached_property
    def codes(self) -> dict[str, int]:
        release()  # what an earlier task of this worker has left
        return {x.as_py(): i for i, x in enumerate(self.column("piece"))}


def coded(docs: DataFrame, pattern: str, prefix: str, sent: Broadcast, keep: tuple[str, ...], name: str) -> DataFrame:
    """Written rows of the columns ``keep``, as c0, c1, ..., and row (a number of its own), codes and rare.

    A code is the entry's number in the dictionary or, from the dictionary's size on,
    a place in ``rare``, the distinct other pieces of the row. Null texts have no codes.
    """
    names = [*keep, "text"]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cut, first = sent.value.codes, re.compile(pattern).split, TaskContext.get().partitionId() << 40
        size = sent.value.size
        for batch in batches:
            made, rare = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                if text is None:
                    made.append(None)
                    rare.append([])
                    continue
                parts, own = cut(prefix + text), {}
                found = array("i", map(codes.get, parts, repeat(-1)))
                at = -1
                for _ in range(found.count(-1)):
                    at = found.index(-1, at + 1)
                    found[at] = own.setdefault(parts[at], size + len(own))
                made.append(found.tobytes())
                rare.append(list(own))
            rows = pa.array(np.arange(first, first + batch.num_rows), pa.int64())
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows, pa.array(made, pa.binary()), pa.array(rare, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "row", "codes", "rare"])

    schema = "".join(f"{c} {kind}, " for c, kind in plain.dtypes[:-1]) + "row long, codes binary, rare array<string>"
    rows = plain.mapInArrow(released(run), schema)
    return written(rows, name)


def summed(rows: DataFrame, records: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of each row and its sums of ``columns``: s0, s1, ... of its row, and its rare pieces' own.

    rows: c0, c1, ... (the columns kept), row, s0, s1, ... (double) and rare, its rare pieces, repeats and all.
    """
    own = fetched(rows, records).groupBy(F.col("row").alias("own_row_")).agg(*[F.sum(c).alias(f"own_{k}_") for k, c in enumerate(columns)])
    joined = rows.drop("rare").join(own, F.col("row") == F.col("own_row_"), "left")
    sums = [(F.col(f"s{k}") + F.coalesce(F.col(f"own_{k}_"), F.lit(0))).alias(c) for k, c in enumerate(columns)]
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *sums)


def fetched(rows: DataFrame, records: DataFrame) -> DataFrame:
    """row, place and the record's columns for each rare piece of each row."""
    rare = rows.select("row", F.posexplode("rare").alias("place", "piece"))
    return rare.join(records.drop("n"), "piece").drop("piece")


def assembled(rows: DataFrame, records: DataFrame, make: Callable, schema: str, columns: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """``make`` applied to each Arrow batch of the rows with ``rare_records``: an array of (place, *columns) of their rare pieces."""
    own = fetched(rows, records).groupBy(F.col("row").alias("own_row_")).agg(F.collect_list(F.struct("place", *columns)).alias("rare_records"))
    joined = rows.drop("rare").join(own, F.col("row") == F.col("own_row_"), "left").select(*keep, "codes", F.coalesce("rare_records", F.array()).alias("rare_records"))
    return joined.mapInArrow(released(make), schema)
