"""Connected components of a table of links, by alternating large-star and small-star steps.

A table of at most ``FEW`` links (16 MB) is solved in one task; larger ones take the
steps, each written, until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import written

#: Links that one task may solve.
FEW = 1 << 20


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours, and itself, to its least neighbour or itself."""
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # The least neighbour is a partial aggregate, so a node with very many links is no burden to one task;
    # AQE splits its partition of the join.
    joined = both.join(least, "a")
    moved = joined.where("b > a") if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the least node that each can reach."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(open_ := np.flatnonzero(root[x] != root[y])):
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while not np.array_equal(root, further := root[root]):
            root = further
    return node, node[root]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if found:
        node, least = least_nodes(*(np.concatenate(c) for c in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """node and component (least node reachable) of every node of the links (a, b); both long, not null."""
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    if now.count() <= FEW:
        return written(now.coalesce(1).mapInArrow(_solve, "node long, component long"), "classes")
    before = None
    while True:
        now = written(_star(_star(now, True), False), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
