"""Forests of parent pointers, at any depth: roots, ancestors, inheritance and pre-order.

Pointers are doubled: after k steps each node points 2^k levels up, so a forest of depth
d takes about log2(d) joins on the node. Each step is written to the shared folder.
Nodes are (id, parent_id, ord); rows without an id are left out, of those with the same
id the least (parent_id, ord) counts, and a node whose parent is not there is a root.
Nodes in a circle, or below one, have no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .running import with_running, written


def _sound(nodes: DataFrame, *extra: str) -> DataFrame:
    """One row for each id, with null for a parent that is not there."""
    rest = [c for c in ("ord", *extra) if c in nodes.columns]
    one = nodes.where("id is not null").groupBy("id").agg(F.min(F.struct("parent_id", *rest)).alias("n_")).select("id", "n_.*")
    there = one.select(F.col("id").alias("parent_id"), F.lit(True).alias("there_"))
    return one.join(there, "parent_id", "left").select("id", F.when(F.col("there_"), F.col("parent_id")).alias("parent_id"), *rest)


def _climb(start: DataFrame, gathered: dict) -> DataFrame:
    """(id, up, root, columns of ``gathered``) from (id, up, columns): each column joined over the nodes from the id to its root.

    ``gathered`` says for each column how the part of the lower nodes and that of the
    upper ones become one. After as many steps as a chain of all nodes would take, the
    nodes that still point up are those of circles; their root is null.
    """
    state = written(start.withColumn("root", F.when(F.col("up").isNull(), F.col("id"))), "climb")
    for _ in range(state.count().bit_length() + 1):
        pointing = state.where("up is not null")
        if pointing.isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up_"), F.col("root").alias("root_"), *[F.col(c).alias(f"{c}_") for c in gathered])
        moved = pointing.join(above, "up").select("id", F.col("up_").alias("up"), F.col("root_").alias("root"), *[how(F.col(c), F.col(f"{c}_")).alias(c) for c, how in gathered.items()])
        state = written(state.where("up is null").unionByName(moved), "climb")
    return state


def placed(nodes: DataFrame) -> DataFrame:
    """(id, root, depth): the root above each node and the steps to it; both null for nodes of circles."""
    start = _sound(nodes).select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("n"))
    return _climb(start, {"n": lambda a, b: a + b}).select("id", "root", F.when(F.col("root").isNotNull(), F.col("n") - 1).cast("int").alias("depth"))


def roots_where(nodes: DataFrame, passable: Column) -> DataFrame:
    """(id, root): how far up each node gets where a step to a parent is only made if ``passable``, a condition on the parent's columns, is true."""
    names = [c for c in nodes.columns if c not in ("id", "parent_id", "ord")]
    sound = _sound(nodes, *names)
    fit = sound.where(passable).select(F.col("id").alias("parent_id"), F.col("id").alias("up"))
    start = sound.join(fit, "parent_id", "left").select("id", "up")
    return _climb(start, {}).select("id", "root")


def inherited(nodes: DataFrame, value: str) -> DataFrame:
    """(id, value): each node's own value or that of its nearest ancestor that has one."""
    sound = _sound(nodes, value)
    start = sound.select("id", F.when(F.col(value).isNull(), F.col("parent_id")).alias("up"))
    source = sound.select(F.col("id").alias("root"), value)
    return _climb(start, {}).select("id", "root").join(source, "root", "left").select("id", value)


def walk_down(nodes: DataFrame) -> DataFrame:
    """(root, id, depth, path): every node under its root, with the sort path of the pre-order; nodes of circles are left out.

    A path is as long as its node is deep; ``preorder`` gives the same order by numbers.
    """
    sound = written(_sound(nodes), "nodes")
    rooted = placed(sound).where("root is not null")
    own = F.lpad(F.col("ord").cast("string"), 10, "0")
    start = sound.join(rooted.select("id"), "id").select("id", F.col("parent_id").alias("up"), own.alias("path"))
    paths = _climb(start, {"path": lambda a, b: F.concat(b, F.lit("/"), a)})
    return rooted.join(paths.select("id", "path"), "id").select("root", "id", "depth", "path")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth): each node and all above it, itself at depth 0; nodes of circles are left out.

    As many rows as all depths together.
    """
    sound = written(_sound(nodes), "nodes")
    kept = sound.join(placed(sound).where("root is not null").select("id"), "id")
    up = written(kept.select("id", F.col("parent_id").alias("up")), "up")
    pairs = written(kept.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")), "ancestors")
    step = 1
    while not up.where("up is not null").isEmpty():
        pointing = up.where("up is not null")
        further = pointing.join(pairs.withColumnRenamed("id", "up"), "up").select("id", "ancestor", (F.col("depth") + step).alias("depth"))
        pairs = written(pairs.unionByName(further), "ancestors")
        up = written(pointing.join(up.select(F.col("id").alias("up"), F.col("up").alias("up_")), "up").select("id", F.col("up_").alias("up")), "up")
        step *= 2
    return pairs


def _sized(sound: DataFrame) -> DataFrame:
    """(id, size) of each node's subtree. Nodes of circles, and below them, still point up after all steps and are left out; no rooted node counts them."""
    state = written(sound.select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("size")), "sizes")
    for _ in range(state.count().bit_length() + 1):
        pointing = state.where("up is not null")
        if pointing.isEmpty():
            break
        below = pointing.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more_"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up_"))
        moved = pointing.join(above, "up").select("id", F.col("up_").alias("up"), "size").unionByName(state.where("up is null"))
        state = written(moved.join(below, "id", "left").select("id", "up", (F.col("size") + F.coalesce("more_", F.lit(0))).alias("size")), "sizes")
    return state.where("up is null").select("id", "size")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """(id, size): nodes of each node's subtree, itself included; nodes of circles are left out.

    After k steps a node has counted its descendants up to 2^k levels below: it takes
    over the counts of all that point to it.
    """
    return _sized(written(_sound(nodes), "nodes"))


def preorder(nodes: DataFrame) -> DataFrame:
    """(id, depth, place): the walk of the forest, numbered from 0, children and roots by (ord, id); nodes of circles are left out.

    A node comes one place after its parent, and after the subtrees of its siblings
    before it; the places are the sums of these steps up to the root.
    """
    sound = written(_sound(nodes), "nodes")
    sized = sound.join(_sized(sound), "id")
    before = with_running(sized, ["parent_id"], ["ord", "id"], F.col("size"))
    step = F.col("before") + F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    start = before.select("id", F.col("parent_id").alias("up"), step.alias("place"), F.lit(1).cast("long").alias("n"))
    return _climb(start, {"place": lambda a, b: a + b, "n": lambda a, b: a + b}).select("id", (F.col("n") - 1).cast("int").alias("depth"), "place")
