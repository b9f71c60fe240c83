"""Forests against a walk in Python: random ones, chains, circles, broken rows."""

import random

from pyspark.sql import functions as F

from lexloom.operators import running, trees

SCHEMA = "id int, parent_id int, ord int, v string"


def walked(rows):
    """{id: (root, depth, place, size, value)} of sound rows."""
    own = {r[0]: r for r in rows}
    children = {}
    for i, p, o, _ in rows:
        children.setdefault(p if p in own else None, []).append((o, i))
    out, stack = {}, [(i, i, 0, None) for _, i in sorted(children.get(None, []), reverse=True)]
    while stack:
        i, root, depth, value = stack.pop()
        value = own[i][3] or value
        out[i] = [root, depth, len(out), 1, value]
        stack += [(c, root, depth + 1, value) for _, c in sorted(children.get(i, []), reverse=True)]
    for i in reversed(list(out)):
        if own[i][1] in out:
            out[own[i][1]][3] += out[i][3]
    return {i: tuple(x) for i, x in out.items()}


def made(nodes):
    place = {r.id: (r.depth, r.place) for r in trees.preorder(nodes).collect()}
    size = {r.id: r.size for r in trees.subtree_sizes(nodes).collect()}
    value = {r.id: r.v for r in trees.inherited(nodes, "v").collect()}
    return {r.id: (r.root, r.depth, place[r.id][1], size[r.id], value[r.id]) for r in trees.placed(nodes).collect() if r.root is not None and place[r.id][0] == r.depth}


def test_forests_against_a_walk(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, *range(1, i)] if rng.random() < 0.5 else [max(1, i - 1)]) if i > 1 else None, rng.randrange(4), rng.choice([None, None, "x", "y"])) for i in range(1, 200)]
    wanted = walked(rows)
    assert len(wanted) == len(rows)
    nodes = spark.createDataFrame(rows, SCHEMA)
    assert made(nodes) == wanted
    up = {(r.id, r.ancestor, r.depth) for r in trees.ancestors(nodes).collect()}
    parent = {r[0]: r[1] for r in rows}
    chain = set()
    for i in parent:
        a, depth = i, 0
        while a in parent:
            chain.add((i, a, depth))
            a, depth = parent[a], depth + 1
    assert up == chain
    top = {r.id: r.root for r in trees.roots_where(nodes, F.col("v").isNull() | (F.col("v") == "x")).collect()}
    for i in parent:
        a = i
        while parent[a] in parent and rows[parent[a] - 1][3] != "y":
            a = parent[a]
        assert top[i] == a


def test_deep_chain(spark):
    nodes = spark.range(1, 10_001).select(F.col("id").cast("int"), F.when(F.col("id") > 1, F.col("id") - 1).cast("int").alias("parent_id"), F.lit(0).alias("ord"))
    rows = trees.preorder(nodes)
    assert rows.where("depth = id - 1 and place = id - 1").count() == 10_000


def test_circles_and_broken_rows(spark):
    rows = [(1, 2, 0, "a"), (2, 1, 0, None), (3, 2, 0, None), (4, None, 1, "b"), (5, 4, 0, None), (5, 4, 0, None), (None, 4, 0, "c"), (6, 99, 0, None), (7, 7, 0, None)]
    nodes = spark.createDataFrame(rows, SCHEMA)
    assert {r.id: (r.root, r.depth) for r in trees.placed(nodes).collect()} == {1: (None, None), 2: (None, None), 3: (None, None), 4: (4, 0), 5: (4, 1), 6: (6, 0), 7: (None, None)}
    assert sorted((r.place, r.id) for r in trees.preorder(nodes).collect()) == [(0, 6), (1, 4), (2, 5)]
    assert {r.id: r.v for r in trees.inherited(nodes, "v").collect()} == {1: "a", 2: "a", 3: "a", 4: "b", 5: "b", 6: None, 7: None}
    assert {r.id for r in trees.walk_down(nodes).collect()} == {4, 5, 6}
    empty = nodes.limit(0)
    assert [f(empty).collect() for f in (trees.placed, trees.preorder, trees.ancestors, trees.walk_down, trees.subtree_sizes)] == [[]] * 5


def test_running_sums_of_a_hot_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.choice([None, 0, 1, 5])) for i in range(2000)]
    sums, wanted = {}, {}
    for g, i, v in rows:
        wanted[i] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (v or 0)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, i int, v int").repartition(7)
    assert {r.i: r.before for r in running.with_running(df, ["g"], ["i"], F.coalesce("v", F.lit(0))).collect()} == wanted
    assert running.with_running(df.limit(0), ["g"], ["i"], F.col("v")).collect() == []
