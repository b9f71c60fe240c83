"""Exact top-k inner products: a Voronoi kNN join.

Pivots cut the space into cells; each vector belongs to the cell of its nearest
pivot, data after a common centre is taken off them (that changes all scores of a
query by one number, so not their order, and makes distances small). A data cell's
summary is its size and, of its members' distances to the pivot, some of the smallest
and the largest; a query cell's is its size and its largest distance r. For a query q
of the cell of P and a member x of the data cell of p, at most f from it, q.x lies
within P.p plus or minus r|p| + (|P| + r) f. So the summaries alone give each query
cell a score that k candidates of each of its queries reach, and a data cell takes
part only where its upper bound comes up to that.

Query cells are put together to groups of about ``QUERY_ROWS`` queries and data cells
to chunks of about ``CELL_ROWS`` vectors, neighbours first; a larger cell (a third of
all may be one vector) is dealt over several. A chunk is copied to a group only if
some cell of it takes part for some cell of the group; they are solved apart, cell by
cell, and the partial top k of each query merged. The tables of cells have at most
``MOST_PIVOTS`` rows, their pairs its square.

Where no bound can exclude anything (random directions in many dimensions, where all
distances are alike), all cells take part and this is the plain product in blocks.

Scores are exact: as doubles where no sum can reach 2**53, in integers up to 2**63;
larger ones are an error. Bounds have a margin for rounding.

Defined results: vectors null, empty, or with null or non-finite components, and rows
with a null id, take no part. Vectors of one length are compared with one another
(``MOST_LENGTHS`` lengths at most; more are an error). Ties go to the smaller id. Rows
that repeat an id are candidates each, but never of the same id's query. Queries with
fewer candidates than k get them all; no rows, no results. Only the columns named are
returned; further ones of the input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written
from .words import released

CELL_ROWS, QUERY_ROWS = 8192, 2048
MOST_PIVOTS, MOST_LENGTHS = 1024, 64
#: Rows that are compared with all pivots at a time.
STEP = 4096


def _matrix(column) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _assign(sent):
    """Columns id, v and the nearest pivot as data (cell, distance) and, without the centre taken off, as a query (side, apart)."""

    def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _distances(x, pivots).argmin(1)
        return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                first, centre, pivots = sent.value[length]
                own = batch.filter(pa.array(lengths == length))
                for at in range(0, own.num_rows, STEP):
                    part = own.slice(at, STEP)
                    x = _matrix(part.column(1)).astype(np.float64)
                    (cell, distance), (side, apart) = nearest(x - centre, pivots), nearest(x, pivots + centre)
                    yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, (cell + first, distance, side + first, apart))], names=["id", "v", "cell", "distance", "side", "apart"])

    return released(run)


def _bounds(asked: int, pivots: dict, queries: dict[int, float], data: dict[int, tuple[float, list[float]]]) -> np.ndarray:
    """Pairs (query cell, data cell) that take part, from the cells' summaries."""
    out = []
    for first, centre, own in pivots.values():
        mine, theirs = ([c for c in sorted(side) if first <= c < first + len(own)] for side in (queries, data))
        if not mine or not theirs:
            continue
        p, big = own[np.array(theirs) - first], own[np.array(mine) - first] + centre
        middle, length, r = big @ p.T, np.sqrt((p * p).sum(1)), np.array([queries[c] for c in mine])[:, None]
        far, reach = np.array([data[c][0] for c in theirs]), np.sqrt((big * big).sum(1))[:, None] + r
        slack = 1e-9 * (1 + np.abs(middle) + r * length + reach * far) + 1e-3
        upper = middle + r * length + reach * far + slack
        many = [len(data[c][1]) for c in theirs]
        lower = np.repeat(middle - r * length - slack, many, axis=1) - reach * np.concatenate([data[c][1] for c in theirs])
        reached = -np.partition(-lower, asked - 1, axis=1)[:, asked - 1 : asked] if lower.shape[1] >= asked else np.full((len(mine), 1), -np.inf)
        x, y = np.nonzero(upper >= reached)
        out.append(np.stack([np.array(mine)[x], np.array(theirs)[y]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _gathered(sizes: dict[int, int], most: int, pivots: dict) -> dict[int, tuple[int, int]]:
    """For each cell the number of its group and over how many parts the group is dealt; neighbours come together."""
    out, group, room = {}, -1, 0
    for first, _, own in pivots.values():
        open_, room = {c for c in sizes if first <= c < first + len(own)}, 0
        here = min(open_, default=None)
        while open_:
            open_.remove(here)
            if sizes[here] > room:
                group, room = group + 1, most
            out[here] = (group, max(1, -(-sizes[here] // most)))
            room -= sizes[here]
            if open_:
                rest = np.array(sorted(open_))
                here = int(rest[((own[rest - first] - own[here - first]) ** 2).sum(1).argmin()])
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; the least number of the type is below all of them."""
    most = np.sqrt((q.astype(np.float64) ** 2).sum(1).max() * (x.astype(np.float64) ** 2).sum(1).max())
    if most < 2**52:
        return q.astype(np.float64) @ x.T.astype(np.float64)
    if most < 2**62.9:
        return q @ x.T
    raise ValueError("scores beyond 64 bits")


def _solve(k: int, sent):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by("id")
        ids, cells, asked, sides = right.column("id").to_numpy(), right.column("cell").to_numpy(), left.column("query").to_numpy(), left.column("side").to_numpy()
        out = []
        for side in np.unique(sides).tolist():
            see = np.flatnonzero(np.isin(cells, sent.value.get(side, ())))
            own = np.flatnonzero(sides == side)
            if not len(see):
                continue
            x, q, named = _matrix(right.column("v").take(pa.array(see))), _matrix(left.column("q").take(pa.array(own))), ids[see]
            for at in range(0, len(own), 256):
                scores = _scores(q[at : at + 256], x)
                none = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
                for name, row in zip(asked[own[at : at + 256]].tolist(), scores, strict=True):
                    row[np.searchsorted(named, name) : np.searchsorted(named, name, side="right")] = none
                    best = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                    best = best[row[best] > none]
                    best = best[np.lexsort((named[best], *((-row[best],) if row.dtype == np.float64 else (~row[best],))))][:k]
                    out.append((np.full(len(best), name), named[best], row[best].astype(np.int64)))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score from vectors (id long, v array<long>, without nulls); is_query: condition on id.

    ``pivots`` is the root of the number of rows, 16 to ``MOST_PIVOTS``, unless it is given.
    """
    spark = vectors.sparkSession
    lengths = {r.n: r["count"] for r in vectors.groupBy(F.size("v").alias("n")).count().limit(MOST_LENGTHS + 1).collect()}
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths of vectors (MOST_LENGTHS)")
    schema = "query_id long, rank int, vec_id long, score long"
    if not lengths:
        return spark.createDataFrame([], schema)
    pivots = max(1, (pivots or min(MOST_PIVOTS, max(16, int(sum(lengths.values()) ** 0.5)))) // len(lengths))
    # One vector of a length from each of so many hash classes: a bounded sample, the same at every run.
    order = F.struct(F.xxhash64("v", F.lit(1)), "v")
    chosen = vectors.groupBy(F.size("v").alias("n"), F.pmod(F.xxhash64("v"), F.lit(pivots)).alias("class")).agg(F.min(order).alias("x"))
    rows: dict[int, list] = {}
    for r in chosen.select("n", F.col("x.v").alias("v")).toLocalIterator():
        rows.setdefault(r.n, []).append(r.v)
    cut, first = {}, 0
    for n in sorted(rows):
        own = np.array(sorted(rows[n]), np.float64)
        centre = own.mean(0)
        cut[n] = (first, centre, own - centre)
        first += len(own)
    sent = spark.sparkContext.broadcast(cut)
    data = written(vectors.select("id", "v").mapInArrow(_assign(sent), "id long, v array<long>, cell long, distance double, side long, apart double"), "cells")
    sent.destroy()
    # A query's own rows are no candidates, and an id that repeats may be in several cells.
    spread = data.groupBy("id").agg(F.countDistinct("cell").alias("n")).agg(F.max("n")).first()[0]
    asked = k + spread
    each = data.groupBy("cell", "id").agg(F.min("distance").alias("distance")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for group in (["cell", "part"], ["cell"]):  # ranks are cut in parts of a cell first
        each = each.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("distance"))).where(F.col("n") <= asked)
    near = {r.cell: r.near for r in each.groupBy("cell").agg(F.collect_list("distance").alias("near")).collect()}  # a row for each pivot at most, as below
    cells = {r.cell: r for r in data.groupBy("cell").agg(F.count("*").alias("many"), F.max("distance").alias("far")).collect()}
    queries = data.where(is_query).select("id", "v", "side", "apart")
    sides = {r.side: r for r in queries.groupBy("side").agg(F.count("*").alias("many"), F.max("apart").alias("far")).collect()}
    if not sides:
        return spark.createDataFrame([], schema)
    pairs = _bounds(asked, cut, {c: r.far for c, r in sides.items()}, {c: (r.far, near[c]) for c, r in cells.items()})
    groups, chunks = _gathered({c: r.many for c, r in sides.items()}, QUERY_ROWS, cut), _gathered({c: r.many for c, r in cells.items()}, CELL_ROWS, cut)
    meet: dict[int, list[int]] = {}
    for a, b in pairs.T.tolist():
        meet.setdefault(a, []).append(b)
    # Cells and the groups and chunks that they meet: no more rows than pairs of pivots.
    blocks = {g: n for g, n in groups.values()}
    parts = {c: n for c, n in chunks.values()}
    for_data = sorted({(b, chunks[b][0], parts[chunks[b][0]], groups[a][0], blocks[groups[a][0]]) for a, b in pairs.T.tolist()})
    for_queries = sorted({(a, chunks[b][0], parts[chunks[b][0]], groups[a][0], blocks[groups[a][0]]) for a, b in pairs.T.tolist()})
    names = "chunk long, parts long, group long, blocks long"
    by_cell, by_side = (F.broadcast(spark.createDataFrame(x, f"{c} long, {names}")) for c, x in (("cell", for_data), ("side", for_queries)))
    spread_over = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    part, block = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks"))
    dealt = data.select("id", "v", "cell").join(by_cell, "cell").select("id", "v", "cell", "chunk", "group", part.alias("part"), spread_over("blocks").alias("block"))
    routed = queries.select("id", "v", "side").join(by_side, "side").select(F.col("id").alias("query"), F.col("v").alias("q"), "side", "chunk", "group", spread_over("parts").alias("part"), block.alias("block"))
    keys = ("chunk", "group", "part", "block")
    seen = spark.sparkContext.broadcast({a: np.array(b) for a, b in meet.items()})
    found = routed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_solve(k, seen), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled_vectors(embeddings: DataFrame, factor: int = 1024) -> DataFrame:
    """id and v = floor(factor * component); rows that can take no part are left out. Components of 2**62 or more are an error."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0))
    scaled = lambda x: x.cast("double") * factor
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**62, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("component beyond 62 bits")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", whole).alias("v"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    vectors = scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
