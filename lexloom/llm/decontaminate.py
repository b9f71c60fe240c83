"""Benchmark decontamination in DataFrame functions: a prefix-filtered set join.

An item is its windows of ``n`` words; a window is a set of positioned shingles of
two words. For exact containment all of a window's shingles must occur, so a
prefix of one shingle is enough to find it, and the rarest one joins the fewest
positions. Shingles are therefore ordered by their count over all documents, and
each window joins on its rarest. The length bound (the document has the words
left for the whole window) and the positional bound (the window would begin at
or after the first word) are applied in the join, and the words of the
item-sized document window are compared with those of the item's.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with
A-Z in lower case. Documents are read twice and never shuffled as texts: the
shingles of a document are exploded and probe a table of the benchmark, which is
broadcast only if it has at most ``BROADCAST_WINDOWS`` windows. Otherwise shingles are
joined by hash, each with the words around it that any window can reach (2n - 2), so
what is shuffled grows with the words of a document and not with their square; a
shingle that very many documents have is split by AQE's skew join, as the other side
of the join has few rows of it.

Defined results: null and empty texts have no words and are clean. Items null, or
without words, or with a null item_id take no part. Rows that repeat a doc_id with
the same text get the same figures; with other texts, each its own. Rows with a
null doc_id are judged as others are. Without documents the result is empty, without
items all are clean. Texts are read whole, however long. Columns of the documents that are named like
a result's are replaced; others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Windows that a broadcast table may have: about 200 bytes each, so some 20 MB.
BROADCAST_WINDOWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the lower-cased words; empty for null."""
    # lower() alone would also fold letters outside ASCII.
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(low, _OTHER), lambda w: w != "")


def _shingles(array: Column, size: int) -> Column:
    if size == 1:
        return F.transform(array, lambda w: F.xxhash64(w))
    return F.transform(array, lambda w, i: F.xxhash64(w, F.get(array, i + 1)))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """One row for each window: item_id, win (its words)."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("win"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Columns of ``docs`` and n_words, n_hit (words inside an occurring window) and items (sorted ids, as strings)."""
    docs = docs.drop("n_words", "n_hit", "items")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(F.xxhash64("doc_id", "text").alias("key"), words(F.col("text")).alias("w"))
    windows = item_windows(benchmark, n).groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    small = F.broadcast if few else lambda df: df
    hits = None
    for size in (1, 2):
        # Windows of a single word have no shingle of two; that branch is left out where no item needs it.
        own = windows.where(F.size("win") == 1 if size == 1 else F.size("win") > 1)
        if size == 1 and own.isEmpty():
            continue
        every = own.select("win", "items", F.posexplode(_shingles(F.col("win"), size)).alias("at", "shingle"))
        every = every.where(F.col("at") <= F.size("win") - size)
        probes = found.select("key", "w", F.posexplode(_shingles(F.col("w"), size)).alias("pos", "shingle"))
        probes = probes.withColumn("n", F.size("w")).withColumn("low", F.lit(0))
        if not few:
            low = F.greatest(F.col("pos") - (n - 1), F.lit(0))
            probes = probes.withColumn("low", low).withColumn("w", F.slice("w", F.col("low") + 1, 2 * n - 1))
        counts = probes.select("shingle").join(small(every.select("shingle").distinct()), "shingle", "left_semi").groupBy("shingle").count()
        rarity = every.join(counts, "shingle", "left").withColumn("df", F.coalesce("count", F.lit(0)))
        prefix = rarity.groupBy("win").agg(F.min_by(F.struct("items", "at", "shingle", "df"), F.struct("df", "at")).alias("x")).select("win", "x.*")
        prefix = prefix.where("df > 0").drop("df")
        start = F.col("pos") - F.col("at")
        bounds = (start >= 0) & (start + F.size("win") <= F.col("n"))
        # slice() fails on a start below 1, and the order in which AND is evaluated is not ours.
        same = F.slice("w", F.greatest(start - F.col("low") + 1, F.lit(1)), F.size("win")) == F.col("win")
        probe = probes.alias("p").join(small(prefix).alias("b"), (F.col("p.shingle") == F.col("b.shingle")) & bounds & same)
        probe = probe.select("key", "items", start.alias("start"), (start + F.size("win")).alias("stop"))
        hits = probe if hits is None else hits.unionByName(probe)
    if hits is None:
        return docs.select(*kept, F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    # A document's hits number as its words at most; equal spans are merged first.
    spans = hits.groupBy("key", "start").agg(F.max("stop").alias("stop"), F.flatten(F.collect_set("items")).alias("items"))
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["stop"]).alias("to"))
    spans = spans.select(F.col("key").alias("hit_key_"), F.aggregate("spans", zero, step, lambda s: s["n"]).alias("n_hit"), F.col("items").alias("items"))
    counted = docs.select(*kept, F.size(words(F.col("text"))).cast("long").alias("n_words"), F.xxhash64("doc_id", "text").alias("own_key_"))
    joined = counted.join(spans, F.col("own_key_") == F.col("hit_key_"), "left")
    return joined.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM bw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), lens AS (SELECT DISTINCT len(win) AS n FROM win
), place AS (
  SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, i, n, item_id FROM place JOIN win USING (win)
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
