"""Queries on rules of typed tables: curves, orders, inventories, groups and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import game
from .registry import query

_CURVES = ("medium", "erratic", "fluctuating", "parabolic", "fast", "slow")
_CURVE_SQL = "CASE WHEN n <= 1 THEN 0 WHEN c = 0 THEN n * n * n WHEN c = 1 AND n <= 50 THEN n * n * n * (100 - n) // 50 WHEN c = 1 AND n <= 68 THEN n * n * n * (150 - n) // 100 WHEN c = 1 AND n <= 98 THEN n * n * n * ((1911 - 10 * n) // 3) // 500 WHEN c = 1 AND n <= 100 THEN n * n * n * (160 - n) // 100 WHEN c = 1 THEN n * n * n * n * 3 // 500 WHEN c = 2 AND n <= 15 THEN n * n * n * (24 + (n + 1) // 3) // 50 WHEN c = 2 AND n <= 35 THEN n * n * n * (14 + n) // 50 WHEN c = 2 AND n <= 100 THEN n * n * n * (32 + n // 2) // 50 WHEN c = 2 THEN CAST(floor(n * n * n * n * greatest(82 - (n - 100) / 2.0, 40.0) / 5000) AS BIGINT) WHEN c = 3 THEN n * n * n * 6 // 5 - 15 * n * n + 100 * n - 140 WHEN c = 4 THEN n * n * n * 4 // 5 ELSE n * n * n * 5 // 4 END"


@query(f"SELECT p_partkey, CAST({_CURVE_SQL} AS BIGINT) AS points FROM (SELECT p_partkey, p_partkey % 6 AS c, CAST(1 + p_partkey % 180 AS BIGINT) AS n FROM part)")
def level_thresholds(t):
    """Points of six curves."""
    curve = F.get(F.array(*map(F.lit, _CURVES)), (F.col("p_partkey") % 6).cast("int"))
    return t("part").select("p_partkey", game.threshold(curve, 1 + F.col("p_partkey") % 180).alias("points"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_suppkey % 2 <> b.s_suppkey % 2 AND (a.s_suppkey % 5 = b.s_suppkey % 5 OR a.s_suppkey % 5 = b.s_suppkey % 3 OR a.s_suppkey % 3 = b.s_suppkey % 5 OR a.s_suppkey % 3 = b.s_suppkey % 3)")
def compatible_pairs(t):
    """Pairs of one nation that share a group and differ in gender: classes of equal groups and gender are matched, and their members listed."""
    k = F.col("s_suppkey")
    s = t("supplier").select("s_nationkey", k.alias("k"), F.array_sort(F.array_distinct(F.array(k % 5, k % 3))).alias("g"), (k % 2).alias("sex"))
    return game.compatible_pairs(s, ["s_nationkey"], "k", "g", "sex")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 10 BETWEEN 1 AND 8 THEN p_size % 10 ELSE 0 END AS INT) AS place, p_size % 2 = 0 AS flagged FROM part")
def places_and_flags(t):
    flags = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Heavy"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return t("part").select("p_partkey", game.place_in(F.sequence(F.lit(1), F.lit(8)), F.col("p_size") % 10).alias("place"), game.has_flag(flags, "heavy").alias("flagged"))


@query("SELECT l_orderkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY ALL")
def bag_quantities(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("many"))
    return game.quantity(rows, "l_orderkey", "l_partkey")


@query("SELECT p_partkey, CASE WHEN 9 + 4 + p_size > 10 + 10 + 10 THEN '9,4' WHEN p_size <= 1 THEN '10,4' WHEN p_size <= 7 THEN '10,' || (3 + p_size) ELSE '10,10,' || (p_size - 7) END AS slots FROM part")
def stored_items(t):
    """Slots of ten filled up and begun, three at most; all or nothing."""
    made = game.stored(F.array(F.lit(9).cast("long"), F.lit(4).cast("long")), F.col("p_size"), 10, 3)
    return t("part").select("p_partkey", F.array_join(F.transform(made, lambda x: x.cast("string")), ",").alias("slots"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3 DESC, l_suppkey % 2 DESC, CASE WHEN l_orderkey % 2 = 0 THEN -l_quantity ELSE l_quantity END DESC, l_linenumber DESC) AS INT) AS turn FROM lineitem")
def turn_order(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("priority"), (F.col("l_suppkey") % 2).alias("sub_priority"), F.col("l_quantity").alias("speed"), (F.col("l_orderkey") % 2 == 0).alias("reversed"), F.col("l_linenumber").alias("draw"))
    return game.turn_order(rows, "l_orderkey").select("l_orderkey", "l_linenumber", "turn")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END, o_orderkey) AS INT) AS place FROM orders")
def specials_first(t):
    rows = t("orders").select("o_custkey", "o_orderkey")
    return game.specials_first(rows, "o_custkey", F.col("o_orderkey") % 5 == 0, "o_orderkey")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey END, o_orderkey) AS INT) AS place FROM orders WHERE o_totalprice > 50000")
def handler_order(t):
    """By a given order where there is one, else by position; rows that meet the condition alone."""
    rows = t("orders").where("o_totalprice > 50000").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("long")).alias("given"))
    return game.by_given_order(rows, "o_custkey", "given", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT p_partkey, array_to_string(list_distinct(list_concat(list_sort(list_filter([0, 1, 2, 3], lambda x: x % 2 = p_partkey % 2)), [9])), ',') AS moves FROM part".replace("list_distinct(", "(", 1))
def inherited_moves(t):
    """What both have and may pass on, then one's own."""
    k = (F.col("p_partkey") % 2).cast("int")
    four = F.sequence(F.lit(0), F.lit(5))
    both = F.filter(four, lambda x: x % 2 == k)
    made = game.inherited_set(F.sequence(F.lit(0), F.lit(3)), F.array(F.lit(9)), four, both)
    return t("part").select("p_partkey", F.array_join(F.transform(made, lambda x: x.cast("string")), ",").alias("moves"))


@query("WITH c AS (SELECT c_nationkey AS owner, unnest([c_mktsegment, 'x']) AS type FROM customer), n AS (SELECT owner, type, CASE WHEN count(*) >= 5 THEN least(count(*) // 4, 10) ELSE 0 END AS w FROM c GROUP BY ALL) SELECT owner, type, CAST(CASE WHEN sum(w) OVER (PARTITION BY owner) = 0 THEN 1 ELSE w END AS INT) AS weight FROM n")
def type_shares(t):
    rows = t("customer").select(F.col("c_nationkey").alias("owner"), F.array("c_mktsegment", F.lit("x")).alias("types"))
    return game.type_share(rows, "owner", "types")


@query("SELECT p_partkey, CAST(least(greatest(p_size, 10), 40) AS INT) AS level FROM part")
def suggested_levels(t):
    return t("part").select("p_partkey", game.suggested_level(F.lit(10), F.lit(40), F.col("p_size")).alias("level"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'Land' WHEN hour(ts) < 5 OR hour(ts) >= 20 THEN CASE WHEN user_id % 3 = 1 THEN 'LandNight' ELSE 'Land' END WHEN hour(ts) < 10 THEN CASE WHEN user_id % 3 = 1 THEN 'LandMorning' ELSE 'LandDay' END ELSE 'LandDay' END AS kind FROM events")
def kinds_by_time(t):
    """The kind for the part of the day that a map has."""
    from ..operators.ranking import day_part

    k = F.col("user_id") % 3
    have = F.when(k == 0, F.array(F.lit("Land"))).when(k == 1, F.array(*map(F.lit, ("Land", "LandDay", "LandMorning", "LandNight")))).otherwise(F.array(F.lit("Land"), F.lit("LandDay")))
    return t("events").select("event_id", game.by_time(F.lit("Land"), day_part(F.col("ts")), have).alias("kind"))


@query("SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'a>b>c' WHEN p_size < 20 THEN 'b>c' ELSE 'c' END AS steps FROM part WHERE p_size < 30")
def save_conversions(t):
    """Conversions after a record's version, in the order of theirs."""
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version"))
    steps = rows.sparkSession.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "to int, name string")
    return game.applied_conversions(rows, steps, "version")


@query("SELECT 'r/' || (p_size % 4) || '/x' || p_partkey || '/y' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'r/' || (p_size % 4) || '/x' || p_partkey ELSE 'r/' || (p_size % 4) END AS root FROM part WHERE p_size % 4 < 3")
def nearest_roots(t):
    """The deepest folder above each path that is a root."""
    p = t("part")
    top = F.concat(F.lit("r/"), (F.col("p_size") % 4).cast("string"))
    inner = F.concat(top, F.lit("/x"), "p_partkey")
    roots = p.where("p_size % 4 < 3").select(top.alias("root")).union(p.where("p_size % 4 < 3 and p_partkey % 5 = 0").select(inner)).distinct()
    return game.nearest_root(p.select(F.concat(inner, F.lit("/y")).alias("path")), roots)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'party' WHEN 1 THEN 'box' END AS kind, CAST(CASE WHEN p_partkey % 3 = 1 THEN p_size END AS INT) AS box, CAST(CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS INT) AS slot FROM part")
def locators(t):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("party:"), k)).when(k % 3 == 1, F.concat(F.lit("box:"), "p_size", F.lit(":"), k)).otherwise(F.lit("bag:x"))
    return t("part").select("p_partkey", game.locator(text).alias("l")).select("p_partkey", "l.kind", "l.box", "l.slot")


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size % 25 END AS INT) AS id FROM part")
def resolved_options(t):
    """Free texts as ids, internal names or labels of options."""
    n = t("nation").select(F.col("n_nationkey").alias("id"), F.upper(F.concat(F.lit("n_"), "n_nationkey")).alias("name"), F.concat(F.lit("Label "), "n_nationkey").alias("label"))
    own = (F.col("p_size") % 25).cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, own).when(k == 1, F.concat(F.lit("N_"), own)).when(k == 2, F.concat(F.lit("label "), own)).otherwise("none")
    return game.resolved(t("part").select("p_partkey", text.alias("text")), n).select("p_partkey", "id")


@query("SELECT page_id, md5(CASE WHEN strpos(html, '<p') > 0 THEN substr(html, 1, strpos(html, '<p') - 1) || '[block]' || substr(html, strpos(html, '<p') + 2) ELSE html END) AS digest FROM pages")
def spliced_blocks(t):
    """The first marker of a text replaced by a block."""
    return t("pages").select("page_id", F.md5(game.spliced(F.col("html"), "<p", F.lit("[block]"))).alias("digest"))


@query("SELECT p_partkey, round((p_size - 32) * 5 / 9.0, 2) AS c, round(p_size * 9.0 / 5 + 32, 2) AS f, regexp_replace(format('{:,}', p_partkey * 12345), ' ', '') AS money FROM part")
def conversions(t):
    return t("part").select("p_partkey", game.celsius(F.col("p_size")).cast("double").alias("c"), game.fahrenheit(F.col("p_size")).cast("double").alias("f"), game.thousands(F.col("p_partkey") * 12345).alias("money"))


@query("SELECT p_partkey, 'a=' || p_size || ',b=' || p_brand || ',c=' || p_name AS merged FROM part")
def merged_maps(t):
    old, new = F.create_map(F.lit("a"), F.col("p_size").cast("string"), F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), F.col("p_brand"), F.lit("c"), F.col("p_name"))
    entries = F.transform(F.array_sort(F.map_entries(game.merged_maps(old, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t("part").select("p_partkey", F.array_join(entries, ",").alias("merged"))


@query("WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id * 37 + user_id) % 100 AS draw FROM events), s(user_id, i, fired, chance) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 10 FROM events UNION ALL SELECT s.user_id, e.i, s.fired + CASE WHEN e.draw < s.chance THEN 1 ELSE 0 END, CASE WHEN e.draw < s.chance THEN 10 ELSE s.chance + 5 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) SELECT user_id, max(i) AS steps, arg_max(fired, i) AS fired, CAST(arg_max(chance, i) AS INT) AS chance FROM s GROUP BY user_id")
def chance_accumulator(t):
    """A chance that grows with each failure, per user, over the log at rest."""
    return game.accumulated(t("events"), "user_id", "event_id", (F.col("event_id") * 37 + F.col("user_id")) % 100)


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey) AS INT) AS place FROM customer")
def listed_order(t):
    """By name whatever the case, then by amount, then by key."""
    from pyspark.sql import Window

    order = Window.partitionBy("c_nationkey").orderBy(F.lower("c_mktsegment"), F.desc("c_acctbal"), "c_custkey")
    return t("customer").select("c_nationkey", "c_custkey", F.row_number().over(order).alias("place"))


@query("SELECT p_brand, count(DISTINCT p_name) AS names, count(DISTINCT CASE WHEN p_size % 4 = 0 THEN p_name END) AS base_forms, CAST(sum(p_size + p_partkey % 50) AS BIGINT) AS totals FROM part GROUP BY p_brand")
def record_counts(t):
    """Records counted once, those of the base form, and sums of their fields."""
    form = F.when(F.col("p_size") % 4 == 0, F.col("p_name"))
    return t("part").groupBy("p_brand").agg(F.countDistinct("p_name").alias("names"), F.countDistinct(form).alias("base_forms"), F.sum(F.col("p_size") + F.col("p_partkey") % 50).alias("totals"))
