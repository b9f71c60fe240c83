"""Queries on logs of edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits
from .registry import query


@query("""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, value < 45 AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), s(user_id, i, stack, popped, taker) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM events
  UNION ALL
  SELECT s.user_id, e.i, CASE WHEN e.undo THEN list_slice(s.stack, 1, len(s.stack) - 1) ELSE list_slice(list_append(s.stack, e.event_id), greatest(1, len(s.stack) - 1), len(s.stack) + 1) END,
    CASE WHEN e.undo THEN s.stack[len(s.stack)] END, e.event_id
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1
)
SELECT e.user_id, e.event_id, p.taker AS undone_by FROM e LEFT JOIN (SELECT user_id, popped, taker FROM s WHERE popped IS NOT NULL) p ON p.user_id = e.user_id AND p.popped = e.event_id WHERE NOT e.undo
""")
def undone_changes(t):
    """Each change of a user's log and the undo that takes it back, where three can be taken back."""
    log = t("events").select("user_id", "event_id", "value")
    return edits.with_undone(log, "user_id", "event_id", F.col("value") < 45, limit=3).drop("value")


@query("""
WITH RECURSIVE e AS (
  SELECT l_suppkey, rid, {'rid': rid, 'a': l_partkey % 50, 'b': l_partkey % 7 * 100 + CAST(l_quantity AS BIGINT) % 10} AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY rid) AS i
  FROM (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rid FROM lineitem)
), s(l_suppkey, i, kept) AS (
  SELECT DISTINCT l_suppkey, CAST(0 AS BIGINT), CAST([] AS STRUCT(rid BIGINT, a BIGINT, b BIGINT)[]) FROM e
  UNION ALL
  SELECT s.l_suppkey, e.i, CASE WHEN len(list_filter(s.kept, lambda k: k.a = e.x.a OR k.b = e.x.b)) > 0 THEN s.kept ELSE list_slice(list_append(s.kept, e.x), greatest(1, len(s.kept) - 8), len(s.kept) + 1) END
  FROM s JOIN e ON e.l_suppkey = s.l_suppkey AND e.i = s.i + 1
)
SELECT l_suppkey, k.rid AS rid, place FROM (SELECT l_suppkey, unnest(kept) AS k, generate_subscripts(kept, 1) AS place FROM (SELECT l_suppkey, arg_max(kept, i) AS kept FROM s GROUP BY l_suppkey))
""")
def newest_lines(t):
    """The ten newest unlike lines that a list of each supplier keeps, lines being alike by either of two marks."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = t("lineitem").withColumn("rid", F.col("l_orderkey") * 1000 + number)
    marks = F.array(F.concat(F.lit("a"), F.col("l_partkey") % 50), F.concat(F.lit("b"), F.col("l_partkey") % 7 * 100 + F.col("l_quantity").cast("long") % 10))
    return edits.newest_few(rows.select("l_suppkey", "rid", marks.alias("marks")), "l_suppkey", "rid", "marks").drop("marks")
