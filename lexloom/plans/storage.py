"""Queries on boxes and on lists whose entries strike out others."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import storage
from .registry import query

_LINES = "SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rid FROM lineitem"
_BOXES = "SELECT s_suppkey AS owner, box, 1 + (s_suppkey + box) % 30 AS size, box = s_suppkey % 30 AS current FROM supplier, (SELECT unnest(range(30)) AS box)"
_STORED = f"""
WITH boxes AS ({_BOXES}), arrivals AS (SELECT l_suppkey AS owner, rid FROM ({_LINES})),
free AS (SELECT owner, box, slot, current FROM (SELECT *, unnest(range(size)) AS slot FROM boxes) b WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = owner AND l_partkey % 30 = box AND l_linenumber * 2 = slot)),
k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY current DESC, box, slot) AS place FROM free),
put AS (SELECT a.owner, rid, CAST(box AS INT) AS box, CAST(slot AS INT) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rid) AS place FROM arrivals) a LEFT JOIN k ON a.owner = k.owner AND a.place = k.place)"""


def _lines(t):
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return t("lineitem").withColumn("rid", F.col("l_orderkey") * 1000 + number)


def _stored(t):
    k = F.col("owner")
    owners = t("supplier").select(F.col("s_suppkey").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("box"))
    boxes = owners.select("owner", "box", (1 + (k + F.col("box")) % 30).alias("size"), (F.col("box") == k % 30).alias("current"))
    taken = t("lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 30).cast("int").alias("box"), (F.col("l_linenumber") * 2).cast("int").alias("slot"))
    arrivals = _lines(t).select(F.col("l_suppkey").alias("owner"), "rid")
    return storage.stored(arrivals, boxes, taken, "owner", ["rid"]), boxes


@query(f"{_STORED} SELECT * FROM put")
def stored_lines(t):
    """Lines put away in their suppliers' boxes, from the current box on to those with space."""
    return _stored(t)[0]


@query(f"{_STORED} SELECT b.owner, CAST(coalesce(arg_max(put.box, rid) FILTER (WHERE put.box IS NOT NULL), any_value(b.box)) AS INT) AS box FROM (SELECT owner, box FROM boxes WHERE current) b LEFT JOIN put ON put.owner = b.owner GROUP BY b.owner")
def current_boxes(t):
    put, boxes = _stored(t)
    return storage.current_boxes(put, boxes, "owner", ["rid"])


_MOVES = f"""SELECT l_orderkey, rid, l_partkey % 2 AS type, CAST(l_quantity AS BIGINT) % 4 * 20 AS power, l_partkey % 5 * 20 AS accuracy,
    ['None', 'BadPoisonTarget', 'PoisonTarget', 'Flinch'][CAST(l_suppkey % 4 AS INT) + 1] AS function, 10 + l_suppkey % 3 * 5 AS pp FROM ({_LINES})"""


@query(f"""
WITH RECURSIVE m AS ({_MOVES}), s(l_orderkey, turn, kept) AS (
  SELECT l_orderkey, 1, list({{'rid': rid, 'type': type, 'power': power, 'accuracy': accuracy, 'function': function, 'pp': pp}} ORDER BY rid) FROM m GROUP BY l_orderkey
  UNION ALL
  SELECT l_orderkey, turn + 1, list_filter(kept, lambda b: NOT (
      (kept[turn].accuracy = 0 AND b.function = 'None' AND kept[turn].type = b.type AND kept[turn].power >= b.power)
      OR (kept[turn].function = b.function AND kept[turn].power = 0 AND b.power = 0 AND kept[turn].accuracy > b.accuracy)
      OR (kept[turn].function = 'BadPoisonTarget' AND b.function = 'PoisonTarget')
      OR (kept[turn].function = b.function AND kept[turn].power <> 0 AND kept[turn].type = b.type AND (kept[turn].pp IN (10, 15) OR kept[turn].pp = b.pp)
          AND (kept[turn].power > b.power OR (kept[turn].power = b.power AND kept[turn].accuracy > b.accuracy)))))
  FROM s WHERE turn <= len(kept)
)
SELECT l_orderkey, unnest(kept).rid AS rid FROM s WHERE turn > len(kept)""")
def kept_moves(t):
    """Lines of an order, read as moves, that no other of their list has struck out in its turn."""
    rows, k = _lines(t), F.col("l_partkey")
    function = F.get(F.array(*map(F.lit, [storage.NO_EFFECT, storage.STRONG_POISON, storage.WEAK_POISON, "Flinch"])), (F.col("l_suppkey") % 4).cast("int"))
    moves = rows.select("l_orderkey", "rid", (k % 2).alias("type"), (F.col("l_quantity").cast("long") % 4 * 20).alias("power"), (k % 5 * 20).alias("accuracy"), function.alias("function"), (10 + F.col("l_suppkey") % 3 * 5).alias("pp"))
    return storage.move_lists(moves, ["l_orderkey"], ["rid"]).select("l_orderkey", "rid")
