"""Boxes that fill up, and lists in which one entry strikes out others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .running import with_running


def free_slots(boxes: DataFrame, taken: DataFrame, owner: str) -> DataFrame:
    """(owner, box, slot, place): the free slots of (owner, box, size, current), numbered in the order in which they fill: those of the current box, then all by box and slot.

    Slots count from 0; ``taken`` is (owner, box, slot), rows for slots that no box has
    being of no effect. A box without a size has none.
    """
    slots = boxes.where("size > 0").select(owner, "box", F.coalesce("current", F.lit(False)).alias("current_"), F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("slot"))
    free = slots.join(taken.select(owner, "box", "slot").distinct(), [owner, "box", "slot"], "left_anti")
    placed = with_running(free.withColumn("later_", ~F.col("current_")), [owner], ["later_", "box", "slot"], F.lit(1), "place")
    return placed.select(owner, "box", "slot", "place")


def stored(arrivals: DataFrame, boxes: DataFrame, taken: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """The arrivals with box and slot: each takes the first free slot of the current box, or, if that is full, of the first box with space, which is the current one from then on.

    A box that spills is full, and so are all before the one it spills to; so the k-th
    arrival of an owner takes the k-th free slot, and both are numbered by running
    sums. Null where all is full, and for arrivals without an owner.
    """
    slots = free_slots(boxes, taken, owner).withColumnRenamed("place", "place_")
    numbered = with_running(arrivals, [owner], order, F.lit(1), "place_")
    return numbered.join(slots, [owner, "place_"], "left").select(*arrivals.columns, "box", "slot")


def current_boxes(put: DataFrame, boxes: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """(owner, box): the current box after all arrivals that were ``stored``: that of the last one that found a slot, else the one before."""
    last = put.where("box is not null").groupBy(owner).agg(F.max_by("box", F.struct(*order)).alias("last_"))
    before = boxes.groupBy(owner).agg(F.min(F.when(F.col("current"), F.col("box"))).alias("old_"))
    return before.join(last, owner, "left").select(owner, F.coalesce("last_", "old_").alias("box"))


def kept_in_order(items: Column, strikes: Callable[[Column, Column], Column]) -> Column:
    """What is left of an array after each entry, in turn, has struck out all that ``strikes(entry, other)`` holds for, which can be itself.

    Turns go by place in what is left: an entry that is struck out before its turn
    strikes out nothing, and when one at or before the place of the turn goes, the entry
    that moves up to that place has no turn. Null and empty arrays stay as they are.
    """
    start = F.struct(items.alias("kept"), F.lit(0).alias("at"))

    def turn(s: Column, _: Column) -> Column:
        left = F.filter(s["kept"], lambda x: ~F.coalesce(strikes(F.get(s["kept"], s["at"]), x), F.lit(False)))
        return F.when(s["at"] < F.size(s["kept"]), F.struct(left.alias("kept"), (s["at"] + 1).alias("at"))).otherwise(s)

    return F.aggregate(items, start, turn, lambda s: s["kept"])


# Codes of effects, and the numbers of uses that make a move replace others of its kind.
NO_EFFECT, WEAK_POISON, STRONG_POISON, COMMON_USES = "None", "PoisonTarget", "BadPoisonTarget", (10, 15)


def dominates(a: Column, b: Column) -> Column:
    """Whether move a makes move b superfluous, both structs of type, power, accuracy, function and pp.

    Accuracy 0 is that of moves that never miss, power 0 that of moves without damage.
    Comparisons with null are false.
    """
    alike = a["function"] == b["function"]
    unmissing = (a["accuracy"] == 0) & (b["function"] == NO_EFFECT) & (a["type"] == b["type"]) & (a["power"] >= b["power"])
    status = alike & (a["power"] == 0) & (b["power"] == 0) & (a["accuracy"] > b["accuracy"])
    poison = (a["function"] == STRONG_POISON) & (b["function"] == WEAK_POISON)
    stronger = (a["power"] > b["power"]) | ((a["power"] == b["power"]) & (a["accuracy"] > b["accuracy"]))
    damage = alike & (a["power"] != 0) & (a["type"] == b["type"]) & (a["pp"].isin(*COMMON_USES) | (a["pp"] == b["pp"])) & stronger
    return F.coalesce(unmissing, F.lit(False)) | F.coalesce(status, F.lit(False)) | F.coalesce(poison, F.lit(False)) | F.coalesce(damage, F.lit(False))


def move_lists(moves: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The moves that their group's list keeps, by ``dominates`` in order.

    A list is one array: a group is what one creature can learn.
    """
    whole = F.struct(*order, F.struct(*moves.columns).alias("row_"))
    listed = moves.groupBy(*group).agg(F.sort_array(F.collect_list(whole)).alias("list_"))
    kept = kept_in_order(F.transform("list_", lambda x: x["row_"]), dominates)
    return listed.select(F.explode(kept).alias("row_")).select("row_.*")
