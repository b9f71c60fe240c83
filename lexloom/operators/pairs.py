"""Source and translation pairs of adjacent lines, and what is written back to them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources import text as source
from . import qa


@F.pandas_udf(T.DoubleType())
def line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters in matching blocks of two lines, as a share of the longer; 0 where the lengths differ too much."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> float:
        if not x or not y or min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
            return 0.0
        blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        return sum(m.size for m in blocks) / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def alike(x: str | None, y: str | None, near: float) -> bool:
    """Whether ``line_similarity`` is ``near`` or more; most lines are told apart by their characters or their longest common subsequence."""
    if not x or not y or min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
        return 0.0 >= near
    most = max(len(x), len(y))
    return qa.matches_enough(x, y, lambda n: n / most >= near)


def lines_alike(a: Column, b: Column, near: float) -> Column:
    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y, near) for x, y in zip(a, b)], dtype=bool)

    return run(a, b)


def pair_lines(rows: DataFrame, key: str, near: float | None = None) -> DataFrame:
    """Every line, its ``bare`` text without white space at the ends, ``role`` and, of a special line, ``reason``.

    Blank, block, number and separator lines and the comments of the header are
    skipped. From the top of each file, a line takes the next one as its target where
    both are equal or, with ``near``, alike to that degree; a line without target is
    special. In each run of links the lines at even places take the next, so the greedy
    walk is a count within the run.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    rows = source.with_header(rows, key).withColumn("bare", source.strip(F.col("line")))
    kind = F.when(F.col("bare") == "", "blank").when(source.is_block(F.col("bare")), "block").when(source.is_separator(F.col("bare")), "separator").when(source.is_number(F.col("bare")), "number").otherwise("text")
    rows = rows.withColumn("kind", kind)
    rows = rows.withColumn("takes", (F.col("kind") == "text") & ~(F.col("in_header") & F.col("bare").startswith("#")))
    rows = rows.withColumns({"next_line": F.lead("bare").over(order), "next_kind": F.lead("kind").over(order)})
    same = F.col("bare") == F.col("next_line")
    if near is not None:
        like = F.when(F.col("takes") & ~same & (F.col("next_kind") == "text"), lines_alike(F.col("bare"), F.col("next_line"), near))
        same = same | F.coalesce(like, F.lit(0.0 >= near))
    rows = rows.withColumn("links", F.coalesce(F.col("takes") & same, F.lit(False)))
    ends = F.sum((~F.col("links")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(ends, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("line_no")) - 1
    role = F.when(place % 2 == 1, "target").when(F.col("links"), "source").when(F.col("takes"), "special").otherwise("skipped")
    why = F.when(F.col("next_kind").isNull(), "end").when(F.col("next_kind") == "text", "differs").otherwise(F.col("next_kind"))
    rows = rows.withColumn("role", role).withColumn("reason", F.when(F.col("role") == "special", why))
    return rows.drop("links", "run", "in_header", "kind", "takes", "next_kind")


def write_back(rows: DataFrame, key: str, cache: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Lines with the targets replaced: by line number (manual), else by source text (cache), else kept; indents stay."""
    paired = pair_lines(rows, key)
    out = paired.join(cache.select(F.col("src").alias("bare"), F.col("dst").alias("from_cache")), "bare", "left")
    if manual is not None:
        out = out.join(manual.select(key, "line_no", F.col("dst").alias("by_hand")), [key, "line_no"], "left")
    else:
        out = out.withColumn("by_hand", F.lit(None).cast("string"))
    chosen = F.coalesce("by_hand", "from_cache")
    indent = F.regexp_extract("line", r"^(\s*)", 1)
    text = F.when((F.col("role") == "target") & chosen.isNotNull(), F.concat(indent, F.trim(chosen))).otherwise(F.col("line"))
    return out.select(key, "line_no", text.alias("line"), "role")


def assemble(rows: DataFrame, key: str, newline: str = "\n") -> DataFrame:
    """(key, text): the lines of each file joined again."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), newline).alias("text"))
