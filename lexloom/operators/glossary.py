"""Glossaries: validity, merging, differences, mutations and their reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.text import strip


def term_key(x: Column) -> Column:
    return F.lower(strip(x))


@F.pandas_udf(T.StringType())
def bare_value(x: pd.Series) -> pd.Series:
    """Value for comparison: full-width and other compatibility forms folded (NFKC), white space gone."""
    import unicodedata

    return x.map(lambda v: None if v is None else "".join(unicodedata.normalize("NFKC", v).split()))


# Placeholders as terms, and the Han block that a translation must have a character of.
TERM_PLACEHOLDER, HAN = r"^[@⟦]\d+[@⟧]$", "[\u4e00-\u9fff]"


def term_problem(src: Column, dst: Column) -> Column:
    """First reason against a term: empty, control, placeholder, short (two ASCII letters at most) or same; null for a good one."""
    src, dst = strip(F.coalesce(src, F.lit(""))), strip(F.coalesce(dst, F.lit("")))
    return (
        F.when(src == "", "empty")
        .when(src.rlike(r"[\\\[\]]"), "control")
        .when(src.rlike(TERM_PLACEHOLDER), "placeholder")
        .when(src.rlike(r"^[A-Za-z]{1,2}$"), "short")
        .when((dst != "") & (src == dst), "same")
    )


def new_term_problem(src: Column, dst: Column, least: int = 3) -> Column:
    """First reason against a new term: empty, short, same, control, placeholder or no_han; null for a good one."""
    src, dst = strip(F.coalesce(src, F.lit(""))), strip(F.coalesce(dst, F.lit("")))
    return (
        F.when((src == "") | (dst == ""), "empty")
        .when(F.length(src) < least, "short")
        .when(src == dst, "same")
        .when(src.rlike(r"[\\\[\]]"), "control")
        .when(src.rlike(TERM_PLACEHOLDER), "placeholder")
        .when(~dst.rlike(HAN), "no_han")
    )


def admitted(terms: DataFrame, least: int = 3) -> DataFrame:
    """Terms that may enter a glossary, without white space at the ends."""
    good = terms.where(new_term_problem(F.col("src"), F.col("dst"), least).isNull())
    return good.withColumns({"src": strip(F.col("src")), "dst": strip(F.col("dst"))})


def accepted(fixes: DataFrame) -> DataFrame:
    """(src, dst, accepted): fixes that say something: not blank and not the source."""
    src, dst = strip(F.col("src")), strip(F.coalesce("dst", F.lit("")))
    return fixes.where(src != "").select(src.alias("src"), dst.alias("dst"), ((dst != "") & (dst != src)).alias("accepted"))


def classed_entries(entries: DataFrame, priority: str) -> DataFrame:
    """(class, src, dst) of entries with ``class``, ``file`` and a priority: for a source of a class the first priority, then file, wins."""
    usable = entries.where((strip(F.coalesce("dst", F.lit(""))) != "") & (F.col("dst") != F.col("src")))
    return first_wins(usable, ["class", "src"], [priority, "file"]).select("class", "src", "dst")


def prefix_stats(entries: DataFrame) -> DataFrame:
    """(total, done, pending) of prefixes."""
    done = strip(F.coalesce("dst", F.lit(""))) != ""
    return entries.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("pending"))


def searched(terms: DataFrame, needle: str, origin: str | None = None, most: int = 600) -> DataFrame:
    """Terms with the needle in source or translation, whatever the case, of one origin; ``matched`` is how many there are in all."""
    hit = F.contains(F.lower("src"), F.lit(needle.lower())) | F.contains(F.lower("dst"), F.lit(needle.lower()))
    found = terms.where(hit) if origin is None else terms.where(hit & (F.col("origin") == origin))
    return found.orderBy("ord").limit(most).join(F.broadcast(found.agg(F.count("*").alias("matched"))))


def with_new_terms(current: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, origin, ord): the glossary with the admitted new terms that it lacks (by key), after all others."""
    key = term_key(F.col("src"))
    fresh = first_wins(admitted(new).withColumn("k_", key), ["k_"], ["ord"]).join(current.select(key.alias("k_")), "k_", "left_anti")
    last = current.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last_"))
    fresh = fresh.join(F.broadcast(last)).select("src", "dst", F.lit("auto").alias("origin"), (F.col("ord") + F.col("last_")).alias("ord"))
    return current.select("src", "dst", "origin", "ord").union(fresh)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Partial aggregates, so a hot key does not gather in one task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*keys, "x.*")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*keys, "x.*")


def merge_terms(current: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, status): new terms are added, old ones kept; a differing new value is a conflict and the old one stays.

    Of new terms with one key the least counts, and each that differs from the old one makes a conflict.
    """
    old = current.select(F.col("src").alias("old_src"), F.col("dst").alias("old_dst"), term_key(F.col("src")).alias("k"), bare_value(F.col("dst")).alias("old_value"))
    add = new.select("src", "dst", term_key(F.col("src")).alias("k"), bare_value(F.col("dst")).alias("value"))
    add = add.groupBy("k").agg(F.min(F.struct("src", "dst")).alias("x"), F.collect_set("value").alias("values"))
    both = old.join(add.select("k", "x.*", "values"), "k", "full_outer")
    status = (
        F.when(F.col("old_src").isNull(), "added")
        .when(F.col("src").isNull(), "kept")
        .when(F.exists("values", lambda v: v != F.col("old_value")), "conflict")
        .otherwise("same")
    )
    return both.select(F.coalesce("old_src", "src").alias("src"), F.coalesce("old_dst", "dst").alias("dst"), status.alias("status"))


def diff_terms(before: DataFrame, after: DataFrame) -> DataFrame:
    """(k, old, new, change): added, removed or modified keys between two snapshots."""
    a = before.select(term_key(F.col("src")).alias("k"), F.col("dst").alias("old"))
    b = after.select(term_key(F.col("src")).alias("k"), F.col("dst").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "k", "full_outer").select("k", "old", "new", change.alias("change")).where("change is not null")


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Base with the changes merged in: (key, value, action) where action is kept, updated, same or inserted."""
    b, c = base.select(key, F.col(value).alias("old")), changes.select(key, F.col(value).alias("new"))
    action = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "inserted").when(F.col("old") != F.col("new"), "updated").otherwise("same")
    return b.join(c, key, "full_outer").select(key, F.coalesce("new", "old").alias(value), action.alias("action"))


def staged_edit(base: DataFrame, deletes: DataFrame, renames: DataFrame, changes: DataFrame, adds: DataFrame) -> DataFrame:
    """Edits in their fixed order: delete, rename (not onto a key that stays), change, add (not over a key)."""
    rows = base.join(deletes, "src", "left_anti")
    taken = rows.select(F.col("src").alias("to"))
    moves = renames.join(taken, "to", "left_anti").select(F.col("src"), "to")
    rows = rows.join(moves, "src", "left").select(F.coalesce("to", "src").alias("src"), "dst", F.when(F.col("to").isNotNull(), "renamed").otherwise("kept").alias("origin"))
    changed = changes.select("src", F.col("dst").alias("new"))
    rows = rows.join(changed, "src", "left").select("src", F.coalesce("new", "dst").alias("dst"), F.when(F.col("new").isNotNull() & (F.col("new") != F.col("dst")), "changed").otherwise(F.col("origin")).alias("origin"))
    fresh = adds.join(rows, "src", "left_anti").select("src", "dst", F.lit("added").alias("origin"))
    return rows.unionByName(fresh)


def inconsistent_terms(rows: DataFrame, section: str, order: str) -> DataFrame:
    """Rows whose translation differs from the first one of their section and key; an aggregate and a join, so no key is gathered in one task."""
    keyed = rows.withColumn("k_", term_key(F.col("src")))
    first = keyed.groupBy(section, "k_").agg(F.min_by("dst", order).alias("first_dst"))
    return keyed.join(first, [section, "k_"]).where("dst <> first_dst").drop("k_")


def term_plan(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(section, total, in_terms, missing) and, under a null section, the sum of all."""
    marked = rows.join(terms.select(term_key(F.col("src")).alias("k")).distinct().withColumn("there", F.lit(True)), term_key(F.col("src")) == F.col("k"), "left")
    hit = F.coalesce("there", F.lit(False))
    return marked.rollup("section").agg(F.count("*").alias("total"), F.count_if(hit).alias("in_terms"), F.count_if(~hit).alias("missing"))
