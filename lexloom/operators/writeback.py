"""Keyed write-back: dictionaries by class into field lines, edits and fixes with their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.text import strip

# Classes of files by the beginning of their names, prefixes left out, and the fields that are written.
CLASSES = {
    "ability": (("abilities",), (), ("Name", "Description")),
    "items": (("items",), (), ("Name", "NamePlural", "Description")),
    "moves": (("moves",), (), ("Name", "Description")),
    "pokemon": (("pokemon",), ("pokemon_metrics",), ("Name", "Pokedex", "FormName")),
    "types": (("types",), (), ("Name",)),
}
FIELD = r"^(\s*)(\w+)(\s*=\s*)(.*)$"


def file_class(file: Column) -> Column:
    """The first class by the beginning of a file's name, null for others."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(file, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    out = F.when(F.lit(False), "")
    for name, (begins, skips, _) in CLASSES.items():
        fits, left_out = F.lit(False), F.lit(False)
        for x in begins:
            fits = fits | stem.startswith(x)
        for x in skips:
            left_out = left_out | stem.startswith(x)
        out = out.when(fits & ~left_out, name)
    return out


def bare_stem(name: Column) -> Column:
    """A file's name without what says that it is translated or a report."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?i)(_(TRANSLATED|REPORT))+$", "")


def unquoted(value: Column) -> Column:
    """The text of a value in quotes, its escaped quotes plain; other values as they are."""
    inner = F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('\\"'), F.lit('"'))
    return F.when((F.length(value) >= 2) & value.startswith('"') & value.endswith('"'), inner).otherwise(value)


def requoted(text: Column, quoted: Column) -> Column:
    return F.when(quoted, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def write_fields(rows: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """(key, line_no, line, changed): values of a class's fields replaced by its dictionary (class, src, dst), raw or trimmed; all else stays byte for byte.

    The rows that changed alone are the dry run.
    """
    value = F.rtrim(F.regexp_extract("line", FIELD, 4))
    known = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.array(*map(F.lit, f[2]))) for c, f in CLASSES.items()]))
    rows = rows.withColumns({"class": file_class(F.col(key)), "field_": F.regexp_extract("line", FIELD, 2), "value_": value})
    rows = rows.withColumns({"quoted_": (F.length("value_") >= 2) & F.col("value_").startswith('"') & F.col("value_").endswith('"'), "src_": unquoted(F.col("value_"))})
    rows = rows.withColumn("src_", F.when(F.array_contains(known[F.col("class")], F.col("field_")) & (F.col("src_") != ""), F.col("src_")))
    raw = entries.select("class", F.col("src").alias("src_"), F.col("dst").alias("raw_"))
    bare = entries.select("class", F.col("src").alias("bare_"), F.col("dst").alias("trimmed_"))
    found = rows.withColumn("bare_", strip(F.col("src_"))).join(raw, ["class", "src_"], "left").join(bare, ["class", "bare_"], "left")
    dst = F.coalesce("raw_", "trimmed_")
    changed = F.coalesce(dst.isNotNull() & (dst != F.col("src_")) & (strip(dst) != ""), F.lit(False))
    head = F.concat(*[F.regexp_extract("line", FIELD, k) for k in (1, 2, 3)])
    tail = F.substring("line", F.length(head) + F.length("value_") + 1, F.length("line"))
    return found.select(key, "line_no", F.when(changed, F.concat(head, requoted(dst, F.col("quoted_")), tail)).otherwise(F.col("line")).alias("line"), changed.alias("changed"))


def applied(base: DataFrame, fixes: DataFrame) -> DataFrame:
    """(src, dst, action) of a dictionary after fixes: updated, added, same, skipped (a blank fix, or one that is its source) or kept."""
    old = base.select("src", F.col("dst").alias("old_"))
    new = fixes.select(strip(F.col("src")).alias("src"), strip(F.coalesce("dst", F.lit(""))).alias("new_")).where("src <> ''")
    both = old.join(new, "src", "full_outer")
    blank = (F.col("new_") == "") | (F.col("new_") == F.col("src"))
    action = F.when(F.col("new_").isNull(), "kept").when(blank, "skipped").when(F.col("old_").isNull(), "added").when(F.col("old_") == F.col("new_"), "same").otherwise("updated")
    rows = both.withColumn("action", action)
    return rows.select("src", F.when(F.col("action").isin("updated", "added"), F.col("new_")).otherwise(F.col("old_")).alias("dst"), "action")


def action_totals(rows: DataFrame) -> DataFrame:
    """One row: how many of each action."""
    return rows.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("updated", "added", "same", "skipped", "kept")])


def carried_over(fresh: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Fresh items (key, src, dst) with the old translations where they have none of their own."""
    before = old.where(strip(F.coalesce("dst", F.lit(""))) != "").select(key, "src", F.col("dst").alias("old_"))
    own = F.when(strip(F.coalesce("dst", F.lit(""))) != "", F.col("dst"))
    return fresh.join(before, [key, "src"], "left").select(key, "src", F.coalesce(own, "old_", F.lit("")).alias("dst"))


def by_position(translated: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, line_no, src, dst): lines of two files by their numbers, not by their texts."""
    return translated.select(key, "line_no", F.col("line").alias("dst")).join(source.select(key, "line_no", F.col("line").alias("src")), [key, "line_no"])


def grouped_hits(hits: DataFrame, group: str, order: str) -> DataFrame:
    """(group, items): a map of each group's sources to the translation of the first hit."""
    first = hits.groupBy(group, "src").agg(F.min_by("dst", order).alias("dst"))
    return first.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "dst")))).alias("items"))


def extraction_totals(routed: DataFrame) -> DataFrame:
    """(files, sentences, cached, reference, automatic, todo) of routed sentences (file, route)."""
    of = lambda *names: F.count_if(F.col("route").isin(*names))
    return routed.agg(F.countDistinct("file").alias("files"), F.count("*").alias("sentences"), of("cached").alias("cached"), of("reference").alias("reference"), of("placeholder", "term", "letter", "control", "path", "no_text").alias("automatic"), of("todo").alias("todo"))
