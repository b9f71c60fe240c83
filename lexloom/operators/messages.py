"""Message tables: lookups through layers, section texts, literals of scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def looked_up(rows: DataFrame, layers: list[DataFrame], section: str = "section", key: str = "text") -> DataFrame:
    """Adds ``found``: the message of the first layer (section, key, message) that has it for the row's section, else for section 0, else the text itself."""
    out, found = rows, []
    for i, layer in enumerate(layers):
        for j, own in enumerate((F.col(section), F.lit(0))):
            side = layer.select(F.col("section").alias("s_"), F.col("key").alias("k_"), F.col("message").alias(f"m{i}{j}_"))
            out = out.withColumn("own_", own).join(side, (F.col("own_") == F.col("s_")) & (F.col(key) == F.col("k_")), "left").drop("own_", "s_", "k_")
            found.append(f"m{i}{j}_")
    return out.withColumn("found", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in found], F.col(key))).drop(*found)


def section_text(rows: DataFrame, section: str, numbered: bool) -> DataFrame:
    """(section, text): a block line, then for each message its number (where numbered), source and translation, by ``ord``."""
    parts = [F.col("ord").cast("string")] if numbered else []
    lines = F.concat_ws("\r\n", *parts, F.col("src"), F.coalesce("dst", F.col("src")))
    ordered = F.sort_array(F.collect_list(F.struct("ord", lines.alias("lines"))))
    head = F.concat(F.lit("["), F.col(section).cast("string"), F.lit("]\r\n"))
    return rows.groupBy(section).agg(F.array_join(F.transform(ordered, lambda x: x["lines"]), "\r\n").alias("body")).select(section, F.concat(head, "body").alias("text"))


def compiled(rows: DataFrame, file: str, section: str) -> DataFrame:
    """(section, key, message, complete) from lines (file, section, place, line): pairs of lines, later files winning; an odd line out is not complete."""
    pair = rows.groupBy(file, section, F.floor(F.col("place") / 2).alias("pair")).agg(F.min_by("line", "place").alias("key"), F.max_by("line", "place").alias("message"), (F.count("*") == 2).alias("complete"))
    best = F.max_by(F.struct("message", "complete"), F.struct(file, "pair"))
    return pair.groupBy(section, "key").agg(best.alias("x")).select(section, "key", "x.*")


def new_messages(rows: DataFrame, core: DataFrame) -> DataFrame:
    """Messages (section, key, message) that differ from their key and that the core has not."""
    own = rows.where(F.col("message") != F.col("key"))
    return own.join(core.select("section", "key", "message"), ["section", "key", "message"], "left_anti")


#: Fixed value: a literal of a script that is looked up.
LITERAL = r'_INTL\(\s*"((?:[^"\\]|\\.)*)"'


def script_literals(scripts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, src, first): distinct literals of each script and the place of the first of each."""
    found = scripts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(1))).alias("place", "src"))
    return found.groupBy(key, "src").agg(F.min("place").alias("first"))


def translated_literals(text: Column, known: Column) -> Column:
    """A script with its literals replaced by a map's values."""
    pieces = F.regexp_extract_all(text, F.lit(LITERAL + r"|[^_]+|_"), F.lit(0))
    inner = lambda p: F.regexp_extract(p, LITERAL, 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("_INTL("), F.concat(F.regexp_extract(p, r'^(_INTL\(\s*")', 1), F.coalesce(known[inner(p)], inner(p)), F.lit('"'))).otherwise(p)), "")


def ordered_union(*lists: Column) -> Column:
    """Distinct entries of several arrays, in the order in which they come."""
    return F.array_distinct(F.concat(*lists))
