"""Dictionaries, rules, word lists, snapshots and exchange files: JSON and line formats as tables.

Inputs are tables of (file, text); what can't be read is empty or set apart, never an
error of the whole load.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..operators.glossary import first_wins
from .text import lines, strip

_MAP = "map<string,string>"


_ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("string", T.BooleanType())])
_READ = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("entries", T.ArrayType(_ENTRY)),
        T.StructField("error", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
    ]
)


def _read(text: str | None) -> dict:
    if text is None:
        return {"error": "no text", "at": 0, "line": 1, "column": 1}
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        return {"error": e.msg, "at": e.pos, "line": e.lineno, "column": e.colno}
    except RecursionError:
        return {"error": "nested too deeply", "at": 0, "line": 1, "column": 1}
    if not isinstance(found, dict):
        return {"kind": type(found).__name__}
    # Lone halves of surrogate pairs have no UTF-8.
    plain = lambda x: x.encode("utf-8", "replace").decode()
    entry = lambda k, v: {"key": plain(k), "value": None if v is None else plain(v) if isinstance(v, str) else json.dumps(v), "string": isinstance(v, str)}
    return {"kind": "dict", "entries": [entry(k, v) for k, v in found.items()]}


@arrow_udf(_READ)
def read_json(text: pa.Array) -> pa.Array:
    """Each text as a JSON value, whole: kind (dict for an object), an object's entries, the last of each key, and where a broken text breaks."""
    entry = pa.struct([("key", pa.string()), ("value", pa.string()), ("string", pa.bool_())])
    kind = pa.struct([("kind", pa.string()), ("entries", pa.list_(entry)), ("error", pa.string()), ("at", pa.int64()), ("line", pa.int32()), ("column", pa.int32())])
    return pa.array([_read(x) for x in text.to_pylist()], kind)


def is_json(text: Column) -> Column:
    return read_json(text)["error"].isNull()


def as_map(text: Column) -> Column:
    """A JSON object as a map; empty for anything else. Values that are no strings are as they are written."""
    pairs = F.transform(F.coalesce(read_json(text)["entries"], F.array()), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast(_MAP))


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def utf8_texts(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, text, bom) of binary files: those that are UTF-8, without a byte order mark."""
    raw = F.col(content)
    good = files.where(F.is_valid_utf8(raw.cast("string")))
    text = raw.cast("string")
    return good.select("file", without_bom(text).alias("text"), text.startswith("﻿").alias("bom"))


def entries(files: DataFrame) -> DataFrame:
    """(file, src, dst) of dictionaries; a file that is no JSON object has none."""
    return files.select("file", F.explode(as_map(F.col("text"))).alias("src", "dst"))


def reference_entries(files: DataFrame) -> DataFrame:
    """(src, dst): all dictionaries as one; pairs with a blank side or a value that is no string are left out and the first file, by name, wins."""
    found = files.select("file", F.explode(read_json(F.col("text"))["entries"]).alias("e")).where("e.string")
    good = found.select("file", F.col("e.key").alias("src"), F.col("e.value").alias("dst")).where((strip(F.col("src")) != "") & (strip(F.coalesce("dst", F.lit(""))) != ""))
    return first_wins(good, ["src"], ["file"]).select("src", "dst")


def prefix_entries(files: DataFrame) -> DataFrame:
    """(src, dst) of prefix dictionaries: an object of entries under ``entries`` or a bare one; both sides trimmed."""
    inner = F.get_json_object("text", "$.entries")
    rows = files.select("file", F.explode(as_map(F.coalesce(inner, F.col("text")))).alias("src", "dst"))
    rows = rows.select("file", strip(F.col("src")).alias("src"), strip(F.coalesce("dst", F.lit(""))).alias("dst")).where("src <> ''")
    return first_wins(rows, ["src"], ["file"]).select("src", "dst")


def snapshot_terms(files: DataFrame) -> DataFrame:
    """(file, saved_at, src, dst) of snapshots; an old one lists sources only, whose translations are empty."""
    terms = F.get_json_object("text", "$.terms")
    listed = F.transform(F.from_json(terms, "array<string>"), lambda x: F.struct(x.alias("key"), F.lit("").alias("value")))
    pairs = F.when(terms.rlike(r"^\s*\["), listed).otherwise(F.map_entries(as_map(terms)))
    rows = files.where(is_json(F.col("text"))).select("file", F.get_json_object("text", "$.saved_at").alias("saved_at"), F.explode(pairs).alias("t"))
    return rows.select("file", "saved_at", F.col("t.key").alias("src"), F.col("t.value").alias("dst"))


def word_lists(files: DataFrame, field: str) -> DataFrame:
    """(file, word) of white lists; an empty file is an empty list."""
    found = F.from_json(F.get_json_object("text", f"$.{field}"), "array<string>")
    return files.where(is_json(F.col("text"))).select("file", F.explode(found).alias("word")).where(strip(F.col("word")) != "")


def rules(files: DataFrame) -> DataFrame:
    """(file, ord, src, dst, regex, info) of rule files: a list of objects or of plain sources, bare or under ``rules``; blank sources go."""
    inner = F.get_json_object("text", "$.rules")
    items = F.from_json(F.coalesce(inner, F.col("text")), "array<string>")
    rows = files.where(is_json(F.col("text"))).select("file", F.posexplode(items).alias("ord", "item"))
    whole = rows.withColumn("r", F.when(F.col("item").startswith("{"), F.from_json("item", "src string, dst string, regex boolean, info string")))
    out = whole.select("file", "ord", F.when(F.col("r").isNull(), F.col("item")).otherwise(F.col("r.src")).alias("src"), F.coalesce("r.dst", F.lit("")).alias("dst"), F.coalesce("r.regex", F.lit(False)).alias("regex"), F.coalesce("r.info", F.lit("")).alias("info"))
    return out.where(F.coalesce("src", F.lit("")) != "")


def active_rules(found: DataFrame) -> DataFrame:
    """Each source once, from the first file and place."""
    return first_wins(found, ["src"], ["file", "ord"])


def presets(found: DataFrame) -> DataFrame:
    """(file, rules): files with the number of their rules."""
    return found.groupBy("file").agg(F.count("*").alias("rules"))


def truthy(x: Column) -> Column:
    return F.lower(strip(x)).isin("1", "true", "yes", "y")


def exchange_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that can be read, and those that can't, with the place at which each breaks: chars before it, line and column from 1, and why."""
    read = files.withColumn("read_", read_json(F.col("text")))
    broken = read.where("read_.error is not null").select("file", F.col("read_.at").alias("chars"), "read_.line", "read_.column", "read_.error")
    return read.where("read_.error is null").drop("read_"), broken


#: The names of a source in a list of items, the first that isn't empty counting, and those of a translation, the first that is there.
SOURCE_NAMES, TRANSLATION_NAMES = ("src", "原文"), ("dst", "译文")


def exchange_items(files: DataFrame) -> DataFrame:
    """(file, src, dst) of exchange files: items as an object, or as a list of objects, of which the last of a source wins."""
    whole = files.select("file", F.explode(read_json(F.col("text"))["entries"]).alias("e")).where("e.key = 'items' and not e.string")
    items = F.col("e.value")
    listed = whole.where(items.rlike(r"^\s*\[")).select("file", F.posexplode(F.from_json(items, "array<string>")).alias("ord", "item"))
    listed = listed.select("file", "ord", as_map(F.col("item")).alias("m"))
    source = F.coalesce(*[F.nullif(F.col("m")[n], F.lit("")) for n in SOURCE_NAMES])
    # A translation that is there but null is empty: the second name counts only where the first is missing.
    first, second = TRANSLATION_NAMES
    own = F.when(F.map_contains_key("m", first), F.col("m")[first]).otherwise(F.col("m")[second])
    rows = listed.select("file", source.alias("src"), own.alias("dst"), "ord")
    mapped = whole.where(items.rlike(r"^\s*\{")).select("file", F.posexplode(read_json(items)["entries"]).alias("ord", "x"))
    rows = rows.unionByName(mapped.select("file", F.col("x.key").alias("src"), F.col("x.value").alias("dst"), "ord"))
    rows = rows.where(strip(F.coalesce("src", F.lit(""))) != "").withColumn("dst", F.coalesce("dst", F.lit("")))
    return rows.groupBy("file", "src").agg(F.max_by("dst", "ord").alias("dst"))


#: Fixed value: a line of a pair of JSON strings.
PAIR_LINE = r'^\s*("(?:[^"\\]|\\.)*")\s*:\s*("(?:[^"\\]|\\.)*"),?\s*(?:#.*)?$'


def pair_lines(files: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """(file, ord, src, dst) of lines ``"a": "b",``; with marks, only those between the first start and the first stop of the text.

    A stop before the start, or a mark that isn't there, leaves nothing.
    """
    if start is not None:
        begin, end = F.instr("text", start), F.instr("text", stop)
        block = F.substring("text", begin + F.char_length(F.lit(start)), end - begin - F.char_length(F.lit(start)))
        files = files.where((begin > 0) & (end >= begin)).select("file", block.alias("text"))
    rows = lines(files, "file")
    found = rows.where(F.col("line").rlike(PAIR_LINE))
    text = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_extract("line", PAIR_LINE, k), F.lit("}")), "$.v")
    return found.select("file", F.col("line_no").alias("ord"), text(1).alias("src"), text(2).alias("dst"))


def glossary_text(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): terms as lines of pairs, sorted by source."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', 1)
    line = F.concat(F.lit("    "), quoted("src"), F.lit(": "), quoted("dst"), F.lit(","))
    ordered = F.sort_array(F.collect_list(F.struct("src", line.alias("line"))))
    return terms.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def exchange_text(items: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """(keys, text): one JSON text for each file, of its items by source."""
    ordered = F.map_from_entries(F.sort_array(F.collect_list(F.struct("src", "dst"))))
    return items.groupBy(*keys).agg(F.to_json(F.struct(F.lit(kind).alias("type"), ordered.alias("items"))).alias("text"))


def header_score(cell: Column, aliases: list[str]) -> Column:
    """2 for one of the aliases, 1 for a cell that holds one of three letters or more, else 0."""
    own = F.lower(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", ""))
    part = F.lit(False)
    for a in aliases:
        if len(a) >= 3:
            part = part | F.contains(own, F.lit(a))
    return F.when(own.isin(aliases), 2).when(part, 1).otherwise(0)


def sheet_pairs(rows: DataFrame, sheet: str, source: list[str], target: list[str], most: int = 15) -> DataFrame:
    """(sheet, row_no, src, dst) from (sheet, row_no, cells): below the first of the top rows that has a column of both languages, the best column of each."""
    best = lambda names: F.array_max(F.transform("cells", lambda c, i: F.struct(header_score(c, names).alias("score"), (-i).alias("at"))))
    scored = rows.where(F.col("row_no") < most).select(sheet, "row_no", best(source).alias("s"), best(target).alias("t")).where("s.score > 0 and t.score > 0")
    head = scored.groupBy(sheet).agg(F.min_by(F.struct((-F.col("s.at")).alias("s"), (-F.col("t.at")).alias("t")), "row_no").alias("x"), F.min("row_no").alias("head"))
    body = rows.join(head, sheet).where("row_no > head")
    cell = lambda c: strip(F.coalesce(F.get("cells", F.col(c)), F.lit("")))
    return body.select(sheet, "row_no", cell("x.s").alias("src"), cell("x.t").alias("dst"))


def sheet_counters(pairs: DataFrame, sheet: str, least: int = 3) -> DataFrame:
    """(sheet, kept, empty, same, short) of a sheet's pairs."""
    empty = (F.col("src") == "") | (F.col("dst") == "")
    same, short = F.col("src") == F.col("dst"), F.length("src") < least
    return pairs.groupBy(sheet).agg(F.count_if(~empty & ~same & ~short).alias("kept"), F.count_if(empty).alias("empty"), F.count_if(~empty & same).alias("same"), F.count_if(~empty & ~same & short).alias("short"))
