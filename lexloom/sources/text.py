"""Text sources as ordered rows: lines, sections and records of line-oriented files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text): whole text files under a folder, hidden and backup folders left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return named.where(~F.col("file").rlike(r"/(\.|[^/]*backup)[^/]*/"))


def lines(texts: DataFrame, key: str = "file", text: str = "text", limit: int | None = None) -> DataFrame:
    """(key, line_no from 0, line). A run of carriage returns with its line feed is one line break."""
    parts = F.split(F.regexp_replace(F.col(text), "\r+\n?", "\n"), "\n", -1)
    rows = texts.select(F.col(key), F.posexplode(parts).alias("line_no", "line"))
    return rows if limit is None else rows.where(F.col("line_no") < limit)


def newline_style(text: Column) -> Column:
    """CRLF if there are at least as many CRLF (or, without any, lone CR) as lone LF; so also for an empty text."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf = F.regexp_count(text, F.lit("\n")) - crlf
    cr = F.regexp_count(text, F.lit("\r")) - crlf
    first = F.when(crlf > 0, crlf).otherwise(cr)
    return F.when(first >= lf, "CRLF").otherwise("LF")


def strip(x: Column) -> Column:
    """Without white space at both ends, tabs and Unicode spaces included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


# The patterns of blocks, numbers and separators.
def is_block(line: Column) -> Column:
    return line.rlike(r"^\s*\[[^\]]*\]\s*$")


def is_number(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*\d+\s*$")


def is_separator(line: Column) -> Column:
    return line.rlike(r"^\s*#[-=]{3,}\s*$")


def is_map_block(line: Column) -> Column:
    return line.rlike(r"(?i)^\s*\[map\d+\]\s*$")


def line_class(line: Column) -> Column:
    """blank, block, number, separator, comment or text; the first that fits."""
    return (
        F.when(F.trim(line) == "", "blank")
        .when(is_block(line), "block")
        .when(is_number(line), "number")
        .when(is_separator(line), "separator")
        .when(line.rlike(r"^\s*#"), "comment")
        .otherwise("text")
    )


def fill_sections(rows: DataFrame, key: str, order: str = "line_no", line: str = "line", default: str | None = None) -> DataFrame:
    """Adds ``section``: the name in the last ``[NAME]`` line at or before each line of its file."""
    name = F.when(is_block(F.col(line)), F.regexp_extract(line, r"\[([^\]]*)\]", 1))
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(name, ignorenulls=True).over(so_far), F.lit(default)))


def block_modes(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``mode``: how texts break from here on, ``newline`` after a map block and at the top, ``space`` after any other block."""
    mode = F.when(is_map_block(F.col("line")), "newline").when(is_block(F.col("line")), "space")
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mode", F.coalesce(F.last(mode, ignorenulls=True).over(so_far), F.lit("newline")))


def with_header(rows: DataFrame, key: str, limit: int = 4) -> DataFrame:
    """Adds ``in_header``: whether a line is among the leading comments (``limit`` at most) and blanks of its file."""
    bare = strip(F.col("line"))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    comments = F.sum(bare.startswith("#").cast("int")).over(so_far)
    stop = (bare != "") & ~(bare.startswith("#") & (comments <= limit))
    return rows.withColumn("stop_", stop.cast("int")).withColumn("in_header", F.max("stop_").over(so_far) == 0).drop("stop_")


def header_end(rows: DataFrame, key: str, limit: int = 4) -> DataFrame:
    """(key, header_end): the first line past the leading comments, of which ``limit`` count, and blanks."""
    return with_header(rows, key, limit).groupBy(key).agg(F.count_if("in_header").alias("header_end"))


def key_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, section, name, value) of ``name = value`` lines within sections; the last of a name wins."""
    pattern = r"^\s*(\w+)\s*=\s*(.*?)\s*$"
    found = fill_sections(rows.where(~F.col("line").rlike(r"^\s*(#|$)")), key).where(F.col("line").rlike(pattern) & ~is_block(F.col("line")) & F.col("section").isNotNull())
    found = found.select(key, "section", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"), "line_no")
    return found.groupBy(key, "section", "name").agg(F.max_by("value", "line_no").alias("value"))


def section_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, section, lines): the text lines of each section, in order."""
    own = fill_sections(rows, key).where(~is_block(F.col("line")) & (F.trim("line") != "") & F.col("section").isNotNull())
    ordered = F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("line"))))
    return own.groupBy(key, "section").agg(F.transform(ordered, lambda x: x["line"]).alias("lines"))


def three_line_records(rows: DataFrame, key: str) -> DataFrame:
    """(key, id, src, dst) of records of three lines; blanks, comments and blocks between them are skipped.

    A record begins at a number line that no earlier record has consumed, so a
    number as source or translation is no new record. Number lines three or more lines
    apart don't touch each other; only runs of nearer ones are folded in order, each
    by the place of the record begun last. So a file is one array nowhere.
    """
    in_order = Window.partitionBy(key).orderBy("line_no")
    own = rows.where(~line_class(F.col("line")).isin("blank", "comment", "separator", "block")).withColumn("text_", F.trim("line"))
    after = [F.lead("text_", k).over(in_order).alias(name) for k, name in ((1, "src"), (2, "dst"))]
    numbers = own.select(key, F.row_number().over(in_order).alias("place_"), "text_", *after).where(is_number(F.col("text_")))
    by_place = Window.partitionBy(key).orderBy("place_")
    apart = F.coalesce(F.col("place_") - F.lag("place_").over(by_place) > 2, F.lit(True))
    numbers = numbers.withColumn("apart_", apart).withColumn("run_", F.count_if("apart_").over(by_place))
    runs = numbers.groupBy(key, "run_").agg(F.sort_array(F.collect_list(F.struct("place_", "text_", "src", "dst"))).alias("v"))
    begun = _begun(F.transform("v", lambda x: x["place_"]))
    found = runs.select(key, F.explode(F.filter(F.zip_with("v", begun, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), lambda y: y["b"])).alias("y"))
    return found.where("y.x.dst is not null").select(key, F.col("y.x.text_").cast("long").alias("id"), "y.x.src", "y.x.dst")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _begun(places: pd.Series) -> pd.Series:
    """Which of the number lines at ascending places begin a record: those that the record begun last has not taken."""

    def one(own) -> list[bool]:
        made, free = [], 0
        for i in own.tolist():
            made.append(i >= free)
            if i >= free:
                free = i + 3
        return made

    return places.map(one)
