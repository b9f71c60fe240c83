"""Fingerprints of functions of a code base, compared between versions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def fingerprint(text: Column) -> Column:
    """First twelve hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(script, fn, status) of tables (script, fn, fp): same, changed, moved, missing or added.

    A function that its script lacks is looked up by name in the others: there it is
    moved with the same fingerprint, else changed.
    """
    a, b = (df.select("script", "fn", F.col("fp").alias(n)) for df, n in ((old, "old_fp"), (new, "new_fp")))
    both = a.join(b, ["script", "fn"], "full_outer")
    elsewhere = new.groupBy("fn").agg(F.min_by("fp", "script").alias("other_fp"))
    both = both.join(elsewhere, "fn", "left")
    there = F.col("old_fp") == F.col("other_fp")
    status = (
        F.when(F.col("old_fp").isNull(), "added")
        .when(F.col("new_fp").isNull(), F.when(F.col("other_fp").isNull(), "missing").when(there, "moved").otherwise("changed"))
        .when(F.col("old_fp") == F.col("new_fp"), "same")
        .otherwise("changed")
    )
    return both.select("script", "fn", status.alias("status"))


def compare_totals(compared: DataFrame) -> DataFrame:
    """(status, n, scripts) of a comparison."""
    return compared.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("script").alias("scripts"))


def overlap(versions: DataFrame, state: DataFrame) -> DataFrame:
    """(version, overlap): share of all functions of a version that the state has with the same fingerprint."""
    both = versions.join(state.select("script", "fn", F.col("fp").alias("now")), ["script", "fn"], "left")
    return both.groupBy("version").agg(F.avg(F.coalesce(F.col("fp") == F.col("now"), F.lit(False)).cast("double")).alias("overlap"))


def closest(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """The version of the largest overlap of at least ``least``, the first of equals."""
    return overlaps.where(F.col("overlap") >= least).orderBy(F.desc("overlap"), "version").limit(1)


# Lines that begin a function, a module or class, or a block, and those that end one.
_DEF = re.compile(r"[ \t]*def\s+((?:self\s*\.\s*)?(?:[A-Za-z_][A-Za-z0-9_]*[?!]?|\[\]=?|<<|>>|[+\-*/%]=?|<=>|<=|>=|===?|!=|!|~|&|\||\^))")
_DEF_IN_ONE_LINE = re.compile(r"[ \t]*def\b.*\bend\b\s*$")
_SCOPE = re.compile(r"(?:module|class)\s+([A-Za-z_][\w:]*)")
_OPENS = re.compile(r"(?:module|class|def|if|unless|while|until|for|case|begin)\b")
_DO = re.compile(r"\bdo\b\s*(?:\|[^|]*\|)?\s*$")
_END = re.compile(r"end\b")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _body_end(rows: list[str], begin: int) -> int:
    """The row of the ``end`` that closes the function begun at a row: no block open, and no deeper than the function; else the end of the text."""
    base, depth = _indent(rows[begin]), 0
    for i in range(begin + 1, len(rows)):
        row = rows[i].strip()
        do = _DO.search(row)
        if do or _OPENS.match(row):
            depth += bool(do) or _indent(rows[i]) >= base
        elif _END.match(row):
            if depth == 0 and _indent(rows[i]) <= base:
                return i
            depth -= 1
    return len(rows)


def _functions(text: str | None) -> list[dict]:
    """(name, body) of a text's functions, in order; a name is led by those of the blocks around it, ``_`` for blocks without one."""
    rows, around, out = (text or "").split("\n"), [], []
    for i, row in enumerate(rows):
        bare, indent = row.strip(), _indent(row)
        if not bare or _DEF_IN_ONE_LINE.match(row):
            continue
        if _END.match(bare):
            while around and around[-1][0] >= indent:
                around.pop()
        elif found := _DEF.match(row):
            name = re.sub(r"\s+", "", found[1])
            out.append({"name": ".".join([*(x for _, x in around), name]), "body": "\n".join(rows[i + 1 : _body_end(rows, i)])})
            around.append((indent, name))
        elif found := _SCOPE.match(bare):
            around.append((indent, found[1]))
        elif _OPENS.match(bare) or _DO.search(bare):
            around.append((indent, "_"))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("name", "string").add("body", "string")))
def functions_of(text: pd.Series) -> pd.Series:
    """The functions of each source text, as ``scan_functions`` tells."""
    return text.map(_functions)


def without_comment(line: Column) -> Column:
    """A line up to its first ``#``, if that begins the line or comes after a blank and no quote is before it."""
    return F.regexp_replace(line, r"""(?s)^(?:([^#"'`]*?)[ \t]+)?#.*$""", "$1")


def normal_body(body: Column) -> Column:
    """Lines without comments and indents; those with nothing left go."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    each = F.transform(F.split(body, "\n"), lambda x: trim(without_comment(F.regexp_replace(x, r"\r+$", ""))))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def scan_functions(files: DataFrame) -> DataFrame:
    """(script, fn, fp) of (script, text): each function by its qualified name (``A.x``, ``A.self.x``), with the fingerprint of its body.

    A function ends at the ``end`` that matches by blocks and indents. The ``def`` line,
    comments, indents and blank lines do not count; the last of a name wins. Functions
    in one line are none. Null and empty texts have no functions.
    """
    each = files.select("script", F.posexplode(functions_of("text")).alias("ord", "f"))
    rows = each.select("script", F.col("f.name").alias("fn"), "ord", fingerprint(normal_body(F.col("f.body"))).alias("fp"))
    return rows.groupBy("script", "fn").agg(F.max_by("fp", "ord").alias("fp"))


def without_marked_lines(text: Column, mark: str, line: str) -> Column:
    """A text whose lines that hold ``mark``, or are ``line``, are made empty: a tool's own insertions, before scripts are compared."""
    quoted = lambda x: "".join(f"\\{c}" if not c.isalnum() else c for c in x)
    return F.regexp_replace(text, rf"(?md)^[ \t]*(?:{quoted(line)}|[^\n]*{quoted(mark)}[^\n]*)[ \t]*\r?$", "")


@F.pandas_udf(T.StringType())
def function_source(text: pd.Series, fn: pd.Series) -> pd.Series:
    """The lines of a function, found by the last part of its name, from ``def`` to a bare ``end`` that is no deeper, else to the end; empty if it isn't there."""

    def one(source: str | None, name: str | None) -> str:
        name = (name or "").split(".")[-1].strip()
        rows, begins = (source or "").split("\n"), re.compile(rf"([ \t]*)def\s+{re.escape(name)}\b")
        begin = next((i for i, row in enumerate(rows) if begins.match(row)), None) if name else None
        if begin is None:
            return ""
        base = len(begins.match(rows[begin])[1])
        closes = (i for i in range(begin + 1, len(rows)) if re.fullmatch(r"[ \t]*end[ \t]*\r?", rows[i]) and len(rows[i]) - len(rows[i].lstrip(" \t")) <= base)
        return "\n".join(rows[begin : next(closes, len(rows) - 1) + 1])

    return pd.Series([one(a, b) for a, b in zip(text, fn, strict=True)], dtype=object)


def replaced_function(text: Column, fn: Column, source: Column) -> Column:
    """The text with a function's lines replaced, null if it has no such function."""
    old = function_source(text, fn)
    at = F.instr(text, old)
    return F.when(old != "", F.concat(F.substring(text, F.lit(1), at - 1), source, F.substring(text, at + F.length(old), F.length(text))))
