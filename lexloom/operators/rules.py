"""Replacement rules, restoration and escapes, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import codes

Rule = tuple[str, str, bool]  # source, replacement, whether the source is a regular expression


def valid_rules(rules: list[Rule]) -> list[Rule]:
    """Rules without an empty source or a pattern that doesn't compile."""

    def fits(rule: Rule) -> bool:
        if not rule[2]:
            return rule[0] != ""
        try:
            re.compile(rule[0])
        except re.error:
            return False
        return rule[0] != ""

    return [r for r in rules if fits(r)]


def apply_rule(x: Column, rule: Rule) -> Column:
    src, dst, regex = rule
    if not regex:
        return F.replace(x, F.lit(src), F.lit(dst))
    # Group references are written \1 in rules and $1 in Java; a dollar sign is itself.
    java = re.sub(r"\\(\d)", r"$\1", dst.replace("$", r"\$"))
    return F.regexp_replace(x, src, java)


def apply_rules(x: Column, rules: list[Rule]) -> Column:
    for rule in valid_rules(rules):
        x = apply_rule(x, rule)
    return x


def rule_hits(x: Column, rules: list[Rule]) -> Column:
    """How many rules of the chain change the text that they get."""
    hits = F.lit(0)
    for rule in valid_rules(rules):
        after = apply_rule(x, rule)
        hits, x = hits + (after != x).cast("int"), after
    return hits


def one_line(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n|\r|\n+", " ")


def one_ellipsis(x: Column) -> Column:
    return F.regexp_replace(x, r"\.{3,}", "…")


#: Escapes of characters, in the order of their replacement.
_ESCAPES = (("\r", "<<r>>"), ("\n", "<<n>>"), ("\t", "<<t>>"), ("[", "<<[>>"), ("]", "<<]>>"), ("\x01", "<<1>>"))


def escape_value(x: Column) -> Column:
    for plain, escaped in _ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(escaped))
    return x


def unescape_value(x: Column) -> Column:
    for plain, escaped in _ESCAPES:
        x = F.replace(x, F.lit(escaped), F.lit(plain))
    return x


def squeeze_key(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"\s{2,}", " ")


def positional(template: Column, *values: Column) -> Column:
    """{1}, {2}, … of a template replaced by the values, and {1:d} by a whole number; values are not searched again."""
    found = F.array(*[v.cast("string") for v in values])
    parts = F.regexp_extract_all(template, F.lit(r"\{\d+(?::d)?\}|[^{]+|\{"), F.lit(0))

    def one(p: Column) -> Column:
        value = F.get(found, F.regexp_extract(p, r"^\{(\d+)", 1).try_cast("int") - 1)
        value = F.when(p.endswith(":d}"), value.try_cast("double").cast("long").cast("string")).otherwise(value)
        return F.when(p.rlike(r"^\{\d+(:d)?\}$"), F.coalesce(value, p)).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def fix_han_spacing(x: Column) -> Column:
    """White space between two Han characters goes."""
    return F.regexp_replace(x, r"(?<=\p{IsHan})\s+(?=\p{IsHan})", "")


def quote_field(x: Column) -> Column:
    """A field of a CSV line, quoted where it must be."""
    return F.when(x.rlike(r'[,"\n]|^\s|\s$'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


@F.pandas_udf(T.StringType())
def restore_backslashes(text: pd.Series, like: pd.Series) -> pd.Series:
    """Runs of backslashes as long as the source's first run before the same character; a single one where it has none."""
    run = re.compile(r"(\\{2,})(.?)", re.S)

    def one(x: str | None, src: str | None) -> str | None:
        if not x or "\\" not in x:
            return x
        length: dict[str, int] = {}
        for m in re.finditer(r"(\\+)(.?)", src or "", re.S):
            length.setdefault(m[2], len(m[1]))
        return run.sub(lambda m: "\\" * length.get(m[2], 1) + m[2], x)

    return pd.Series([one(x, src) for x, src in zip(text, like)], dtype=object)


# Fixed value: the circled numbers of 1 to 20.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def restore_circled(text: Column, like: Column) -> Column:
    """Single digits back to the source's circled numbers, in order, where there are as many of them and no circled one."""
    wanted = F.regexp_extract_all(codes.strip_controls(like), F.lit(f"([{CIRCLED}])"), F.lit(1))
    pieces = F.regexp_extract_all(text, F.lit(codes.PLACEHOLDER + r"|\d+|[^\d@⟦]+|[@⟦]"), F.lit(0))
    lone = lambda p: p.rlike(r"^\d$")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))

    def step(s: Column, p: Column) -> Column:
        return F.struct((s["n"] + lone(p).cast("int")).alias("n"), F.concat(s["text"], F.when(lone(p), F.coalesce(F.get(wanted, s["n"]), p)).otherwise(p)).alias("text"))

    fits = (F.size(wanted) > 0) & ~text.rlike(f"[{CIRCLED}]") & (F.size(F.filter(pieces, lone)) == F.size(wanted))
    return F.when(fits, F.aggregate(pieces, start, step, lambda s: s["text"])).otherwise(text)


def steady_punctuation(text: Column, like: Column) -> Column:
    """The source's form of the ellipsis, and missing halves of pairs that the source has in balance, at the end or the start."""
    src = codes.strip_controls(like)
    bare = codes.strip_controls(text)
    dots, one = "...", "…"
    to_dots = src.contains(dots) & ~src.contains(one) & ~bare.contains(dots) & bare.contains(one)
    to_one = src.contains(one) & ~src.contains(dots) & ~bare.contains(one) & bare.contains(dots)
    out = F.when(to_dots, F.replace(text, F.lit(one), F.lit(dots))).when(to_one, F.replace(text, F.lit(dots), F.lit(one))).otherwise(text)

    def completed(a: str, b: str):
        given, taken = (codes.occurrences(src, x) for x in (a, b))

        def put(x: Column) -> Column:
            here, there = (codes.occurrences(codes.strip_controls(x), m) for m in (a, b))
            if a == b:
                return F.when((given >= 2) & (given % 2 == 0) & (here % 2 == 1), F.concat(x, F.lit(a))).otherwise(x)
            level = (given == taken) & (given > 0)
            return (
                F.when(level & (here > there) & (there > 0), F.concat(x, F.repeat(F.lit(b), here - there)))
                .when(level & (there > here) & (here > 0), F.concat(F.repeat(F.lit(a), there - here), x))
                .otherwise(x)
            )

        return put

    for pair in codes.PAIRS:
        # A one-entry transform names the text so far, which is then written once for each pair.
        out = F.get(F.transform(F.array(out), completed(*pair)), F.lit(0))
    return out
