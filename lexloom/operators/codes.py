"""Control codes, tags and placeholders of game texts: found, counted and taken off."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Classes of symbols, placeholders and pairs of punctuation.
CONTROL = r"\\(?!n)[A-Za-z]+(?:\[[^\]]*\])?|\\[$.|!><^{}]"
TAG = r"<[^<>]*>"
ENTITY = r"&#?[A-Za-z0-9]+;"
BRACE = r"\{[^{}]*\}"
PLACEHOLDER = r"@\s*\d+\s*@|⟦\s*\d+\s*⟧"
PAIRS = (("「", "」"), ("『", "』"), ('"', '"'), ("'", "'"), ("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"), ("{", "}"), ("《", "》"))
NAME_TAG = r"\\(?:tg|xn)\[[^\]]*\]"


def occurrences(x: Column, part: str) -> Column:
    return F.floor((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def found(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def strip_controls(x: Column) -> Column:
    """Plain text: tags, entities, control codes, the two characters of a written line break, and braces go."""
    x = F.coalesce(x, F.lit(""))
    for pattern in (TAG, ENTITY, CONTROL, r"\\n", BRACE):
        x = F.regexp_replace(x, pattern, "")
    return x


def symbols(x: Column) -> dict[str, Column]:
    """Symbols of each class: controls (with tags and entities), tags in square brackets, braces."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), CONTROL, "")
    return {"control": F.concat(found(x, CONTROL), found(x, TAG), found(x, ENTITY)), "bracket": found(bare, r"\[[^\[\]]*\]"), "brace": found(bare, BRACE)}


def boundaries(x: Column) -> Column:
    """Ends of the control codes that a text begins with, one after another."""
    head = F.regexp_extract(x, f"^(?:{CONTROL})+", 0)
    lengths = F.transform(found(head, CONTROL), lambda c: F.length(c))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends"))
    return F.aggregate(lengths, start, step, lambda s: s["ends"])


def signature(x: Column) -> Column:
    """Control codes of a prefix, names inside name tags left out."""
    return F.transform(found(x, CONTROL), lambda c: F.when(c.rlike(NAME_TAG), F.regexp_replace(c, r"\[[^\]]*\]", "[]")).otherwise(c))


def mismatches(src: Column, dst: Column) -> Column:
    """Codes of the source that differ from the translation's at the same place, as a > b."""
    paired = F.zip_with(signature(src), signature(dst), lambda p, q: F.when(~p.eqNullSafe(q), F.concat(F.coalesce(p, F.lit("-")), F.lit(" > "), F.coalesce(q, F.lit("-")))))
    return F.filter(paired, lambda p: p.isNotNull())


def name_tags(x: Column, names: Column) -> Column:
    """The names in name tags replaced by a map's values; all else stays."""
    pieces = F.regexp_extract_all(x, F.lit(NAME_TAG + r"|[^\\]+|\\"), F.lit(0))
    name = lambda p: F.regexp_extract(p, r"\[([^\]]*)\]", 1)
    put = lambda p: F.when(p.rlike(f"^{NAME_TAG}$"), F.concat(F.regexp_extract(p, r"^([^\[]*\[)", 1), F.coalesce(names[name(p)], name(p)), F.lit("]"))).otherwise(p)
    return F.array_join(F.transform(pieces, put), "")


def strip_echo(x: Column, *candidates: Column) -> Column:
    """A text without the first of the candidates that it begins with."""
    out = x
    for c in reversed(candidates):
        out = F.when((c != "") & x.startswith(c), F.substring(x, F.length(c) + 1, F.length(x))).otherwise(out)
    return out
