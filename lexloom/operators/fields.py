"""Fields of record lines: a lexer with quotes and escapes, and its writer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def split_fields(line: str | None) -> list[str] | None:
    """Fields between commas; one in quotes may hold commas and escaped characters, others lose white space at their ends."""
    if line is None:
        return None
    out, at = [], 0
    while True:
        while at < len(line) and line[at].isspace():
            at += 1
        if line[at : at + 1] == '"':
            at, made = at + 1, []
            while at < len(line) and line[at] != '"':
                at += line[at] == "\\"
                made.append(line[at : at + 1])
                at += 1
            rest = line[at + 1 :].lstrip()
            if rest and rest[0] != ",":
                return None
            out.append("".join(made))
            at = len(line) - len(rest)
        else:
            stop = line.find(",", at)
            stop = len(line) if stop < 0 else stop
            out.append(line[at:stop].rstrip())
            at = stop
        if at >= len(line):
            return out
        at += 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def lexed(line: pd.Series) -> pd.Series:
    """Fields of each line; null where text follows a closing quote."""
    return line.map(split_fields)


def quoted_field(x: Column) -> Column:
    """A field as it is written: in quotes, with its own escaped, where it holds a comma or a quote."""
    return F.when(F.coalesce(x, F.lit("")).rlike('[,"]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))


def repeated(fields: Column, width: int) -> Column:
    """Fields of a repeated compound value as sub-records of ``width``; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(fields) - 1) / width).cast("int")), lambda i: F.slice(fields, i * width + 1, width))
