"""Typed records from sections of text, by schemas of field codes, and lookups between their tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

#: One code for each field: i int, u int of 0 or more, v int above 0, x hexadecimal, f float, b boolean,
#: n identifier, s text, q rest of the line, e value of a list; upper case: may be blank; leading *: repeated.
Schema = dict[str, str]


def decode(value: Column, code: str, choices: list[str] | None = None) -> Column:
    """Struct of the decoded ``value`` and an ``error``; a blank value is an error only for lower-case codes."""
    kind, v = code.lower(), F.trim(value)
    blank = v.isNull() | (v == "")
    number = v.try_cast("long")
    made, fine = {
        "i": (number, v.rlike(r"^-?\d+$") & number.isNotNull()),
        "u": (number, v.rlike(r"^\d+$") & number.isNotNull()),
        "v": (number, v.rlike(r"^\d+$") & (number > 0)),
        "x": (F.conv(v, 16, 10).try_cast("long"), v.rlike("^[0-9A-Fa-f]+$")),
        "f": (v.try_cast("double"), v.rlike(r"^-?\d+(\.\d+)?$")),
        # Any value that begins with 1 or ends in y is true; kept as the format has it.
        "b": (F.lower(v).rlike("^1|^(true|yes)$|y$"), F.lower(v).rlike("^[01]|^(true|false|yes|no)$|[yn]$")),
        "n": (v, v.rlike(r"^[A-Za-z_]\w*$")),
        "s": (v, F.lit(True)),
        "q": (value, F.lit(True)),
        "e": (v, v.isin(choices or [""])),
    }[kind]
    wrong = F.when(blank, F.lit(None if code.isupper() else "blank")).when(~fine, "invalid")
    return F.struct(F.when(~blank & fine, made).alias("value"), wrong.alias("error"))


def typed_records(fields: DataFrame, keys: list[str], schema: Schema, choices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each record from rows (keys, name, value): a column for each field, and ``errors`` as name:reason."""
    wide = fields.groupBy(*keys).pivot("name", list(schema)).agg(F.first("value"))
    decoded = {}
    for name, code in schema.items():
        if code.startswith("*"):
            one = partial(decode, code=code[1:], choices=(choices or {}).get(name))
            parts = F.transform(F.split(F.col(name), ","), lambda x: one(x))  # noqa: B023
            first = F.get(F.filter(parts, lambda p: p["error"].isNotNull()), F.lit(0))["error"]
            decoded[name] = F.struct(F.transform(parts, lambda p: p["value"]).alias("value"), first.alias("error"))
        else:
            decoded[name] = decode(F.col(name), code, (choices or {}).get(name))
    out = wide.select(*keys, *[x.alias(name) for name, x in decoded.items()])
    errors = F.filter(F.array(*[F.concat(F.lit(f"{n}:"), F.col(f"{n}.error")) for n in schema]), lambda e: e.isNotNull())
    return out.select(*keys, *[F.col(f"{n}.value").alias(n) for n in schema], errors.alias("errors"))


def encode_record(schema: Schema, columns: dict[str, Column]) -> Column:
    """``Name = value`` lines of a record, in the schema's order; null fields are left out."""
    from .rules import quote_field

    rows = []
    for name, code in schema.items():
        x = columns[name]
        text = F.array_join(F.transform(x, lambda v: v.cast("string")), ",") if code.startswith("*") else x.cast("string")
        rows.append(F.concat(F.lit(f"{name} = "), text if code.lower() in "iuvxfbq" or code.startswith("*") else quote_field(text)))
    return F.array_join(F.array(*rows), "\n")


def missing_keys(rows: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose value, if any, is no key of the dimension."""
    return rows.where(F.col(column).isNotNull()).join(dimension.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def range_lookup(rows: DataFrame, value: str, steps: DataFrame, low: str, result: str) -> DataFrame:
    """The ``result`` of the last step that begins at or before the value.

    Steps are few and of a checked size, as one sorted array; larger ones take the join of ``as_of``.
    """
    limit = 10_000
    few = steps.select(low, result).limit(limit + 1)
    if few.count() > limit:
        return as_of(rows, value, steps, low, result)
    whole = few.agg(F.sort_array(F.collect_list(F.struct(low, result))).alias("steps_"))
    at = F.filter("steps_", lambda s: s[low] <= F.col(value))
    return rows.crossJoin(F.broadcast(whole)).withColumn(result, F.get(at, F.size(at) - 1)[result]).drop("steps_")


def as_of(rows: DataFrame, value: str, steps: DataFrame, low: str, result: str, buckets: int = 1024) -> DataFrame:
    """The same by sorting rows and steps together, in ranges of the value; no join."""
    from pyspark.sql import Window

    names = rows.columns
    cuts = steps.select(F.percentile_approx(F.col(low), [i / buckets for i in range(1, buckets)], 10 * buckets).alias("c")).first().c or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= F.col("at_"))) if cuts else F.lit(0)
    left = rows.withColumns({"at_": F.col(value), "kind_": F.lit(1), result: F.lit(None).cast(dict(steps.dtypes)[result])})
    right = steps.select(F.col(low).alias("at_"), F.col(result), F.lit(0).alias("kind_"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("part_", part)
    so_far = Window.partitionBy("part_").orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(result, F.last(result, ignorenulls=True).over(so_far))
    # A part without a step at its start takes the last step of the parts before.
    last = steps.withColumn("at_", F.col(low)).withColumn("part_", part).groupBy("part_").agg(F.max_by(result, low).alias("r_"))
    earlier = sorted((r.part_, r.r_) for r in last.collect())  # buckets rows at most
    before = {p: max((x for x in earlier if x[0] < p), default=(0, None))[1] for p in range(len(set(cuts)) + 1)}
    known = {p: r for p, r in before.items() if r is not None}
    found = both.where("kind_ = 1")
    if known:
        table = F.create_map(*[F.lit(y) for kv in known.items() for y in kv])
        found = found.withColumn(result, F.coalesce(result, table[F.col("part_")]))
    return found.select(*names, result)
