"""Schemas of typed record files: code strings compiled to expressions that read a value, and to those that write it.

A schema names for each key its codes and, in order, the enumeration of each e or y:
``{"Price": "u", "Moves": ("*ue", "Move")}``. Codes, one for each field:

    i int, u int of 0 or more, v int above 0, x hexadecimal, f float, b boolean, n name,
    s text, m symbol, q rest of the line, e value of an enumeration, y the same or an int

Upper case: a blank field is null (E, Y: so is an unknown value). Codes behind ``*`` repeat
to the end of the value; ``^`` says that the key itself may come again. One code gives a
plain value, several a struct (f0, f1, ...), ``*`` and ``^`` arrays of these.

Enumerations are lists (read as positions), dicts (read as their values) or DataFrames of
one column (read as their names, which are looked up by joins: a table may have any size).

Everything is columns: fields are cut by one pattern, so reading stays in the JVM. A
field that breaks its code is null and named in ``errors`` as ``key.field:reason``.

Kept as the format has them: b is true by a 1 in front, a true or yes anywhere or a y at
its end, and likewise false; B is false for anything else; F takes no sign; y reads any
value with a digit as its leading int; fields beyond the codes are ignored; a quote is
escaped on writing but a backslash isn't. Behind a field with broken quotes the line is
cut at its commas.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

#: A field with the comma behind it; whatever is cut, the pieces make up the whole value.
FIELD = r'\s*"(?:\\.|[^"\\])*(?:"\s*(?:,|$)|\\?$)|[^,]*(?:,|$)'
QUOTED = r'^\s*"((?:\\.|[^"\\])*)(?:"\s*,?$|\\?$)'
CLOSED = r'^\s*"((?:\\.|[^"\\])*)"\s*,?$'
#: White space of patterns.
SPACES = " \t\n\x0b\f\r"
Enums = dict[str, "list[str] | dict[str, object] | DataFrame"]


@dataclass(frozen=True)
class Key:
    """The codes of one key."""

    name: str
    codes: str
    enums: tuple[str, ...] = ()

    def __post_init__(self):
        known = set("iuvxfbnsmqeyIUVXFBNSMQEY")
        if not self.plain or not set(self.plain) <= known:
            raise ValueError(f"{self.name}: unknown codes {self.codes!r}")
        if self.repeats and set("qQ") & set(self.plain):
            raise ValueError(f"{self.name}: the rest of a line can't repeat")
        if len(self.enums) != sum(c in "eEyY" for c in self.plain):
            raise ValueError(f"{self.name}: {len(self.enums)} enumerations for {self.codes!r}")

    @cached_property
    def plain(self) -> str:
        return self.codes.lstrip("*^")

    @property
    def repeats(self) -> bool:
        return "*" in self.codes[: len(self.codes) - len(self.plain)]

    @property
    def many(self) -> bool:
        return "^" in self.codes[: len(self.codes) - len(self.plain)]

    def enum(self, i: int) -> str | None:
        """The enumeration of the i-th code, if it has one."""
        return self.enums[sum(c in "eEyY" for c in self.plain[:i])] if self.plain[i] in "eEyY" else None


def let(x: Column, then) -> Column:
    """``then`` of a column that is computed once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def compiled(schema: dict[str, str | tuple]) -> list[Key]:
    return [Key(name, *((own,) if isinstance(own, str) else (own[0], tuple(own[1:])))) for name, own in schema.items()]


def cut(value: Column) -> Column:
    """The fields of a value as they stand, commas included; none of an empty value."""
    pieces = F.regexp_extract_all(value, F.lit(FIELD), F.lit(0))
    return let(pieces, lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))  # the last match is the empty one at the end


def opens(piece: Column) -> Column:
    """Whether a piece begins with a quote."""
    return F.ltrim(piece, F.lit(SPACES)).startswith('"')


def field(piece: Column) -> Column:
    """What a piece says: unquoted with its ends trimmed, or the inside of its quotes."""
    inside = F.regexp_replace(F.regexp_extract(piece, QUOTED, 1), r"\\(.)", "$1")
    bare = F.trim(F.rtrim(piece, F.lit(",")), F.lit(SPACES))  # only a quoted piece has a comma before its end
    return F.when(opens(piece), inside).otherwise(bare)


def _leading_int(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(v, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def _read(code: str, v: Column, enum) -> tuple[Column, Callable[[Column], Column]]:
    """Value of a field, and the reason why it has none, from that value: it is worked out once for both."""
    kind, optional = code.lower(), code.isupper()
    blank = v == ""
    never = lambda x: F.lit(None).cast("string")
    if kind in "smq":
        return (F.when(~blank, v) if optional or kind == "m" else v), (lambda x: F.when(x.isNull(), "blank")) if code == "m" else never
    if kind in "ey":
        if isinstance(enum, list):
            found = F.array_position(F.array(*map(F.lit, enum)), v)
            value = F.when(found > 0, (found - 1).cast("long"))
        elif isinstance(enum, dict):
            value = F.element_at(F.create_map(*[F.lit(x) for kv in enum.items() for x in kv]), v)
        else:
            value = F.when(~blank, v)  # looked up by a join
        if kind == "y":
            whole = v.rlike(r"^-?\d+$") if optional else v.rlike(r"\d")
            value = F.when(whole, _leading_int(v).cast("string")).otherwise(value.cast("string"))
        return value, never if optional else lambda x: F.when(x.isNull(), "undefined")
    value, fine, reason = {
        "i": (v.try_cast("long"), v.rlike(r"^-?\d+$"), "integer"),
        "u": (v.try_cast("long"), v.rlike(r"^\d+$"), "0 or greater"),
        "v": (v.try_cast("long"), v.rlike(r"^\d+$") & (v.try_cast("long") > 0), "greater than 0"),
        "x": (F.conv(v, 16, 10).try_cast("long"), v.rlike("^[0-9A-Fa-f]+$"), "hexadecimal"),
        "f": (F.coalesce(v.try_cast("double"), F.lit(0.0)), v.rlike(r"^\d*\.?\d*$") if optional else v.rlike(r"^[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?$"), "number"),
        "b": (v.rlike("^1|(?i:true|yes)|[yY]$" + ("|[tT]" if optional else "")), F.lit(True) if optional else v.rlike("^[01]|(?i:true|yes|false|no)|[yYnN]$"), "boolean"),
        "n": (v, v.rlike(r"^(?![0-9])\w+$"), "name"),
    }[kind]
    fine = F.coalesce(fine & value.isNotNull(), F.lit(False))
    return F.when(fine & ~blank, value) if optional else F.when(fine, value), lambda x: F.when(x.isNull() & ~blank if optional else x.isNull(), reason)


def _checked(code: str, piece: Column, last: Column, enum) -> Column:
    def read(v: Column) -> Column:
        value, error = _read(code, v, enum)
        return let(value, lambda x: F.struct(x.alias("v"), error(x).alias("e")))

    # Quotes may stay open to the end of the value, and nowhere else.
    broken = opens(piece) & ~piece.rlike(CLOSED) & ~(last & piece.rlike(QUOTED))
    none = F.when(F.lit(False), _read(code, piece, enum)[0])
    return F.when(broken, F.struct(none.alias("v"), F.lit("quoted").alias("e"))).otherwise(let(field(piece), read))


def read_value(key: Key, value: Column, enums: Enums) -> Column:
    """Struct of the value and the array of its errors."""

    def record(pieces: Column, start: Column) -> Column:
        fields = []
        for i, code in enumerate(key.plain):
            if code in "qQ":
                rest = F.array_join(F.slice(pieces, start + i + 1, F.greatest(F.size(pieces) - start - i, F.lit(0))), "")
                both = let(rest, lambda v: F.struct(_read(code, v, None)[0].alias("v"), F.lit(None).cast("string").alias("e")))
            else:
                piece = F.coalesce(F.get(pieces, start + i), F.lit(""))
                both = let(piece, lambda p: _checked(code, p, start + i >= F.size(pieces) - 1, enums.get(key.enum(i))))
            fields.append(both.alias(f"f{i}"))

        def parted(x: Column) -> Column:
            values = [x[f"f{i}"]["v"].alias(f"f{i}") for i in range(len(fields))]
            errors = [F.concat(F.lit(f"{key.name}.{i}:"), x[f"f{i}"]["e"]) for i in range(len(fields))]
            one = values[0].alias("value") if len(values) == 1 else F.struct(*values).alias("value")
            return F.struct(one, F.filter(F.array(*errors), lambda e: e.isNotNull()).alias("errors"))

        return let(F.struct(*fields), parted)  # a field is named for its value and its error, and read once

    def read(x: Column) -> Column:
        if not key.repeats:
            return let(cut(x), lambda pieces: record(pieces, F.lit(0)))
        width = len(key.plain)
        last = lambda pieces: F.greatest(F.ceil(F.size(pieces) / width) - 1, F.lit(0)).cast("int")
        every = let(cut(x), lambda pieces: F.transform(F.sequence(F.lit(0), last(pieces)), lambda k: record(pieces, k * width)))
        return let(every, _gathered)

    return let(F.transform(value, read), _gathered) if key.many else read(value)


def _gathered(parts: Column) -> Column:
    return F.struct(F.transform(parts, lambda p: p["value"]).alias("value"), F.flatten(F.transform(parts, lambda p: p["errors"])).alias("errors"))


def _paths(key: Key, enums: Enums) -> list[tuple[int, str]]:
    """Fields of the key that a table enumerates."""
    return [(i, key.enum(i)) for i in range(len(key.plain)) if isinstance(enums.get(key.enum(i)), DataFrame)]


def _names(key: Key, i: int, value: Column) -> Column:
    """Array of all names that field i has in a value."""
    take = (lambda x: x) if len(key.plain) == 1 else (lambda x: x[f"f{i}"])
    depth = key.repeats + key.many
    if depth == 0:
        return F.array(take(value))
    return F.transform(value if depth == 1 else F.flatten(value), take)


def _nulled(key: Key, i: int, value: Column, unknown: Column) -> Column:
    """The value with the names that no table knows as null."""

    def one(x: Column) -> Column:
        if len(key.plain) == 1:
            return F.when(~F.array_contains(unknown, x), x)
        return x.withField(f"f{i}", F.when(~F.array_contains(unknown, x[f"f{i}"]), x[f"f{i}"]))

    for _ in range(key.repeats + key.many):
        one = (lambda inner: lambda x: F.transform(x, inner))(one)
    return one(value)


def read_records(rows: DataFrame, keys: list[str], schema: dict[str, str | tuple], enums: Enums | None = None) -> DataFrame:
    """A column for each key of the schema and ``errors``, one row for each record, from rows (keys, place, name, value).

    Of a key that comes again without ``^`` the last value counts. Names outside the
    schema are ignored; a record without any name of it has no row. keys aren't null.
    """
    enums, made = enums or {}, compiled(schema)
    plain = [f"v{i}_" for i in range(len(made))]

    def own(k: Key) -> Column:
        mine = F.col("name") == k.name
        if k.many:
            every = F.transform(F.sort_array(F.collect_list(F.when(mine, F.struct("place", "value")))), lambda x: x["value"])
            return F.when(F.size(every) > 0, every)
        return F.max_by("value", F.when(mine, F.col("place")))

    wide = rows.where(F.col("name").isin([k.name for k in made])).groupBy(*keys).agg(*[own(k).alias(c) for k, c in zip(made, plain, strict=True)])
    read = wide.select(*keys, *[F.when(F.col(c).isNotNull(), read_value(k, F.col(c), enums)).alias(c) for k, c in zip(made, plain, strict=True)])
    errors = F.flatten(F.transform(F.filter(F.array(*[F.col(c)["errors"] for c in plain]), lambda e: e.isNotNull()), lambda e: e))
    read = read.select(*keys, *[F.col(c)["value"].alias(c) for c in plain], errors.alias("errors"))
    looked_up = [(k, c, i, enum) for k, c in zip(made, plain, strict=True) for i, enum in _paths(k, enums)]
    if looked_up:
        names = F.flatten(F.array(*[F.transform(_names(k, i, F.col(c)), lambda x: F.struct(F.lit(enum).alias("enum"), x.alias("name"))) for k, c, i, enum in looked_up]))
        used = read.select(*keys, F.explode(F.array_distinct(F.filter(names, lambda x: x["name"].isNotNull()))).alias("x")).select(*keys, "x.*")
        known = None
        for enum in dict.fromkeys(e for *_, e in looked_up):
            table = enums[enum]
            part = table.select(F.lit(enum).alias("enum"), F.col(table.columns[0]).cast("string").alias("name")).distinct()
            known = part if known is None else known.unionByName(part)
        # Most names are known: what goes back to the records is little.
        unknown = used.join(known, ["enum", "name"], "left_anti").groupBy(*[F.col(k).alias(f"own_{k}") for k in keys]).agg(F.collect_set(F.struct("enum", "name")).alias("unknown_"))
        read = read.join(unknown, [F.col(k) == F.col(f"own_{k}") for k in keys], "left").drop(*[f"own_{k}" for k in keys])
        read = read.withColumn("unknown_", F.coalesce("unknown_", F.array()))
        for k, c, i, enum in looked_up:
            lost = F.transform(F.filter("unknown_", lambda x: x["enum"] == enum), lambda x: x["name"])
            if k.plain[i].islower():
                wrong = F.transform(F.filter(_names(k, i, F.col(c)), lambda x: F.array_contains(lost, x)), lambda x: F.lit(f"{k.name}.{i}:undefined"))
                read = read.withColumn("errors", F.concat("errors", F.coalesce(wrong, F.array())))
            read = read.withColumn(c, _nulled(k, i, F.col(c), lost))
    return read.select(*keys, *[F.col(c).alias(k.name) for k, c in zip(made, plain, strict=True)], "errors")


def quoted(x: Column) -> Column:
    """A text as it is written: in quotes, with its own escaped, where it holds a comma or a quote."""
    return F.when(x.rlike('[,"]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(x)


def _written(code: str, x: Column, enum) -> Column:
    if code in "qQ":
        return x
    if code in "eEyY" and isinstance(enum, list):
        name = F.get(F.array(*map(F.lit, enum)), x.try_cast("int"))
        return quoted(F.coalesce(name, x.cast("string")) if code in "yY" else name)
    if code in "eEyY" and isinstance(enum, dict):
        first = {str(v): k for k, v in reversed(enum.items())}  # of several names of a value the first is written
        name = F.element_at(F.create_map(*[F.lit(y) for kv in first.items() for y in kv]), x.cast("string"))
        return quoted(F.coalesce(name, x.cast("string")) if code in "yY" else name)
    if code in "xX":
        return F.hex(x)
    return quoted(x.cast("string"))


def write_value(key: Key, value: Column, enums: Enums | None = None) -> Column:
    """The text of a value; of a ``^`` key the array of its texts."""
    enums = enums or {}

    def one(x: Column) -> Column:
        parts = [_written(c, x if len(key.plain) == 1 else x[f"f{i}"], enums.get(key.enum(i))) for i, c in enumerate(key.plain)]
        return F.array_join(F.array(*parts), ",", "")

    text = (lambda x: F.array_join(F.transform(x, one), ",")) if key.repeats else one
    return F.transform(value, text) if key.many else text(value)


def write_records(records: DataFrame, schema: dict[str, str | tuple], enums: Enums | None = None) -> Column:
    """``Name = value`` lines of a record in the schema's order; null values have none."""
    lines = []
    for key in compiled(schema):
        head = F.lit(f"{key.name} = ")
        text = write_value(key, records[key.name], enums)
        lines.append(F.transform(text, lambda x: F.concat(head, x)) if key.many else F.array(F.when(records[key.name].isNotNull(), F.concat(head, text))))
    return F.array_join(F.flatten(F.filter(F.array(*lines), lambda x: x.isNotNull())), "\n")


def numbered_parts(rows: DataFrame, keys: list[str], starter: str) -> DataFrame:
    """Adds ``part``: 0 for a record's own rows, 1, 2, ... for those of its sub-records, each begun by a row named ``starter``."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("part", F.count(F.when(F.col("name") == starter, 1)).over(so_far))
