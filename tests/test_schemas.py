"""Schemas against a reader of one value after another, written plainly, on random values; and read, change, write, read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import schemas

ENUMS = {"Kind": ["Red", "Green", "Blue"], "Size": {"S": 1, "M": 2, "L": 3}}


def take(rest):
    """A field and what is left, None for a fault; the way a reader goes through a line."""
    rest = rest.lstrip()
    if rest[:1] == '"':
        out, i = "", 1
        while i < len(rest) and rest[i] != '"':
            i += rest[i] == "\\"
            out += rest[i : i + 1]
            i += 1
        rest = rest[i + 1 :].lstrip()
        if rest and rest[0] != ",":
            return None, rest.partition(",")[2]
        return out, rest[1:]
    own, _, rest = rest.partition(",")
    return own.rstrip(), rest


def decoded(code, v, enum, known):
    kind = code.lower()
    if code.isupper() and v == "":
        return None
    if kind == "s":
        return v
    if kind == "m":
        return v if v else ValueError
    if kind in "iuv":
        if not re.fullmatch(r"-?\d+" if kind == "i" else r"\d+", v) or kind == "v" and int(v) == 0:
            return ValueError
        return int(v)
    if kind == "x":
        return int(v, 16) if re.fullmatch("[0-9A-Fa-f]+", v) else ValueError
    if kind == "f":
        pattern = r"\d*\.?\d*" if code == "F" else r"[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?"
        return float(v if v != "." else 0) if re.fullmatch(pattern, v) else ValueError
    if kind == "b":
        if re.search("^1|true|yes|y$", v, re.I) or code == "B" and re.search("t", v, re.I):
            return True
        return False if code == "B" or re.search("^0|false|no|n$", v, re.I) else ValueError
    if kind == "n":
        return v if re.fullmatch(r"(?![0-9])[A-Za-z0-9_]+", v) else ValueError
    if kind == "y" and re.search(r"\d" if code == "y" else r"^-?\d+$", v):
        return str(int((re.match(r"\s*([+-]?\d+)", v) or [0, "0"])[1]))
    own = ENUMS.get(enum)
    found = own.index(v) if isinstance(own, list) and v in own else own.get(v) if isinstance(own, dict) else v if own is None and v in known else None
    if found is None:
        return None if code.isupper() else ValueError
    return str(found) if kind == "y" else found


def walked(key, value, known):
    errors, out = 0, []
    while True:
        record = []
        for i, code in enumerate(key.plain):
            if code in "qQ":
                v, value = value, ""
                record.append(v if v or code == "q" else None)
                continue
            v, value = take(value)
            if v is None:
                return None, None  # what follows broken quotes has no meaning
            x = decoded(code, v, key.enum(i), known)
            errors += x is ValueError
            record.append(None if x is ValueError else x)
        out.append(record[0] if len(record) == 1 else tuple(record))
        if not key.repeats or not value:
            return (out if key.repeats else out[0]), errors


def plain(x):
    return tuple(plain(y) for y in x) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else x


CODES = ["i", "u", "V", "x", "f", "F", "b", "B", "n", "s", "S", "q", "iQ", ("e", "Kind"), ("E", "Size"), ("y", "Kind"), ("Y", "Size"), "usS", "*u", "*s", ("*ue", "Kind"), ("*Ues", "Name"), ("*e", "Name"), "*UUS", "bq", "m"]


def test_random_values(spark):
    rng = random.Random(5)
    bits = ["", " ", "1", "-2", "0", "007", "3.5", ".", "1e3", "ff", "Red", "Blue", "M", "known", "other", '"a, b"', '"q\\"x\\\\"', '"bad" x', '"open', "yes", "no", "True", "n_1", "1a", " pad "]
    schema = {f"K{i}": own for i, own in enumerate(CODES)}
    rows, values = [], {}
    for r in range(80):
        for name in schema:
            values[r, name] = ",".join(rng.choice(bits) for _ in range(rng.randrange(1, 5)))
            rows.append((r, 0, name, values[r, name]))
    names = spark.createDataFrame([("known",), ("Red",)], "name string")
    made = schemas.read_records(spark.createDataFrame(rows, "r int, place int, name string, value string"), ["r"], schema, ENUMS | {"Name": names}).collect()
    assert len(made) == 80
    for row in made:
        for key in schemas.compiled(schema):
            wanted, errors = walked(key, values[row.r, key.name], {"known", "Red"})
            if errors is None:
                assert any(re.fullmatch(f"{key.name}\\.\\d:quoted", e) for e in row.errors)
                continue
            assert plain(row[key.name]) == wanted, (key, values[row.r, key.name])
            assert sum(e.startswith(f"{key.name}.") for e in row.errors) == errors, (key, values[row.r, key.name], row.errors)


#: Keys and codes of some record files.
TABLES = {
    "region map": ({"Name": "s", "Filename": "s", "Point": "^uusSUUUU", "Flags": "*s"}, 'Name = Kanto\nFilename = map.png\nPoint = 1,2,Town,,3,4,5,\nPoint = 2,2,"A, b",Lake,,,,\nFlags = a,"b,c"'),
    "type": ({"Name": "s", "IconPosition": "u", "IsSpecialType": "b", "Weaknesses": "*m", "Flags": "*s"}, "Name = Fire\nIconPosition = 3\nIsSpecialType = true\nWeaknesses = WATER,ROCK\nFlags = x"),
    "plant": ({"HoursPerStage": "v", "DryingPerHour": "u", "Yield": "uv"}, "HoursPerStage = 3\nDryingPerHour = 15\nYield = 2,5"),
    "species": (
        {"Name": "s", "BaseStats": "vvvvvv", "EVs": ("*ev", "Stat"), "Moves": ("*ue", "Move"), "Evolutions": ("*ses", "Way"), "Height": "f", "Pokedex": "q"},
        'Name = Seed\nBaseStats = 45,49,49,45,65,65\nEVs = HP,1,SPEED,2\nMoves = 1,TACKLE,3,GROWL\nEvolutions = TREE,Level,16,STONE,Item,"a, b"\nHeight = 0.7\nPokedex = A seed, "on" its back.',
    ),
}


def lines(text):
    return [(1, i, *line.split(" = ", 1)) for i, line in enumerate(text.split("\n"))]


@pytest.mark.parametrize("name", TABLES)
def test_read_and_written_back(spark, name):
    schema, text = TABLES[name]
    enums = {"Stat": ["HP", "SPEED"], "Way": {"Level": 7, "Item": 9}, "Move": spark.createDataFrame([("TACKLE",), ("GROWL",)], "id string")}
    read = lambda text: schemas.read_records(spark.createDataFrame(lines(text), "r int, place int, name string, value string"), ["r"], schema, enums)
    made = read(text)
    assert made.first().errors == []
    write = lambda df: df.select(schemas.write_records(df, schema, enums).alias("x")).first().x
    assert write(made) == text
    changed = made.withColumn(next(iter(schema)), F.lit("New, name" if "Name" in schema else 8).cast(made.schema[next(iter(schema))].dataType))
    again = read(write(changed))
    assert again.first() == changed.first() and write(again) != text


def test_each_error_is_named(spark):
    schema = {"A": "uv", "B": ("*ue", "Move"), "C": "b", "D": "x", "E": ("e", "Kind"), "F": "^i"}
    text = 'A = -1,0\nB = 1,TACKLE,2,LOST\nC = maybe\nD = "f" g\nE = Grey\nF = 1\nF = one\nOther = 1'
    enums = ENUMS | {"Move": spark.createDataFrame([("TACKLE",)], "id string")}
    row = schemas.read_records(spark.createDataFrame(lines(text), "r int, place int, name string, value string"), ["r"], schema, enums).first()
    assert sorted(row.errors) == ["A.0:0 or greater", "A.1:greater than 0", "B.1:undefined", "C.0:boolean", "D.0:quoted", "E.0:undefined", "F.0:integer"]
    assert plain(row.B) == [(1, "TACKLE"), (2, None)] and row.F == [1, None] and row.A.f0 is None
    for codes in ("", "z", "*q"):
        with pytest.raises(ValueError):
            schemas.compiled({"K": codes})
    with pytest.raises(ValueError):
        schemas.compiled({"K": "e"})


def test_sub_records(spark):
    rows = [(1, i, *x) for i, x in enumerate([("Items", "A"), ("Pokemon", "P,5"), ("Name", "x"), ("Pokemon", "Q,6"), ("Shiny", "yes")])]
    parts = schemas.numbered_parts(spark.createDataFrame(rows, "r int, place int, name string, value string"), ["r"], "Pokemon")
    made = schemas.read_records(parts.where("part > 0"), ["r", "part"], {"Pokemon": "mv", "Name": "s", "Shiny": "b"}).orderBy("part").collect()
    assert [(plain(r.Pokemon), r.Name, r.Shiny) for r in made] == [(("P", 5), "x", None), (("Q", 6), None, True)]
