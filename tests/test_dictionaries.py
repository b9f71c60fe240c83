"""Dictionaries as they come: repeated keys, trailing text, other values, both pairs of names, marks in any order."""

import json
import random

from lexloom.operators import glossary
from lexloom.sources import dictionaries as d


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(texts)], "file string, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_entries(spark):
    made = files(spark, '{"b":"x","b":"y","n":1,"z":null,"o":{"k":[1]}}', '{"x":"1"} trailing', "[1]", "", None, '{"ü":"\\ud800"}')
    assert rows(d.entries(made)) == sorted([("f0", "b", "y"), ("f0", "n", "1"), ("f0", "o", '{"k": [1]}'), ("f0", "z", None), ("f5", "ü", "?")], key=repr)
    assert rows(d.reference_entries(made)) == [("b", "y"), ("ü", "?")]
    good, broken = d.exchange_files(made)
    assert [r.file for r in good.orderBy("file").collect()] == ["f0", "f2", "f5"]
    assert [tuple(r) for r in broken.orderBy("file").collect()] == [("f1", 10, 1, 11, "Extra data"), ("f3", 0, 1, 1, "Expecting value"), ("f4", 0, 1, 1, "no text")]


def test_broken_texts_against_the_parser(spark):
    rng = random.Random(9)
    whole = json.dumps({"a": "x\ny", "b": {"c": [1, 2, "é"]}, "d": "1"}, indent=1, ensure_ascii=False)
    texts = [whole[: rng.randrange(len(whole))] + rng.choice(["", "}", '"', " x", "\n,"]) for _ in range(60)]
    made = {r.file: (r.chars, r.line, r["column"]) for r in d.exchange_files(files(spark, *texts))[1].collect()}
    wanted = {}
    for i, text in enumerate(texts):
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            wanted[f"f{i}"] = (e.pos, e.lineno, e.colno)
    assert made == wanted


def test_exchange_items(spark):
    lists = '{"items":[{"src":"a","dst":"1"},{"原文":"b","译文":"2"},{"src":"","原文":"c","dst":null,"译文":"3"},{"src":"a","dst":5},7,{"dst":"x"}]}'
    maps = '{"items":{"a":"1","a":"2"," ":"x","n":null,"k":3}}'
    made = d.exchange_items(files(spark, lists, maps, '{"items":"no"}', "{"))
    assert rows(made) == sorted([("f0", "a", "5"), ("f0", "b", "2"), ("f0", "c", ""), ("f1", "a", "2"), ("f1", "n", ""), ("f1", "k", "3")], key=repr)


def test_marks(spark):
    texts = ['# STOP\n"z": "0",\n# START\n"a": "b",\n# STOP', '# START\n"a": "b\\n",  # c\nx\n# STOP\n"c": "d",\n# STOP', '# START "a": "b"\n"c": "d"', 'see # START here\n "k" : "v",\n"l": "w", # STOP']
    assert rows(d.pair_lines(files(spark, *texts), "# START", "# STOP").select("file", "src", "dst")) == [("f1", "a", "b\n"), ("f3", "k", "v"), ("f3", "l", "w")]


def test_a_key_that_comes_twice(spark):
    terms = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    made = glossary.merge_terms(terms(("Ash", "a"), ("Bay", "b")), terms(("Ash", "a"), ("Ash ", "x"), ("Bay", "b"), ("Bay ", "b"), ("Cay", "c"), ("Cay ", "d")))
    assert rows(made) == [("Ash", "a", "conflict"), ("Bay", "b", "same"), ("Cay", "c", "added")]
