"""Terms at word boundaries against a regular expression, on random rows."""

import random
import re

from lexloom.operators import matching

BORDER = r"\wÀ-ɏ"


def test_terms_of_any_characters_against_patterns(spark):
    rng = random.Random(8)
    letters = ["a", "b", "é", "汉", "7", "_", ".", "?", "!", " ", " ", "-", "😀", "\n", "[", "\\"]
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "Prof. Oak, Poké Ball! and ???"), (903, "Prof.Oak")]
    terms = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(120)} | {"Prof.", "???", "Poké Ball!"})
    wanted = set()
    for i, text in texts:
        for term in terms:
            if text and not re.search(r"[\\\[\]]", term):
                pattern = re.compile(f"(?=(?<![{BORDER}]){re.escape(term)}(?![{BORDER}]))")
                wanted |= {(i, term, len(re.findall(rf"[{BORDER}]+|[^{BORDER}]", text[: m.start()]))) for m in pattern.finditer(text)}
    rows = spark.createDataFrame(texts, "id int, text string")
    made = matching.term_hits(rows, spark.createDataFrame([(x,) for x in [*terms, "???"]] + [(None,), ("",)], "src string"), ["id"])
    assert {tuple(r) for r in made.select("id", "src", "at").collect()} == wanted
    assert made.count() == len(wanted)
    first = {r.id: r.src for r in matching.first_term(made, ["id"]).collect()}
    assert first[902] == "Prof." and 903 not in first
    for i in first:
        own = [x for x in wanted if x[0] == i]
        least = min(x[2] for x in own)
        assert first[i] == max((x[1] for x in own if x[2] == least), key=len)
    assert matching.term_hits(rows.limit(0), spark.createDataFrame([("a",)], "src string"), ["id"]).collect() == []
    assert matching.term_hits(rows, spark.createDataFrame([], "src string"), ["id"]).collect() == []
