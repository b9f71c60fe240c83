"""The automaton of event commands against a plain walk over random lists."""

import random
import re

from lexloom.operators import event_commands as ec

COLUMNS = "map int, event int, page int, place int, code int, text string, number int, texts array<string>, route array<struct<code int, text string>>"
PATTERN = re.compile(r'_I\s*\(\s*"((?:[^\\"]*\\"?)*[^"]*)"')


def walked(rows):
    """Texts of each map in order: what a reader of the lists, row by row, gathers."""

    def scripts(text):
        return [x.replace('\\"', '"').replace("\\\\", "\\") for x in PATTERN.findall(text or "")]

    out = {}
    lists = {}
    for r in rows:
        lists.setdefault(r[:3], []).append(r)
    for key in sorted(lists):
        items, choices = out.setdefault(key[0], ([], []))
        open_, said = False, ""
        for _, _, _, _, code, text, number, texts, route in sorted(lists[key], key=lambda r: r[3]):
            if open_ and code != 401:
                if said:
                    items.append(re.sub(r"([^.!?])\s\s+", r"\1 ", said))
                open_, said = False, ""
            if code in (101, 401):
                said += (" " if code == 401 and said else "") + (text or "")
                open_ = True
            elif code == 102:
                choices += [x for x in texts or [] if x is not None]
            elif code in (355, 655) or code == 111 and number == 12:
                items += scripts(text)
            elif code == 209:
                for step in route or []:
                    items += scripts(step[1]) if step[0] == 45 else []
        if open_ and said:
            items.append(said)
    return {m: list(dict.fromkeys(items + choices)) for m, (items, choices) in out.items() if items or choices}


def random_rows(seed, size):
    rng = random.Random(seed)
    texts = ["", None, "Hello", "a  b.   c", "x !   y", ' \\"', "Hello", "tail  ", "ä   ö"]
    script = lambda: "".join(rng.choice(['_I("a\\"b")', '_I ( "x" )', "_INTL(\"no\")", '_I("c\\\\")', "p ", '_I("")', '_I("q']) for _ in range(rng.randrange(4)))
    rows, place = [], {}
    for _ in range(size):
        key = (rng.randrange(3), rng.randrange(3), rng.randrange(2))
        place[key] = place.get(key, -1) + rng.choice([1, 1, 1, 3])
        code = rng.choice([101, 101, 401, 401, 401, 102, 355, 655, 111, 209, 0])
        text = script() if code in (355, 655, 111) else rng.choice(texts)
        route = [(rng.choice([45, 44]), script()) for _ in range(rng.randrange(3))] if rng.random() < 0.8 else None
        rows.append((*key, place[key], code, text, rng.choice([12, 11, None]), rng.choice([None, [], ["yes", "no"], ["Hello", None, "ä"]]), route))
    return rows


def test_texts_of_random_lists(spark, monkeypatch):
    for block in (4096, 3):
        monkeypatch.setattr(ec, "BLOCK", block)
        rows = random_rows(block, 600)
        made = ec.event_texts(spark.createDataFrame(rows, COLUMNS)).collect()
        found = {}
        for r in sorted(made, key=lambda r: (r.map, r.choice, r.event, r.page, r.place, r.nth)):
            found.setdefault(r.map, []).append(r.text)
        assert found == walked(rows)


def test_messages_by_hand(spark):
    rows = [(1, 1, 0, i, code, text, None, None, None) for i, (code, text) in enumerate([(401, ""), (401, "One"), (401, ""), (101, "Two.   Three   four"), (0, None), (101, None), (401, "end  here")])]
    made = ec.messages(spark.createDataFrame(rows, COLUMNS)).orderBy("place").collect()
    assert [(r.place, r.text) for r in made] == [(0, "One "), (3, "Two.  Three four"), (5, "end  here")]
    assert ec.event_texts(spark.createDataFrame([], COLUMNS)).collect() == []


def test_program_literals(spark):
    script = '_INTL("a\\nb\\r\\1\\"q\\"\\\\.") _ISPRINTF( "two")+_INTL (x) _INTL("two")'
    made = ec.program_texts(spark.createDataFrame([(1, script), (2, None)], "k int, text string"), "k").collect()
    assert sorted((r.k, r.src, r.first) for r in made) == [(1, 'a\nb\r\x01"q"\\.', 0), (1, "two", 1)]
