"""Boxes against a walk, lists against turns in Python, on random rows."""

import random

from lexloom.operators import storage


def test_boxes_against_a_walk(spark):
    rng = random.Random(11)
    boxes = [(o, b, rng.choice([None, 0, 1, 2, 6]), b == o % 3) for o in range(6) for b in range(5)] + [(7, 0, 3, None), (7, 1, 2, None)]
    taken = [(o, b, s) for o in range(6) for b in range(6) for s in range(7) if rng.random() < 0.3] * 2
    arrivals = [(rng.choice([None, 7, 8, *range(6)]), i) for i in range(120)]
    full = set(taken)
    current = {o: o % 3 for o in range(6)}
    wanted = {}
    for owner, i in arrivals:
        wanted[i] = (None, None)
        own = {b: size or 0 for o, b, size, _ in boxes if o == owner}
        for b in [b for b in [current.get(owner)] if b is not None] + sorted(own):
            slot = next((s for s in range(own[b]) if (owner, b, s) not in full), None)
            if slot is not None:
                full.add((owner, b, slot))
                current[owner], wanted[i] = b, (b, slot)
                break
    rng.shuffle(arrivals)
    tables = [spark.createDataFrame(boxes, "o int, box int, size int, current boolean"), spark.createDataFrame(taken, "o int, box int, slot int")]
    put = storage.stored(spark.createDataFrame(arrivals, "o int, i int"), *tables, "o", ["i"])
    assert {r.i: (r.box, r.slot) for r in put.collect()} == wanted
    assert {r.o: r.box for r in storage.current_boxes(put, tables[0], "o", ["i"]).collect()} == {o: current.get(o) for o in [*range(6), 7]}
    assert storage.stored(put.select("o", "i").limit(0), *tables, "o", ["i"]).collect() == []
    assert all(r.box is None for r in storage.stored(put.select("o", "i"), tables[0].limit(0), tables[1], "o", ["i"]).collect())


def strikes(a, b):
    kind_a, power_a, accuracy_a, code_a, uses_a = a
    kind_b, power_b, accuracy_b, code_b, uses_b = b
    if accuracy_a == 0 and code_b == "None" and kind_a == kind_b and power_a >= power_b:
        return True
    if code_a == "BadPoisonTarget" and code_b == "PoisonTarget":
        return True
    if code_a != code_b:
        return False
    if power_a == 0 == power_b:
        return accuracy_a > accuracy_b
    return power_a != 0 and kind_a == kind_b and (uses_a in (10, 15) or uses_a == uses_b) and (power_a, accuracy_a) > (power_b, accuracy_b)


def test_lists_against_turns(spark):
    rng = random.Random(12)
    move = lambda: (rng.choice("uv"), rng.choice([0, 20, 40]), rng.choice([0, 50, 100]), rng.choice(["None", "PoisonTarget", "BadPoisonTarget", "Flinch"]), rng.choice([5, 10, 15, 20]))
    rows, wanted = [], []
    for g in (None, *range(150)):
        own = [(i, move()) for i in range(rng.randrange(1, 13))]
        rows += [(g, i, *m) for i, m in own]
        at = 0
        while at < len(own):
            entry = own[at][1]
            own = [x for x in own if not strikes(entry, x[1])]
            at += 1
        wanted += [(g, i) for i, _ in own]
    schema = "g int, i int, type string, power int, accuracy int, function string, pp int"
    df = spark.createDataFrame(rows, schema).repartition(5)
    made = storage.move_lists(df, ["g"], ["i"]).select("g", "i").collect()
    assert sorted(repr(tuple(r)) for r in made) == sorted(map(repr, wanted))
    assert len(wanted) < len(rows)
    blank = spark.createDataFrame([(1, 0, None, None, None, None, None), (1, 1, "u", 20, 0, "None", 5)], schema)
    assert [r.i for r in storage.move_lists(blank, ["g"], ["i"]).collect()] == [0]  # the second never misses and strikes out itself
    assert storage.move_lists(df.limit(0), ["g"], ["i"]).collect() == []
