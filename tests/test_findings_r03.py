"""One test for each finding of the third review."""

import math
import random

import duckdb
import pandas as pd
from test_queries import rows

from lexloom.operators import ranking
from lexloom.plans.catalog import ORACLE_SQL, QUERIES


def against_sql(spark, name, folder, **tables):
    """The query's rows and those of its SQL over small tables (rows, schema) of its own."""
    con = duckdb.connect()
    for table, (content, schema) in tables.items():
        spark.createDataFrame(content, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    made, wanted = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert rows(made) == rows(wanted)
    return made


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f1_pools_equal_listed_matches_and_list_none(spark, tmp_path):
    rng = random.Random(1)
    players = [(i, i % 3, 1500.0 + rng.randrange(-9, 9) * 20, 200.0, 0.06) for i in range(60)] + [(99, 7, 1500.0, 200.0, 0.06)]
    others = [(i % 3, 1500.0 + rng.randrange(-9, 9) * 25, 80.0, float(i % 2)) for i in range(90)] + [(None, 1500.0, 80.0, 1.0)]
    p = spark.createDataFrame(players, "player long, g int, rating double, deviation double, volatility double")
    o = spark.createDataFrame(others, "g int, opponent_rating double, opponent_deviation double, score double")
    wanted = {r.player: r for r in ranking.glicko_update(p.join(o, "g")).collect()}
    made = ranking.glicko_pools(p, o, ["g"], block=7).collect()
    assert len(made) == len(wanted) == 60
    for r in made:
        assert all(math.isclose(r[c], wanted[r.player][c], rel_tol=1e-9) for c in ("rating", "deviation", "volatility"))
    # The query has no step with a row for each match.
    spark.createDataFrame([(1, 1, 100.0)] * 3, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, 100.0)] * 3, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    made = QUERIES["glicko_ratings"](spark, str(tmp_path))
    assert made.count() == 3 and "own_" in plan_of(made)


def test_f2_texts_with_sections_and_names_of_their_own(spark, tmp_path):
    texts = ["password = 'x'", "[NAMES]\nLang = no\nother = 1", "", None, "plain\r\n[a]\nb=c\r"]
    content = [(i, x, "en", "web") for i, x in enumerate(texts)] + [(10, "a", None, "s"), (11, "a", "de", None), (12, "k = v", "", "")]
    assert len(against_sql(spark, "keyed_sections", tmp_path, documents=(content, "doc_id long, text string, lang string, source string"))) == 16


def test_f5_pairs_are_listed_once_by_classes(spark, tmp_path):
    content = [(i, i % 2) for i in range(60)]
    made = against_sql(spark, "compatible_pairs", tmp_path, supplier=(content, "s_suppkey long, s_nationkey int"))
    plan = plan_of(QUERIES["compatible_pairs"](spark, str(tmp_path)))
    # What is made distinct are classes; nothing is aggregated or exploded above the members.
    assert not len(made) and "Generate" not in plan and not plan.startswith("Aggregate")
    (tmp_path / "odd").mkdir()
    odd = [(i, i % 3) for i in range(80)] + [(200, None), (201, None)]
    assert len(against_sql(spark, "compatible_pairs", tmp_path / "odd", supplier=(odd, "s_suppkey long, s_nationkey int")))


def test_f8_parts_meet_nations_and_not_each_supplier(spark, tmp_path):
    parts = [(i, f"B{i % 3}", float(i * 7 % 5)) for i in range(1, 700)] + [(900, None, 1.0), (901, "B1", None)]
    against_sql(spark, "undominated", tmp_path, part=(parts, "p_partkey long, p_brand string, p_retailprice double"), supplier=([(i, i % 4) for i in range(1, 350)], "s_suppkey long, s_nationkey int"))
    plan = plan_of(QUERIES["undominated"](spark, str(tmp_path)))
    assert plan.count("Join") and all("p_partkey" not in x or "% 100" not in x for x in plan.splitlines() if "Join" in x)


def test_f6_generations_of_very_many_resets(spark, tmp_path):
    from lexloom.streaming import state

    rng = random.Random(6)
    content = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["reset", "reset", "a", "b", None])) for i in range(600)] + [(5, 1, "a"), (5, 1, "reset"), (5, None, "reset")]
    for part in range(3):
        spark.createDataFrame(content[part * 201 : part * 201 + 201], "at long, u long, m string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    made = state.log_counts(state.event_stream(spark, f"{tmp_path}/log", files=9), "u", "m", "at", "reset", "many").collect()
    wanted = {}
    for at, u, m in content:
        if m not in (None, "reset"):
            marks = sum(k == "reset" and a < at and (v is None or v == u) for a, v, k in content)
            first, n = wanted.get((u, marks, m), (at, 0))
            wanted[u, marks, m] = min(first, at), n + 1
    assert {(r.u, r.generation, r.m): (r["first"], r.n) for r in made} == wanted


def test_f7_f9_f11_f14_runs_are_cut_down_before_the_join(spark):
    from lexloom.operators import matching

    texts = spark.createDataFrame([(i, "one two, three " * 50 + f"needle {i}.") for i in range(20)], "id int, text string")
    terms = spark.createDataFrame([("needle 7",), ("needle 7.",), ("one three",)] + [(" ".join(["w"] * n),) for n in range(1, 90)], "src string")
    hits = matching.term_hits(texts, terms, ["id"])
    assert sorted((r.id, r.src, r.at) for r in hits.collect()) == [(7, "needle 7", 350), (7, "needle 7.", 350)]
    assert "xxhash64" not in plan_of(hits) and "Generate" not in plan_of(hits)


def test_f12_records_of_a_file_are_never_one_array(spark):
    from lexloom.sources import text as source

    rng = random.Random(12)
    files = {i: rng.choices(["1", " 22 ", "x", "", "# c", "[b]"], k=120) for i in range(30)} | {99: ["7"] * 4000, 100: []}
    df = spark.createDataFrame([(f, i, x) for f, v in files.items() for i, x in enumerate(v)], "file int, line_no int, line string")
    wanted = set()
    for f, v in files.items():
        own = [x.strip() for x in v if x.strip() and x[0] not in "#["]
        i = 0
        while i + 2 < len(own):
            if own[i].isdigit():
                wanted.add((f, i, int(own[i]), own[i + 1], own[i + 2]))
                i += 3
            else:
                i += 1
    made = source.three_line_records(df, "file")
    assert sorted((r.file, r.id, r.src, r.dst) for r in made.collect()) == sorted((f, *x) for f, _, *x in wanted)
    # Arrays are gathered for runs of near number lines, not for files.
    assert "run_" in plan_of(made)


def test_f15_sizes_beside_circles_take_one_climb(spark, monkeypatch):
    from lexloom.operators import trees

    nodes = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 1, 1), (4, 3, 0), (10, 11, 0), (11, 10, 0), (12, 10, 0)], "id long, parent_id long, ord int")
    steps, old = [], trees.written
    monkeypatch.setattr(trees, "written", lambda df, name: steps.append(name) or old(df, name))
    assert {r.id: r["size"] for r in trees.subtree_sizes(nodes).collect()} == {1: 4, 2: 1, 3: 2, 4: 1}
    assert "climb" not in steps
    assert {r.id: (r.depth, r.place) for r in trees.preorder(nodes).collect()} == {1: (0, 0), 2: (1, 1), 3: (1, 2), 4: (2, 3)}


def test_f10_f13_fields_are_written_into_the_plan_once(spark):
    from pyspark.sql import functions as F

    from lexloom.operators import schemas

    key = schemas.compiled({"K": ("*uvE", "Kind")})[0]
    made = spark.range(1).select(schemas.read_value(key, F.concat(F.lit("1,2,a, x ,0,"), F.col("id")), {"Kind": {"a": 10}}).alias("r"))
    # The fields are cut out of a value once, and an error is told from the value that was read.
    assert plan_of(made).count("regexp_extract_all(") == 1
    r = made.first().r
    assert [tuple(x) for x in r.value] == [(1, 2, 10), (None, None, None)] and r.errors == ["K.0:0 or greater", "K.1:greater than 0"]


def test_f4_likeness_is_decided_without_walking_all_blocks():
    from difflib import SequenceMatcher

    from lexloom.operators import pairs

    rng = random.Random(4)
    for near in (0.5, 0.8, 1.0):
        for _ in range(600):
            x = "".join(rng.choices("abc d", k=rng.randrange(0, 30)))
            y = "".join(c for c in x if rng.random() > 0.12) + "".join(rng.choices("abc", k=rng.randrange(0, 4)))
            most = max(len(x), len(y))
            own = 0.0 if not x or not y or min(len(x), len(y)) < 0.5 * most else sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / most
            assert pairs.alike(x, y, near) == (own >= near)
    assert not pairs.alike(None, "a", 0.8) and not pairs.alike("", "", 0.8)
    # Two unlike lines of 100,000 characters: all their blocks would take hours.
    x, y = ("".join(rng.choices("abcdefgh", k=100_000)) for _ in range(2))
    assert not pairs.alike(x, y, 0.8)


def test_op7_look_ups_read_few_entries_and_only_whole_pairs(spark, monkeypatch):
    import public_tokenizers

    from lexloom.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    strings = spark.range(1).select(bpe.rank_map(ranks).alias("m")).first().m
    entries = [x.split(bpe.NONE)[1:-1] for x in strings]
    lengths = [len(x) for x in entries]
    assert sum(n * n for n in lengths) < 3 * sum(lengths)  # read by the mean look-up that finds something
    # Few strings, where a pair's tail with its rank could meet a look-up of the same two characters.
    monkeypatch.setattr(bpe, "RANK_CLASSES", 1)
    small = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"abcd": 259, b"cd": 260}
    small_map = spark.range(1).select(bpe.rank_map(small).alias("m")).first().m
    for at, x in enumerate(small_map):
        for entry in x.split(bpe.NONE)[1:-1]:
            own, *others = (bpe.spark_hash(y.encode()) % len(small_map) for y in (entry[:2], entry[1:], bpe.NONE + entry[0], entry[2] + bpe.NONE))
            assert own == at and at not in others
    made = bpe.encode(spark.createDataFrame([("abcd abdcd cdab",)], "text string"), small, r"\S+|\s+").first().ids
    assert made == [259, 32, 256, 100, 260, 32, 260, 256]
