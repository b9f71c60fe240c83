"""Small cases of single operators."""

from pyspark.sql import functions as F

from lexloom.operators import baseline, codes, fields, game, glossary, matching, pairs, qa, ranking, records, routing, rules, trees
from lexloom.sources import text as source
from lexloom.streaming import state


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_lines_collapse_carriage_returns(spark):
    df = spark.createDataFrame([(1, "a\r\r\nb\r\rc\nd"), (2, ""), (3, None)], "file int, text string")
    found = sorted((r.file, r.line_no, r.line) for r in source.lines(df, "file").collect())
    assert found == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "")]
    assert source.lines(df, "file", limit=2).where("file = 1").count() == 2


def test_newline_style(spark):
    styles = [value(spark, source.newline_style(F.lit(x))) for x in ("a\r\nb\nc\rd", "a\nb", "", "a\rb", "a\r\nb\n\nc")]
    assert styles == ["CRLF", "LF", "CRLF", "CRLF", "LF"]


def walk(lines, near=None):
    """The walk over a file: header comments, pairs, special lines and their reasons."""
    import re
    from difflib import SequenceMatcher

    kind = lambda s: "blank" if not s else "block" if re.fullmatch(r"\[[^\]]*\]", s) else "separator" if re.fullmatch(r"#[-=]{3,}", s) else "number" if s.isdigit() else "text"
    bare, out, i, comments = [x.strip() for x in lines], {}, 0, 0
    head = 0
    while head < len(bare) and (not bare[head] or (bare[head].startswith("#") and comments < 4)):
        comments += bare[head].startswith("#")
        head += 1
    while i < len(bare):
        s, after = bare[i], bare[i + 1] if i + 1 < len(bare) else None
        if kind(s) != "text" or (i < head and s.startswith("#")):
            out[i] = ("skipped", None)
            i += 1
            continue
        like = after == s
        if not like and near is not None and after is not None and kind(after) == "text" and min(len(s), len(after)) >= 0.5 * max(len(s), len(after)):
            like = sum(m.size for m in SequenceMatcher(None, s, after, autojunk=False).get_matching_blocks()) / max(len(s), len(after)) >= near
        if like:
            out[i], out[i + 1] = ("source", None), ("target", None)
            i += 2
        else:
            out[i] = ("special", "end" if after is None else "differs" if kind(after) == "text" else kind(after))
            i += 1
    return out


def test_pairs_equal_the_greedy_walk(spark):
    import random

    rng = random.Random(3)
    lines = ["a", "b ", "\ta", "", "#x", "#---", "[map1]", "[S]", "5", "Text one", "Text two", "Text onE"]
    fixture = ["# header comment", "[map1]", "Text A", "Text A", "Lone line", "Text B", "Text B", "Last"]
    files = [["X"] * n for n in range(6)] + [[rng.choice(lines) for _ in range(rng.randrange(30))] for _ in range(60)] + [["#1", "", "#2", "#3", "#4", "#5", "#5"], fixture]
    df = spark.createDataFrame([(f, i, x) for f, v in enumerate(files) for i, x in enumerate(v)], "file int, line_no int, line string")
    for near in (None, 0.8):
        found = {(r.file, r.line_no): (r.role, r.reason) for r in pairs.pair_lines(df, "file", near=near).collect()}
        assert found == {(f, i): role for f, v in enumerate(files) for i, role in walk(v, near).items()}
    assert walk(fixture)[3] == ("target", None) and walk(fixture)[4] == ("special", "differs") and walk(fixture)[7] == ("special", "end")


def test_write_back_prefers_line_numbers_and_keeps_indents(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["  A", "  A", "B", "B", "C"])], "file int, line_no int, line string")
    cache = spark.createDataFrame([("A", "eins"), ("B", "zwei")], "src string, dst string")
    manual = spark.createDataFrame([(1, 3, "hand")], "file int, line_no int, dst string")
    out = pairs.write_back(df, "file", cache, manual)
    assert pairs.assemble(out, "file").first().text == "  A\n  eins\nB\nhand\nC"


def test_line_similarity(spark):
    df = spark.createDataFrame([("abcd", "abcx"), ("a", "abcdef"), (None, "a")], "a string, b string")
    assert [r.v for r in df.select(pairs.line_similarity("a", "b").alias("v")).collect()] == [0.75, 0.0, 0.0]


def test_three_line_records_consume_numbers(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["[m]", "1", "", "2", "3", "4", "x", "y", "5", "z"])], "file int, line_no int, line string")
    assert [(r.id, r.src, r.dst) for r in source.three_line_records(df, "file").orderBy("id").collect()] == [(1, "2", "3"), (4, "x", "y")]


def test_key_values_last_wins(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a = 0", "[S]", "a = 1", "# a = 2", "a=3 "])], "file int, line_no int, line string")
    assert [(r.section, r.name, r.value) for r in source.key_values(df, "file").collect()] == [("S", "a", "3")]


def test_qa_checks(spark):
    df = spark.createDataFrame([(1, 'Hola <b> (a) "b"', 'the @ 3 @ (x)) @@@ " \\foo'), (2, "a", " "), (3, "same", "same"), (4, "((", "(x"), (5, "{x}\\n[a]", "⟦1⟧ n")], "id int, src string, dst string")
    found = {(r.id, r.kind): r.detail for r in qa.findings(df, ["id"], qa.checks(white=["same"])).collect()}
    assert found == {(1, "latin"): "the", (1, "controls"): "\\foo", (1, "placeholder"): "@ 3 @", (1, "at_signs"): "@@@", (1, "punctuation"): '",()', (2, "empty"): "empty", (3, "echo"): "same", (5, "symbols"): "bracket,brace", (5, "placeholder"): "⟦1⟧"}


def test_term_report(spark):
    rows = [("s", "A", 1, ""), ("s", "Bola", 2, " "), ("s", "Bola", 3, "宝可梦"), ("s", " bola", 4, "球"), ("s", "Cola", 5, "Cola"), ("s", "Dola", 6, "Dol 可"), ("s", "Eola", 7, "…!"), ("s", "Fola", 8, "可\\n"), ("s", "Bola", 9, "宝可梦")]
    df = spark.createDataFrame(rows, "section string, src string, ord int, dst string")
    assert sorted((r.ord, r.kind) for r in qa.term_report(df, "section", "src", "ord").collect()) == [(2, "empty"), (4, "inconsistent"), (5, "echo"), (6, "latin"), (7, "symbols"), (8, "latin")]


def test_control_codes(spark):
    one = lambda c: value(spark, c)
    assert one(codes.strip_controls(F.lit("a\\c[1]b<i>\\n\\.{x}&amp;c"))) == "abc"
    assert one(codes.boundaries(F.lit("\\xn[Kao]\\b\\.x\\r"))) == [8, 10, 12]
    assert one(codes.mismatches(F.lit("\\xn[Hate]\\b"), F.lit("\\xn[Other]\\r"))) == ["\\b > \\r"]
    assert one(codes.name_tags(F.lit("\\w[Owen]\\tg[Owen]x"), F.create_map(F.lit("Owen"), F.lit("O")))) == "\\w[Owen]\\tg[O]x"
    assert one(codes.strip_echo(F.lit("ab"), F.lit("x"), F.lit("a"))) == "b"


def test_restoration(spark):
    one = lambda c: value(spark, c)
    # Text, source and what the runs of backslashes become.
    cases = [("x \\\\n y", "a \\n b", "x \\n y"), ("x \\\\c y", "a \\\\n b", "x \\c y"), ("\\\\a \\\\a", "\\a \\\\\\a", "\\a \\a"), ("\\\\q", "\\\\\\q", "\\\\\\q"), ("x", "", "x")]
    for text, like, want in cases:
        assert one(rules.restore_backslashes(F.lit(text), F.lit(like))) == want
    assert one(rules.positional(F.lit("{1}: {2}{9} {1:d}"), F.lit("{2}"), F.lit("b"))) == "{2}: b{9} {1:d}"
    assert one(rules.restore_circled(F.lit("@1@ 1 13"), F.lit("①"))) == "@1@ ① 13"


def test_fields(spark):
    assert fields.split_fields('a , "b,\\"c" ,, d') == ["a", 'b,"c', "", "d"]
    assert fields.split_fields('"a" b') is None and fields.split_fields("") == [""] and fields.split_fields("a,") == ["a", ""]
    df = spark.createDataFrame([(["a", 'b,"c', "d e"],)], "f array<string>")
    line = df.select(F.array_join(F.transform("f", fields.quoted_field), ",").alias("x"))
    assert line.select(fields.lexed("x").alias("f")).first().f == ["a", 'b,"c', "d e"]


def test_growth_curves(spark):
    want = {"medium": 1000000, "erratic": 600000, "fluctuating": 1640000, "parabolic": 1059860, "fast": 800000, "slow": 1250000}
    for curve, points in want.items():
        if curve in ("medium", "fluctuating", "parabolic", "fast", "slow", "erratic"):
            assert value(spark, game.threshold(F.lit(curve), F.lit(100))) == points, curve
    # Points of some levels up to 100.
    known = {"erratic": {2: 15, 10: 1800, 50: 125000, 51: 131324, 68: 257834, 69: 267406, 75: 326531, 98: 583539, 99: 591882}, "fluctuating": {2: 4, 10: 540, 15: 1957, 16: 2457, 35: 42017, 36: 46656, 37: 50653, 54: 185807, 99: 1571884}}
    for curve, levels in known.items():
        for level, points in levels.items():
            assert value(spark, game.threshold(F.lit(curve), F.lit(level))) == points, (curve, level)


def test_files_are_read_and_written_back(spark, tmp_path):
    """Extract, change, write and read again."""
    rows = [("a.txt", i, x) for i, x in enumerate(["[map1]", "Hola", "Hola", "5", "Lone"])] + [("b.txt", 0, "Sol"), ("b.txt", 1, "Sol")]
    lines = spark.createDataFrame(rows, "file string, line_no int, line string")
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\r\n".join(x for f, _, x in rows if f == name), newline="")
    (tmp_path / "old backup").mkdir()
    (tmp_path / "old backup" / "c.txt").write_text("x")
    files = source.read_texts(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "([^/]*)$", 1))
    assert sorted(tuple(r) for r in source.lines(files, "file").collect()) == sorted(rows)
    cache = spark.createDataFrame([("Hola", "你好"), ("Sol", "太阳")], "src string, dst string")
    made = pairs.assemble(pairs.write_back(source.lines(files, "file"), "file", cache), "file", "\r\n")
    assert {r.file: r.text for r in made.collect()} == {"a.txt": "[map1]\r\nHola\r\n你好\r\n5\r\nLone", "b.txt": "Sol\r\n太阳"}
    assert lines.count() == len(rows)


def test_rules_skip_what_does_not_compile(spark):
    chain = [("a(b", "x", True), ("(a)(b)", r"\2$\1", True), ("", "y", False), ("b$a", "z", False)]
    assert value(spark, rules.apply_rules(F.lit("ab ab"), chain)) == "z z"
    assert value(spark, rules.rule_hits(F.lit("ab"), chain)) == 2
    assert value(spark, rules.unescape_value(rules.escape_value(F.lit("a\r\n\tb")))) == "a\r\n\tb"
    assert value(spark, rules.fix_han_spacing(F.lit("中 文 a 中"))) == "中文 a 中"
    assert value(spark, rules.quote_field(F.lit('a"b'))) == '"a""b"'


def test_routing_takes_the_first_route(spark):
    words = ["hit", "#{a}#{b}", "x", r"\n\t", "img/a.png", "123", "known", "new"]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([*words, "new", ""])], "doc_id int, line_no int, src string")
    one = lambda w: spark.createDataFrame([(w,)], "src string")
    found = {r.src: (r.line_no, r.route) for r in routing.route(df, one("hit"), one("known")).collect()}
    kinds = ["cached", "placeholder", "letter", "control", "path", "no_text", "reference", "todo"]
    assert found == {w: (i, k) for i, (w, k) in enumerate(zip(words, kinds))}


def test_glossary_merge_and_diff(spark):
    a = spark.createDataFrame([("Ash ", "x"), ("Bay", "y"), ("Cay", "z")], "src string, dst string")
    b = spark.createDataFrame([("ash", "x x"), ("bay", " y"), ("Dew", "w")], "src string, dst string")
    assert {r.src: r.status for r in glossary.merge_terms(a, b).collect()} == {"Ash ": "conflict", "Bay": "same", "Cay": "kept", "Dew": "added"}
    assert {r.k: r.change for r in glossary.diff_terms(a, b).collect()} == {"ash": "modified", "bay": "modified", "cay": "removed", "dew": "added"}


def test_term_hits_respect_word_boundaries(spark):
    df = spark.createDataFrame([(1, "The Old Rod, old rods"), (2, "éOld Rod"), (3, "Old, Rods")], "id int, text string")
    terms = spark.createDataFrame([("Old Rod", "a"), ("Old", "b"), ("Rod[", "c")], "src string, dst string")
    hits = matching.term_hits(df, terms, ["id"])
    assert sorted((r.id, r.src, r.pos) for r in hits.collect()) == [(1, "Old", 1), (1, "Old Rod", 1), (3, "Old", 0)]
    assert {r.id: r.src for r in matching.first_term(hits, ["id"]).collect()} == {1: "Old Rod", 3: "Old"}
    assert matching.hit_terms(hits.where("id = 1"), terms, ["id"]).first().terms == {"Old": "b", "Old Rod": "a"}


def test_longest_prefix_ends_at_a_boundary(spark):
    df = spark.createDataFrame([(1, "Nurse: hi"), (2, "Nurses"), (3, "Nurse Joy: x"), (4, "Nurse")], "id int, text string")
    known = spark.createDataFrame([("Nurse", "N"), ("Nurse Joy", "NJ")], "prefix string, dst string")
    assert {r.id: r.dst for r in matching.longest_prefix(df, known, ["id"]).collect()} == {1: "N", 3: "NJ", 4: "N"}


def test_decode_codes(spark):
    cases = [("12", "i", 12, None), ("3000000000", "u", 3000000000, None), ("99999999999999999999", "u", None, "invalid"), ("-1", "u", None, "invalid"), ("0", "v", None, "invalid"), ("ff", "x", 255, None), ("1.5", "f", 1.5, None), ("", "i", None, "blank"), ("", "I", None, None), ("maybey", "b", True, None), ("a b", "n", None, "invalid")]
    for text, code, wanted, error in cases:
        got = value(spark, records.decode(F.lit(text), code))
        assert (got.value, got.error) == (wanted, error), (text, code)


def test_range_lookup_and_as_of_agree(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-1, 0, 5, 5, 99, 1000])], "id int, v double")
    steps = spark.createDataFrame([(0.0, 1), (5.0, 2), (50.0, 3)], "low double, level int")
    want = {0: None, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}
    assert {r.id: r.level for r in records.range_lookup(rows, "v", steps, "low", "level").collect()} == want
    assert {r.id: r.level for r in records.as_of(rows, "v", steps, "low", "level", buckets=4).collect()} == want


def test_pairs_within_a_group(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 4)], "team string, id int")
    assert sorted((r.team, r.a, r.b) for r in ranking.pairs_within(df, ["team"], "id").collect()) == [("x", 1, 2), ("x", 1, 3), ("x", 2, 3)]


def test_trees(spark):
    nodes = spark.createDataFrame([(1, None, 1, "a"), (2, 1, 2, None), (3, 2, 1, None), (4, 1, 1, "d")], "id int, parent_id int, ord int, v string")
    order = [r.id for r in trees.walk_down(nodes).orderBy("path").collect()]
    assert order == [1, 4, 2, 3]
    assert {r.id: r.v for r in trees.inherited(nodes, "v").collect()} == {1: "a", 2: "a", 3: "a", 4: "d"}


def test_baseline_compare_and_functions(spark):
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3"), ("s", "d", "4")], "script string, fn string, fp string")
    new = spark.createDataFrame([("s", "a", "1"), ("s", "b", "9"), ("t", "c", "3"), ("t", "e", "5")], "script string, fn string, fp string")
    assert {(r.script, r.fn): r.status for r in baseline.compare(old, new).collect()} == {("s", "a"): "same", ("s", "b"): "changed", ("s", "c"): "moved", ("s", "d"): "missing", ("t", "c"): "added", ("t", "e"): "added"}
    files = spark.createDataFrame([("s", "def a\n  x\nend\nclass B\n  def b\n    # note\n    y  \n  end\nend")], "script string, text string")
    same = spark.createDataFrame([("s", "class B\n  def b\n    y\n  end\nend\ndef a\n  x\nend")], "script string, text string")
    assert {r.fn: r.fp for r in baseline.scan_functions(files).collect()} == {r.fn: r.fp for r in baseline.scan_functions(same).collect()}


def test_glicko_example(spark):
    """The worked example of the published description."""
    rows = [(1, 1500.0, 200.0, 0.06, 1400.0, 30.0, 1.0), (1, 1500.0, 200.0, 0.06, 1550.0, 100.0, 0.0), (1, 1500.0, 200.0, 0.06, 1700.0, 300.0, 0.0)]
    df = spark.createDataFrame(rows, "player long, rating double, deviation double, volatility double, opponent_rating double, opponent_deviation double, score double")
    r = ranking.glicko_update(df).first()
    assert abs(r.rating - 1464.06) < 0.1 and abs(r.deviation - 151.52) < 0.1 and abs(r.volatility - 0.05999) < 1e-4


def test_staged_edit_order(spark):
    t = lambda rows, cols="src string, dst string": spark.createDataFrame(rows, cols)
    out = glossary.staged_edit(t([("a", "1"), ("b", "2"), ("c", "3")]), t([("a",)], "src string"), t([("b", "a"), ("c", "b")], "src string, to string"), t([("a", "9")]), t([("a", "0"), ("z", "5")]))
    assert {r.src: (r.dst, r.origin) for r in out.collect()} == {"a": ("9", "changed"), "c": ("3", "kept"), "z": ("5", "added")}


def test_stream_state_survives_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i * 10 + j, j % 2, 1.0) for j in range(10)], "event_id long, k long, v double").coalesce(1).write.parquet(str(tmp_path / "t"), mode="append")
    stream = state.event_stream(spark, str(tmp_path / "t"))
    made = state.latest(state.run_to_end(state.step_counter(stream, "k", "v", steps=4), "steps", "update"), "k", "events")
    assert {(r.k, r.events, r.fired) for r in made.collect()} == {(0, 15, 3), (1, 15, 3)}


def test_near_echo_reads_whole_texts(spark):
    """Pairs that agree for 400 characters and differ later, and the other way round."""
    import random
    from difflib import SequenceMatcher

    from lexloom.plans import corpus

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    head, tails = text(450), (text(3000), text(3000))
    rows = [(1, head + tails[0], head + tails[1]), (2, text(450) + tails[0], text(450) + tails[0] * 2), (3, text(100) + tails[0], text(100) + tails[0]), (4, "x" * 7, "x" * 7), (5, None, head)]
    talk = [(i, k, x) for i, *both in rows for k, x in enumerate(both)]
    tables = {"conversations": spark.createDataFrame(talk, "conv_id int, turn int, text string")}
    plan = getattr(corpus.near_echo, "__wrapped__", corpus.near_echo)
    assert {r.conv_id: r.echo for r in plan(tables.get).where("turn = 0").collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
        b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choice("abc") for _ in range(rng.randrange(4)))
        own = SequenceMatcher(None, a, b, autojunk=False)
        block = own.find_longest_match(0, len(a), 0, len(b))
        assert qa._longest_block(a, b)[2] == block.size and (not block.size or qa._longest_block(a, b) == tuple(block))
        assert all(qa.ratio_at_least(a, b, x) == (own.ratio() >= x) for x in (0.5, 0.8, 0.92, own.ratio()))


def test_long_prefixes_and_terms(spark):
    """Known prefixes of more than 64 characters, terms of more than four words."""
    long = "Nurse " + "y" * 100
    df = spark.createDataFrame([(1, long + ": hi"), (2, "Nurse: one two three four five six")], "id int, text string")
    known = spark.createDataFrame([("Nurse", "N"), (long, "long")], "prefix string, dst string")
    assert {r.id: r.dst for r in matching.longest_prefix(df, known, ["id"]).collect()} == {1: "long", 2: "N"}
    assert matching.longest_prefix(df, known.limit(0), ["id"]).isEmpty()
    terms = spark.createDataFrame([("two three four five six", "a"), ("three", "b")], "src string, dst string")
    assert sorted((r.id, r.src, r.pos) for r in matching.term_hits(df, terms, ["id"]).collect()) == [(2, "three", 3), (2, "two three four five six", 2)]
