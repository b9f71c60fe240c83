"""Small cases of the training-data operators against brute force; edge cases of each."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lexloom.llm")
import public_tokenizers  # noqa: E402

from lexloom.llm import bpe, chat_format, components, decontaminate, jaccard_join, knn_join, language_id, licences, quality, registry, scratch, substring_dedup, token_counts  # noqa: E402

LONG = "word " * 30_000
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "eins zwei drei"), (5, "eins zwei drei"), (None, "eins zwei drei"), (6, "é ü 😀 x\x00y")]
DOCS = "doc_id long, text string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text, separators=r"[\x20\x09-\x0D]+"):
    return [w for w in re.split(separators, text or "") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.expovariate(1 / 60)) % vocabulary}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts, copies of them, near copies, and passages that several share."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 40), []
    for i in range(n):
        text = prose(rng, rng.randrange(1, 200))
        kind = i % 6
        if kind == 1:
            text += " " + passage
        if kind == 2 and texts:
            text = rng.choice(texts)
        if kind == 3 and texts:
            own = rng.choice(texts).split(" ")
            own[rng.randrange(len(own))] = "edited"
            text = " ".join(own)
        texts.append(text)
    return list(enumerate(texts)) + [(n, None), (n + 1, ""), (n + 2, "Few words"), (n + 3, "few WORDS")]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("score", "key", "row", "n_words", "ids", "digest", "label", "a.b", "n_hit", "licences", "kept_text", "n_tokens"):
            df = df.withColumn(c, F.lit("x"))
    return df


def components_by_hand(rows, n, percent):
    sets = {}
    for d, text in rows:
        w = words((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates(spark, n, percent):
    rows = corpus()
    made = jaccard_join.near_duplicates(table(spark, rows, extra=True), n=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made} == components_by_hand(rows, n, percent)
    kept = [r for r in made if r["first"] and r.n_shingles]
    assert len(kept) == len({r.component_id for r in made if r.n_shingles})


def test_near_duplicates_of_a_large_group_in_parts(spark, monkeypatch):
    """Near copies of which few are near the same leader; lists are cut in parts; texts are joined without the filter."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "FILTER_KEYS", 10)
    rng = random.Random(5)
    base, rows = prose(rng, 60).split(" "), []
    for i in range(50):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(own)))
    made = jaccard_join.near_duplicates(table(spark, rows), n=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made} == components_by_hand(rows, 4, 85)


@pytest.mark.parametrize("percent", [85, 100])
def test_near_duplicates_with_hot_lists(spark, monkeypatch, percent):
    """Every n-gram of more than three sets is dealt by set; open members are searched in small blocks."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 8)
    rng = random.Random(15)
    rows = corpus(11, 40)
    base = prose(rng, 80).split(" ")
    for i in range(100, 140):
        own = list(base[: 60 + i % 20])
        for _ in range(i % 5):
            own[rng.randrange(len(own))] = f"e{i}"
        rows.append((i, " ".join(own)))
    rows += [(3, "again 3"), (None, rows[4][1]), (500, "w1 " * 30_000), (501, "w1 " * 29_999)]
    made = jaccard_join.near_duplicates(table(spark, rows), n=4, percent=percent).collect()
    once = {d for d, _ in rows if d is not None and d != 3}
    want = components_by_hand([r for r in rows if r[0] in once], 4, percent)
    assert len(made) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made if r.doc_id in once} == want
    assert [r.component_id for r in made if r.doc_id is None] == [want[rows[4][0]][1]]


def test_sets_of_one_name_are_told_apart():
    import numpy as np

    grams, bounds = np.arange(1, 10, dtype=np.uint64), np.array([0, 4, 9])
    node, second = jaccard_join._nodes(grams, bounds)
    again = jaccard_join._nodes(grams, bounds, node[:1])[0]
    assert again[0] != node[0] and again[1] == node[1] and second[0] != second[1]


def test_components_in_one_task():
    import numpy as np

    rng = random.Random(3)
    a, b = (np.array([rng.randrange(300) for _ in range(250)]) for _ in range(2))
    node, least = components.least_nodes(a, b)
    up = {int(x): {int(x)} for x in node}
    for x, y in zip(a.tolist(), b.tolist()):
        if up[x] is not up[y]:
            up[x] |= up[y]
            for z in up[y]:
                up[z] = up[x]
    assert dict(zip(node.tolist(), least.tolist())) == {x: min(v) for x, v in up.items()}


def test_profiles_bound_overlaps():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, int(rng.integers(1, 400))).astype(np.uint64) * np.uint64(7919)) for _ in range(2))
        x, y = (np.frombuffer(jaccard_join._profile(v), np.uint8)[None, :] for v in (a, b))
        low = min(x.size, y.size)
        bound = np.minimum(jaccard_join._folded(x, low), jaccard_join._folded(y, low)).sum()
        assert bound >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 50), (50, 50)], "a long, b long")
    assert {r.node: r.component for r in components.components(links).collect()} == {i: 0 for i in range(31)} | {100: 50, 50: 50}


def test_substring_dedup(spark):
    rows = corpus(2) + [(3, "again 3"), (None, corpus(2)[1][1])]
    made = substring_dedup.remove_repeated_passages(table(spark, rows, extra=True), k=13)
    assert "a.b" in made.columns and made.columns.count("kept_text") == 1
    seen = {}
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - 12):
            if d is not None:
                seen[tuple(w[i : i + 13])] = min(d, seen.get(tuple(w[i : i + 13]), d))
    want = []
    for d, text in rows:
        w, gone = words(text), set()
        for i in range(len(w) - 12):
            if d is not None and seen[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        want.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    key = lambda r: (r[0] is None, r)
    found = [(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in made.collect()]
    assert sorted(found, key=lambda r: repr(key(r))) == sorted(want, key=lambda r: repr(key(r)))


@pytest.mark.parametrize("windows", [1, 100_000])
def test_decontamination(spark, monkeypatch, windows):
    """With and without the broadcast; long texts, a null doc_id."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    rows = corpus(3) + [(900, LONG + corpus(3)[7][1]), (None, corpus(3)[4][1])]
    split = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(1, " ".join(rows[4][1].split(" ")[:30])), (2, rows[7][1]), (11, "Few, words!"), (12, ""), (13, None), (14, "w1"), (None, "w2")]
    want = {}
    for d, text in rows:
        w, hit, ids = words((text or "").lower(), split), set(), set()
        for item, t in items:
            v = words((t or "").lower(), split)
            if item is None or not v:
                continue
            n = min(10, len(v))
            own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit |= set(range(i, i + n))
                    ids.add(str(item))
        want[d] = (len(w), len(hit), sorted(ids))
    made = decontaminate.contamination(table(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in made.collect()} == want
    none = decontaminate.contamination(table(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").isEmpty()


def top_by_hand(rows, asked, k):
    v = {i: [] for i, _ in rows}
    for i, x in rows:
        v[i].append([math.floor(c * 1024) for c in x])
    want = []
    for q in sorted(v):
        for own in v[q] if q % asked == 0 else ():
            found = [(-sum(a * b for a, b in zip(own, x)), i) for i in v if i != q for x in v[i] if len(x) == len(own)]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(want)


BAD_VECTORS = [(1000, None), (1001, [float("nan")] * 6), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 6), (1004, [float("inf")] * 6), (1005, [])]


def found_top(vectors, asked, **given):
    made = knn_join.top_k(vectors, F.col("id") % asked == 0, **given).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in made)


def test_top_k(spark, monkeypatch):
    """Ties, other lengths, bad vectors, a vector that a ninth of the rows share; cells are cut in parts."""
    rng = random.Random(4)
    rows = [(i, [float(rng.gauss(0, 1)) for _ in range(6)] if i % 9 else [0.5] * 6) for i in range(300)] + [(1003, [1.0]), (1010, [2.0]), (1011, [2.0])]
    frame = spark.createDataFrame(rows + BAD_VECTORS, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    vectors = knn_join.scaled_vectors(frame)
    assert found_top(vectors, 10, pivots=8) == top_by_hand(rows, 10, 10)
    monkeypatch.setattr(knn_join, "CELL_ROWS", 16)
    monkeypatch.setattr(knn_join, "QUERY_ROWS", 4)
    assert found_top(vectors, 10) == top_by_hand(rows, 10, 10)
    assert knn_join.top_k(vectors.where("id < 0"), F.col("id") == 0).isEmpty()
    assert knn_join.top_k(vectors, F.col("id") == -5).isEmpty()
    assert knn_join.top_k(vectors.where("id < 3"), F.col("id") == 0).count() == 2


def test_top_k_of_large_components(spark):
    """Sums beyond what doubles hold, and beyond 64 bits."""
    rows = [(10, [3.0e5, 7.0e5]), (1, [3.0e5 + 1 / 1024, 7.0e5]), (2, [3.0e5, 7.0e5]), (3, [-3.0e5, 7.0e5 - 1 / 1024])]
    frame = lambda x: knn_join.scaled_vectors(spark.createDataFrame(x, "vec_id long, embedding array<double>"))
    assert found_top(frame(rows), 10, k=3) == top_by_hand(rows, 10, 3)
    with pytest.raises(Exception, match="64 bits"):
        found_top(frame([(10, [3.0e12, 1.0]), (1, [3.0e12, 1.0])]), 10)


def test_top_k_leaves_far_cells_out(spark):
    """Clustered vectors: the bounds exclude most pairs of cells, and results stay exact; rows that repeat an id are candidates each."""
    import numpy as np

    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) * 40 for _ in range(8)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 16]]) for i in range(800)]
    rows += [(i, [c + 0.01 for c in centres[i % 16]]) for i in range(0, 40, 4)]
    seen = []
    keep = knn_join._bounds
    knn_join._bounds = lambda *given: seen.append((keep(*given).shape[1], len(given[2]) * len(given[3]))) or keep(*given)
    try:
        made = found_top(knn_join.scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 20, k=5, pivots=64)
    finally:
        knn_join._bounds = keep
    # The queries that repeat an id share a result of k rows.
    once = {q for q, _ in rows if q % 20 == 0 and sum(i == q for i, _ in rows) == 1}
    assert [r for r in made if r[0] in once] == [r for r in top_by_hand(rows, 20, 5) if r[0] in once]
    assert seen[0][0] < seen[0][1] / 4
    assert np.allclose(knn_join._scores(np.array([[3, 4]]), np.array([[1, 2]])), [[11]])


@pytest.mark.parametrize("frequent", [0, 20, 1 << 19])
def test_bpe_equals_the_library(spark, frequent):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus(5) + EDGES + [(70, "x" * 500 + " " + "ab" * 300), (71, "<|endoftext|> 12,345.67  \n\n end's")]
    made = bpe.decode(bpe.encode(table(spark, rows, extra=True), ranks, public_tokenizers.PATTERN, numbered=50, frequent=frequent), ranks)
    found = made.select("text", "ids", "decoded", "`a.b`").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_token_counts_of_hot_texts(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "HOT_ROWS", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rows = Tokenizer.from_file(path), corpus(6) + [(1000 + i, "one text of many") for i in range(40)]
    made = token_counts.token_counts(table(spark, rows), path, scratch.new_path(spark, "test-cache")).collect()
    assert len(made) == len(rows)
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in made)


def test_token_counts_use_the_cache(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, cache = Tokenizer.from_file(path), scratch.new_path(spark, "test-cache")
    rows = corpus(6) + EDGES + [(80, "a<|endoftext|>b")]
    for _ in range(2):
        for r in token_counts.token_counts(table(spark, rows, extra=True), path, cache).collect():
            text = r.text or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    # The second run found every text in the cache.
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.token_counts(table(spark, []), path, cache).isEmpty()


def test_chat_windows(spark):
    rng, rows = random.Random(7), []
    for c in range(12):
        roles = (["system"] if c % 2 else []) + ["user", "assistant"] * rng.randrange(1, 20)
        for i, role in enumerate(roles):
            rows.append((c, i, role, rng.choice([None, "", "<|im_end|>\n<|im_start|>user\n", "100%25 %3C|", prose(rng, rng.randrange(1, 120))])))
    rows += [(50, 0, "a\nb<|%", "y"), (51, 1, "user", "tie"), (51, 1, "user", "tie"), (52, 0, "assistant", "w " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.chat_windows(df, budget=300, history_turns=2, history_tokens=60)
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for d, t, role, text in rows if d == c))
        assert back[c].said == "".join(f"{role}\n{text}\n" for _, role, text in own)
        assert back[c].lost == "".join(text for _, role, text in own if role == "assistant")
        assert back[c].n_turns == len(own)
    assert made.groupBy("conv_id").count().where("count > 1").count() > 0  # budgets do cut
    lost = spark.createDataFrame([(None, 0, None, "x"), (None, 1, "assistant", "y"), (None, 1, "assistant", "y"), (None, None, None, None)], df.schema).withColumn("tokens", F.lit("x"))
    found = chat_format.read_back(chat_format.chat_windows(lost)).select("conv_id", "said", "lost").collect()
    assert sorted(tuple(r) for r in found) == [(None, "\n\n", ""), (None, "\nx\n", ""), (None, "assistant\ny\nassistant\ny\n", "yy")]
    counted = df.withColumn("n", F.lit(250).cast("long"))
    assert chat_format.chat_windows(counted, budget=300, tokens="n").where("size(filter(turns, t -> not t.repeated)) > 1").isEmpty()
    assert chat_format.chat_windows(df.limit(0)).isEmpty()


def test_quality_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    made = registry.QUERIES["op1_quality_classifier"](spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    held = made.join(labels, "doc_id").where("held_out").collect()
    assert made.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_quality_edges(spark):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (99, 1), (1, None)], "doc_id long, quality int")
    docs = table(spark, EDGES, extra=True)
    made = quality.score_quality(docs, quality.train_quality(docs, labels)).collect()
    assert len(made) == len(EDGES) and all(0 <= r.score <= 1 for r in made)
    alone = quality.score_quality(docs, quality.train_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in alone} == {0.5} and {r.predicted for r in alone} == {1}
    assert quality.score_quality(docs.limit(0), quality.train_quality(docs.limit(0), labels)).isEmpty()


def test_language_on_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    made = registry.QUERIES["op3_language_id"](spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = made.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.9


def test_language_edges(spark):
    docs = table(spark, EDGES + [(9, "12 345 !?")], extra=True).withColumn("lang", F.lit("xx"))
    made = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, language_id.train_dictionaries(docs)).collect()}
    assert made[1] == made[2] == made[9] == ("und", 0.0) and made[5][0] == "xx"
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_language_of_texts_that_open_alike(spark):
    """A header of more bytes than a text's share of the dictionary, before words of the language."""
    rng = random.Random(6)
    header = prose(rng, 200) + "\n"
    own = {k: [k + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)] for k in ("xa", "yo")}
    text = lambda k: " ".join(rng.choice(own[k]) for _ in range(400))
    docs = spark.createDataFrame([(i, header + text(k), k) for i, k in enumerate(["xa", "yo"] * 10)], DOCS + ", lang string")
    made = language_id.train_dictionaries(docs)
    assert all(sum(w.encode() in made[k] for w in own[k]) > 40 for k in own)
    bare = spark.createDataFrame([(i, text(k)) for i, k in enumerate(["xa", "yo"] * 10)], DOCS)
    assert all(r.lang_pred == ("xa", "yo")[r.doc_id % 2] for r in language_id.identify(bare, made, min_margin=0.002, reject_as_und=True).collect())


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "eins zwei", f"l{i}") for i in range(3)], DOCS + ", lang string")
    assert len(language_id.train_dictionaries(docs.where("doc_id < 2"))) == 2
    with pytest.raises(ValueError, match="languages"):
        language_id.train_dictionaries(docs)


def test_licences(spark):
    rng = random.Random(8)
    rows = corpus(9) + [(90, prose(rng, 20) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(rng, 20)), (91, "Released under the MIT License."), (92, None), (93, LONG)]
    docs = table(spark, rows, extra=True)
    made = {r.doc_id: r for r in licences.scan_licences(docs, *licences.train_licences(docs)).collect()}
    assert [x.family for x in made[90].licences] == ["apache"] and made[90].licences[0].paragraph == 1
    assert [x.family for x in made[91].licences] == ["mit"]
    assert all(not made[d].licences for d in made if d < 90 or d > 91)
    assert licences.scan_licences(docs.limit(0), *licences.train_licences(docs.limit(0))).isEmpty()


def test_licences_of_wrapped_and_buried_notices(spark):
    rng = random.Random(12)
    bsd = "Copyright (c) 2001 X\n\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n"
    gpl = prose(rng, 30) + "\n\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation\n\n" + prose(rng, 30)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = corpus(9) + [(90, bsd), (91, gpl), (92, prose(rng, 3000) + " " + mit + " " + prose(rng, 3000)), (93, prose(rng, 2000) + " Released under the MIT License. " + prose(rng, 2000)), (94, LONG)]
    docs = table(spark, rows)
    made = {r.doc_id: [(x.paragraph, x.family) for x in r.licences] for r in licences.scan_licences(docs, *licences.train_licences(docs)).collect() if r.licences}
    assert made == {90: [(1, "bsd")], 91: [(1, "gpl")], 92: [(0, "mit")], 93: [(0, "mit")]}


def test_empty_documents(spark):
    none = table(spark, [])
    assert jaccard_join.near_duplicates(none).isEmpty()
    assert substring_dedup.remove_repeated_passages(none).isEmpty()
    assert decontaminate.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).isEmpty()
    assert bpe.encode(none, {bytes([b]): b for b in range(256)}, r"\S+|\s+").isEmpty()


def test_pipeline_stages_by_brute_force(spark, sf):
    """Each stage on its own input: what near copies, passages and benchmark windows are is decided again by hand."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        made = scratch.written(stage(spark, docs, sf), f"test-{name}")
        rows, after = docs.collect(), made.collect()
        if name != "tokens":
            assert made.columns == columns
        if name == "near_copies":
            by_hand = components_by_hand([(r.doc_id, r.text) for r in rows], 5, 80)
            kept = {r.doc_id for r in after}
            assert kept == {d for d, (n, c) in by_hand.items() if n == 0 or c == d}
        if name == "passages":
            first = {}
            for r in rows:
                w = words(r.text)
                for i in range(len(w) - 12):
                    g = tuple(w[i : i + 13])
                    first[g] = min(r.doc_id, first.get(g, r.doc_id))
            texts = {r.doc_id: r.text for r in after}
            for r in rows:
                w, gone = words(r.text), set()
                for i in range(len(w) - 12):
                    if first[tuple(w[i : i + 13])] < r.doc_id:
                        gone |= set(range(i, i + 13))
                assert texts[r.doc_id] == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else r.text)
        if name == "decontaminate":
            assert {r.doc_id for r in after} <= {r.doc_id for r in rows}
        if name == "tokens":
            assert {r.doc_id: r.decoded_sha256 for r in after} == {r.doc_id: sha(r.text or "") for r in rows}
        docs = made
