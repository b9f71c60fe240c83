"""Alignment, language-model scores and importance resampling against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import context_mixing as cm, importance_resampling as ir, pieces, token_alignment as ta
from lexloom.llm.quality import crc_class

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    (1, "The cat sat on the mat. The cat, the mat!"),
    (2, "the cat  sat\n\non\tthe mat "),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "Ünïcödé 中文 测试 　 the end\x00 <|endoftext|> </s> <0x0A>"),
    (7, "odd ▁ text of the cat"),
    (8, "the cat sat on the mat. " * 400),
    (9, "x" * 5000),
    (10, "The cat sat on the mat. The cat, the mat!"),
    (10, "The cat sat on the mat. The cat, the mat!"),
    (None, "the cat is a cat"),
    (12, "  leading and  trailing  "),
    (13, "tail\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def same(x):
    return sorted(map(repr, x))


def files():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def aligned(rows):
    own = ta.Pair(*(open(f, "rb").read() for f in files()))
    found, count = [], collections.Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = own.a.encode(" " + (text or ""), add_special_tokens=False).ids, own.b.encode(text or "")
        if not text or not whole == b"".join(own.a_bytes[i] for i in a) == b"".join(own.b_bytes[i] for i in b):
            found.append((doc, None))
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]) for t, ids in ((own.a_bytes, a), (own.b_bytes, b))]
        cuts = np.intersect1d(*ends)
        at = [np.searchsorted(e, cuts) + 1 for e in ends]
        parts = zip(*(np.split(np.array(ids), x[:-1]) for ids, x in zip((a, b), at, strict=True)), strict=True)
        groups = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        links = [(a[i - 1], b[j - 1]) for i, j in zip(*at, strict=True)]
        count.update(links)
        found.append((doc, (len(a), len(b), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest())))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for d, x in found]


@pytest.mark.parametrize("frequent", [None, 3])
def test_alignment(spark, docs, frequent, monkeypatch):
    if frequent:
        monkeypatch.setattr(ta, "BROADCAST_PAIRS", 0)
    extra = docs.withColumns({"n_a": F.lit("clash"), "row": F.lit(5), "my.key": F.lit("kept")})
    made = ta.alignments(extra, *files(), frequent)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert same(map(tuple, made.select(names).collect())) == same(aligned(TEXTS))
    assert {(r["row"], r["my.key"]) for r in made.collect()} == {(5, "kept")}


def test_alignment_of_whole_texts_and_of_nothing(spark, docs, monkeypatch):
    content = tuple(open(f, "rb").read() for f in files())
    assert ta.separable(*content) and not ta.separable(content[0].replace(b'"ByteLevel"', b'"Whitespace"', 1), content[1])
    assert ta.alignments(docs.limit(0), *files()).collect() == []
    monkeypatch.setattr(ta, "separable", lambda *a: False)
    few = [x for x in TEXTS if x[0] in (1, 2, 6, 7, 12)]
    made = ta.alignments(docs.where("doc_id in (1, 2, 6, 7, 12)"), *files())
    assert same(map(tuple, made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == same(aligned(few))


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + ["\0"]


@pytest.mark.parametrize("frequent", [None, 2])
def test_base_scores(docs, frequent):
    train = [t for d, t in TEXTS if d is not None and zlib.crc32(str(d).encode()) % 10]
    count = collections.Counter(x for t in train for x in tokens(t))
    n, v = sum(count.values()), len(count)
    wanted = [(d, len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for d, t in TEXTS]
    made = cm.language_scores(docs.withColumn("score", F.lit("clash")), crc_class(10) != 0, frequent).collect()
    assert same((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in made) == same(wanted)
    assert all(math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in made)
    # Equal texts, equal scores.
    assert len({r.score for r in made if r.doc_id in (1, 10)}) == 1


def test_scores_are_log_probabilities(spark):
    """All texts of one byte and an end: their probabilities and those of the longer ones are 1 in all."""
    units = spark.createDataFrame([("a", 3), ("ab ", 2), ("b", 1)], "piece string, n long")
    counts = spark.sparkContext.broadcast(cm.Counts(cm.slot_counts(units)))
    mixer = cm.learnt(units, counts)
    # First bytes of a unit: a byte's probability is the product of its bits', which add up to 1 over all bytes.
    bits = [cm.Bits(np.array([b], np.uint8), np.array([0, 1])) for b in range(256)]
    total = 0.0
    for one in bits:
        p = 1.0
        for j in range(8):
            y, slots, node = one.bit(j, slice(0, 1))
            _, _, x = mixer.mixed([counts.value.odds[s] for s in slots], [counts.value.seen[slots[k]] for k in cm.LONG], j)
            own = mixer.probability(x, node)[0]
            p *= own if y[0] else 1 - own
        total += p
    assert abs(total - 1) < 1e-6


def test_held_out_texts_cost_less_than_noise(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    noise = docs.where(crc_class(10) == 0).limit(20).select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.reverse("text").alias("text"))
    made = cm.language_scores(docs.union(noise), (crc_class(10) != 0) & (F.col("doc_id") < 10_000_000)).toPandas()
    held = made[(made.doc_id < 10_000_000) & [zlib.crc32(str(d).encode()) % 10 == 0 for d in made.doc_id]]
    reverse = made[made.doc_id >= 10_000_000]
    assert held.bits_per_byte.mean() < 3.2 < reverse.bits_per_byte.mean()


def test_scores_without_training_and_of_nothing(docs):
    made = cm.language_scores(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in made} == {0} and {r.n_known for r in made} == {0}
    assert all(abs(r.bits_per_byte - 8) < 1e-3 for r in made)
    assert cm.language_scores(docs.limit(0), F.lit(True)).collect() == []


def drawn(rows, target, longest=1, percent=10, least=20):
    def runs(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    s, t = (collections.Counter(bucket(x) for text in y for x in runs(text)[1]) for y in ([r[1] for r in rows], target))
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1.0) * (sum(s.values()) + 10_000.0) / ((s[k] + 1.0) * (sum(t.values()) + 10_000.0))))
    made = []
    for doc, text in rows:
        w, f = runs(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        made.append([doc, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in made if r[1] >= least), key=lambda r: (-r[4], -math.inf if r[0] is None else r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return made


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling(spark, docs, longest):
    target = ["the cat sat on a mat", "Zahl 中文", None]
    rows = TEXTS + [(100 + i, f"word{i % 7} number {i} " * (5 + i % 9)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("clash"))
    made = ir.resampled(table, spark.createDataFrame([(x,) for x in target], "text string"), percent=40, longest=longest)
    assert made.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert same(map(tuple, made.collect())) == same(map(tuple, drawn(rows, target, longest, 40)))
    texts = ir.drawn_documents(table, spark.createDataFrame([(x,) for x in target], "text string"), percent=40, longest=longest)
    assert sorted(r["rank"] for r in texts.collect()) == sorted(r[5] for r in drawn(rows, target, longest, 40) if r[5])


def test_resampling_of_nothing(spark, docs):
    empty = docs.select("text").limit(0)
    assert ir.resampled(docs.limit(0), empty).collect() == []
    assert {r.rank for r in ir.resampled(docs, empty, percent=0).collect()} == {None}


def test_crc_of_runs():
    rng = np.random.default_rng(3)
    buf = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 300)
    ends = starts + np.where(rng.random(300) < 0.1, rng.integers(60, 100, 300), rng.integers(0, 20, 300))
    assert ir.crc32_of_runs(buf, starts, ends).tolist() == [zlib.crc32(buf[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_parts_of_pieces(spark):
    records = spark.createDataFrame([(str(i), i // 10) for i in range(1000)], "piece string, n long")
    most, others = pieces.parted(records, 100)
    assert 80 <= most.count() <= 100 and most.count() + others.count() == 1000
    assert min(r.n for r in most.collect()) > max(r.n for r in others.collect())


def test_token_rows_are_grouped_in_the_order_of_their_windows(spark):
    from lexloom.llm.scratch import groups_in_order

    content = tuple(open(f, "rb").read() for f in files())
    counted = spark.createDataFrame([(" the", 3), (" cat", 2)], "piece string, n long")
    before = spark.conf.get("spark.sql.execution.replaceHashWithSortAgg")
    with groups_in_order(spark):
        made = ta.aligned(counted, content, ta.CUT)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.piece, r.n, r.same) for r in made.collect()) == [(" cat", 2, True), (" the", 3, True)]
    assert plan.count("HashAggregate") == 0 and plan.count("SortAggregate") == 1
    assert len(re.findall(r"[-+ ] Sort \[", plan)) == 2
    shares = int(spark.conf.get("spark.sql.shuffle.partitions")) * ta.SHARES
    assert made.rdd.getNumPartitions() == shares and ta.SHARES > 1
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg") == before
