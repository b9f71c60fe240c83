"""Queries on glossaries, term matching, prefixes and layered lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glossary, matching
from .registry import query

_FIRST = "SELECT p_name AS src, arg_min(p_brand, p_partkey) AS dst FROM part {} GROUP BY p_name"


def _terms(t, where="true"):
    rows = t("part").where(where).select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_partkey").alias("ord"))
    return glossary.first_wins(rows, ["src"], ["ord"]).select("src", "dst")


@query(_FIRST.format(""))
def glossary_first_wins(t):
    return _terms(t)


@query("SELECT p_name AS src, arg_max(p_brand, p_partkey) AS dst FROM part GROUP BY p_name")
def glossary_last_wins(t):
    rows = t("part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_partkey").alias("ord"))
    return glossary.last_wins(rows, ["src"], ["ord"]).select("src", "dst")


_ODD = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '[' || p_name WHEN p_partkey % 7 = 0 THEN left(p_name, 2) WHEN p_partkey % 11 = 0 THEN '@1@' ELSE p_name END AS src, CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 17 = 0 THEN p_name ELSE p_brand END AS dst FROM part"


@query(rf"SELECT CASE WHEN trim(src) = '' THEN 'empty' WHEN regexp_matches(src, '[\\\[\]]') THEN 'control' WHEN regexp_matches(src, '^[@⟦]\d+[@⟧]$') THEN 'placeholder' WHEN regexp_matches(trim(src), '^[A-Za-z]{{1,2}}$') THEN 'short' WHEN trim(src) = trim(dst) THEN 'same' ELSE 'good' END AS problem, count(*) AS n FROM ({_ODD}) GROUP BY 1")
def term_validity(t):
    k, name = F.col("p_partkey"), F.col("p_name")
    src = F.when(k % 5 == 0, F.concat(F.lit("["), name)).when(k % 7 == 0, F.substring(name, 1, 2)).when(k % 11 == 0, "@1@").otherwise(name)
    dst = F.when(k % 13 == 0, " ").when(k % 17 == 0, name).otherwise(F.col("p_brand"))
    return t("part").groupBy(F.coalesce(glossary.term_problem(src, dst), F.lit("good")).alias("problem")).agg(F.count("*").alias("n"))


_OLD, _NEW = _FIRST.format("WHERE p_size < 12"), _FIRST.format("WHERE p_size >= 12 AND p_partkey % 9 < 4")


@query(f"SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'kept' WHEN o.dst <> n.dst THEN 'conflict' ELSE 'same' END AS status FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON lower(trim(o.src)) = lower(trim(n.src))")
def glossary_merge(t):
    return glossary.merge_terms(_terms(t, "p_size < 12"), _terms(t, "p_size >= 12 and p_partkey % 9 < 4"))


@query(f"SELECT lower(coalesce(o.src, n.src)) AS k, o.dst AS old, n.dst AS new, CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' ELSE 'modified' END AS change FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.src = n.src WHERE o.dst IS DISTINCT FROM n.dst")
def glossary_diff(t):
    return glossary.diff_terms(_terms(t, "p_size < 12"), _terms(t, "p_size >= 12 and p_partkey % 9 < 4"))


@query(f"SELECT coalesce(o.src, n.src) AS src, coalesce(n.dst, o.dst) AS dst, CASE WHEN n.src IS NULL THEN 'kept' WHEN o.src IS NULL THEN 'inserted' WHEN o.dst <> n.dst THEN 'updated' ELSE 'same' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.src = n.src")
def cache_upsert(t):
    return glossary.upsert(_terms(t, "p_size < 12"), _terms(t, "p_size >= 12 and p_partkey % 9 < 4"), "src", "dst")


@query(f"SELECT src, dst FROM ({_OLD}) WHERE src NOT IN (SELECT p_name FROM part WHERE p_partkey < 40)")
def cache_remove(t):
    return _terms(t, "p_size < 12").join(_terms(t, "p_partkey < 40"), "src", "left_anti")


@query("""
WITH b AS (SELECT 'k' || s_suppkey AS src, s_name AS dst, s_suppkey AS k FROM supplier),
r AS (SELECT *, CASE WHEN k % 7 = 1 AND k % 14 <> 1 THEN 'm' || k ELSE src END AS to_src, k % 7 = 1 AND k % 14 <> 1 AS moved FROM b WHERE k % 5 <> 0)
SELECT to_src AS src, CASE WHEN k % 3 = 0 AND NOT moved THEN 'changed' ELSE dst END AS dst, CASE WHEN k % 3 = 0 AND NOT moved THEN 'changed' WHEN moved THEN 'renamed' ELSE 'kept' END AS origin FROM r
UNION ALL SELECT 'n' || k, 'new', 'added' FROM b WHERE k % 10 = 0""")
def staged_edits(t):
    """Delete, rename unless the name is taken, change and add, in that order."""
    s = t("supplier").select(F.concat(F.lit("k"), "s_suppkey").alias("src"), F.col("s_name").alias("dst"), F.col("s_suppkey").alias("k"))
    taken = s.where("k % 14 = 1").select("src", F.lit("k2").alias("to"))
    renames = s.where("k % 7 = 1 and k % 14 <> 1").select("src", F.concat(F.lit("m"), "k").alias("to")).union(taken)
    adds = s.where("k % 10 = 0").select(F.concat(F.lit("n"), "k").alias("src"), F.lit("new").alias("dst")).union(s.where("k % 5 = 1").select("src", F.lit("not over").alias("dst")).where(~F.col("src").isin("k1")))
    adds = adds.join(s.where("k % 5 = 0 or (k % 7 = 1 and k % 14 <> 1)").select("src"), "src", "left_anti")
    return glossary.staged_edit(s.select("src", "dst"), s.where("k % 5 = 0").select("src"), renames, s.where("k % 3 = 0").select("src", F.lit("changed").alias("dst")), adds)


@query("SELECT section, src, ord, dst, f AS first_dst FROM (SELECT p_size AS section, p_name AS src, p_partkey AS ord, p_brand AS dst, first_value(p_brand) OVER (PARTITION BY p_size, lower(trim(p_name)) ORDER BY p_partkey) AS f FROM part) WHERE dst <> f")
def inconsistent_terms(t):
    rows = t("part").select(F.col("p_size").alias("section"), F.col("p_name").alias("src"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("dst"))
    return glossary.inconsistent_terms(rows, "section", "ord")


@query(f"SELECT p_size AS section, count(*) AS total, count(*) FILTER (WHERE p_name IN (SELECT src FROM ({_OLD}))) AS in_terms, count(*) FILTER (WHERE p_name NOT IN (SELECT src FROM ({_OLD}))) AS missing FROM part GROUP BY ROLLUP (p_size)")
def term_plan(t):
    rows = t("part").select(F.col("p_size").alias("section"), F.col("p_name").alias("src"))
    return glossary.term_plan(rows, _terms(t, "p_size < 12"))


# Terms for matching: first words of the benchmark's items, of one to three words.
_WORDS = "SELECT item_id, regexp_extract_all(text, '[0-9A-Za-z_À-ɏ]+') AS w FROM benchmark"
_BENCH_TERMS = f"SELECT src, min(item_id) AS item_id FROM (SELECT item_id, array_to_string(list_slice(w, 1, 1 + item_id % 3), ' ') AS src FROM ({_WORDS}) WHERE len(w) > 3) GROUP BY src"
_HITS = f"""
WITH terms AS ({_BENCH_TERMS}), d AS (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-z_À-ɏ]+|[^0-9A-Za-z_À-ɏ]+') AS w FROM documents),
g AS (SELECT doc_id, i // 2 AS pos, n, array_to_string(list_slice(w, i + 1, i + n), '') AS src FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT unnest([1, 3, 5]) AS n) WHERE len(w) >= n)),
hits AS (SELECT doc_id, src, pos, item_id FROM g JOIN terms USING (src))"""


def _bench_terms(t):
    w = F.regexp_extract_all("text", F.lit(f"({matching.WORD}+)"), F.lit(1))
    rows = t("benchmark").select("item_id", w.alias("w")).where("size(w) > 3")
    rows = rows.select("item_id", F.array_join(F.slice("w", F.lit(1), (F.col("item_id") % 3 + 1).cast("int")), " ").alias("src"))
    return rows.groupBy("src").agg(F.min("item_id").alias("item_id"))


@query(f"{_HITS} SELECT src, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM hits GROUP BY src")
def term_matches(t):
    """Terms at word boundaries in the documents."""
    hits = matching.term_hits(t("documents"), _bench_terms(t), ["doc_id"], longest=3)
    return hits.groupBy("src").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query(f"{_HITS} SELECT doc_id, src FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, length(src) DESC, src) AS r FROM hits) WHERE r = 1")
def first_term(t):
    return matching.first_term(matching.term_hits(t("documents"), _bench_terms(t), ["doc_id"], longest=3), ["doc_id"])


@query(f"{_HITS} SELECT doc_id, string_agg(src || '=' || item_id, ';' ORDER BY src) AS terms FROM (SELECT DISTINCT doc_id, src, item_id FROM hits) GROUP BY doc_id")
def hit_terms(t):
    terms = _bench_terms(t)
    found = matching.hit_terms(matching.term_hits(t("documents"), terms, ["doc_id"], longest=3), terms.select("src", F.col("item_id").cast("string").alias("dst")), ["doc_id"])
    pair = F.transform(F.map_entries("terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("doc_id", F.array_join(pair, ";").alias("terms"))


@query(r"""
WITH terms AS (SELECT DISTINCT regexp_extract(text, '[0-9A-Za-z_À-ɏ]+', 0) || unnest(['.', ',']) AS src FROM benchmark WHERE regexp_matches(text, '[0-9A-Za-z_À-ɏ]')),
d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_À-ɏ]+|[^\p{L}\p{N}_À-ɏ]') AS w FROM documents),
g AS (SELECT doc_id, a || b AS src, after FROM (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS after FROM d))
SELECT src, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM g JOIN terms USING (src) WHERE after IS NULL OR NOT regexp_matches(after, '^[\p{L}\p{N}_À-ɏ]') GROUP BY src""")
def punctuated_terms(t):
    """Terms that end with a mark: a word's character behind it keeps it from being one."""
    first = F.regexp_extract("text", "[0-9A-Za-z_À-ɏ]+", 0)
    terms = t("benchmark").where(first != "").select(first.alias("w"), F.explode(F.array(F.lit("."), F.lit(","))).alias("mark")).select(F.concat("w", "mark").alias("src")).distinct()
    hits = matching.term_hits(t("documents"), terms, ["doc_id"])
    return hits.groupBy("src").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query("""
WITH p AS (SELECT prefix, min(doc_id) AS dst FROM (SELECT doc_id, regexp_extract(text, '^([^ .,:;!?\\]\\)]+)', 1) AS prefix FROM documents UNION ALL SELECT doc_id, regexp_extract(text, '^([^ .,:;!?\\]\\)]+ [^ .,:;!?\\]\\)]+)', 1) FROM documents WHERE doc_id % 3 = 0) WHERE prefix <> '' GROUP BY prefix),
m AS (SELECT d.doc_id, p.prefix, p.dst, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(p.prefix) DESC) AS r FROM documents d JOIN p ON starts_with(d.text, p.prefix) AND (length(p.prefix) = length(d.text) OR regexp_matches(substr(d.text, length(p.prefix) + 1, 1), '[ .,:;!?\\]\\)]')))
SELECT doc_id, prefix, dst FROM m WHERE r = 1""")
def longest_prefix(t):
    """The longest known prefix of each document, of one or two words."""
    stop = r"[^ .,:;!?\]\)]+"
    one = t("documents").select("doc_id", F.regexp_extract("text", f"^({stop})", 1).alias("prefix"))
    two = t("documents").where("doc_id % 3 = 0").select("doc_id", F.regexp_extract("text", f"^({stop} {stop})", 1).alias("prefix"))
    known = one.union(two).where("prefix <> ''").groupBy("prefix").agg(F.min("doc_id").alias("dst"))
    return matching.longest_prefix(t("documents").select("doc_id", "text"), known, ["doc_id"])


@query("""
SELECT o_orderkey, coalesce(a.v, b.v, c.v, 'none') AS v FROM orders
LEFT JOIN (SELECT c_custkey, c_nationkey, 'own ' || c_name AS v FROM customer WHERE c_custkey % 3 = 0) a ON o_custkey = a.c_custkey
LEFT JOIN (SELECT c_custkey, 'seg ' || c_mktsegment AS v FROM customer WHERE c_custkey % 3 = 1) b ON o_custkey = b.c_custkey
LEFT JOIN (SELECT o_orderpriority AS p, 'pri ' || min(o_orderstatus) AS v FROM orders WHERE o_orderpriority < '4' GROUP BY p) c ON o_orderpriority = c.p""")
def layered_lookup(t):
    """A value from the first of several layers that has the key."""
    c = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    own = c.where("o_custkey % 3 = 0").select("o_custkey", F.concat(F.lit("own "), "c_name").alias("v"))
    segment = c.where("o_custkey % 3 = 1").select("o_custkey", F.concat(F.lit("seg "), "c_mktsegment").alias("v"))
    priority = t("orders").where("o_orderpriority < '4'").groupBy("o_orderpriority").agg(F.concat(F.lit("pri "), F.min("o_orderstatus")).alias("v"))
    layers = [(own, ["o_custkey"]), (segment, ["o_custkey"]), (priority, ["o_orderpriority"])]
    return matching.with_fallback(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), layers, "v", F.lit("none")).select("o_orderkey", "v")


@query("SELECT src, arg_min(dst, ord) AS dst FROM (SELECT p_name AS src, p_brand AS dst, p_partkey AS ord FROM part WHERE p_brand <> '' AND p_size % 2 = 0 UNION ALL SELECT p_type, p_brand, 1000000 + p_partkey FROM part) GROUP BY src")
def reference_union(t):
    """Many dictionaries as one: the first file that has a source wins."""
    a = t("part").where("p_brand <> '' and p_size % 2 = 0").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_partkey").alias("ord"))
    b = t("part").select(F.col("p_type").alias("src"), F.col("p_brand").alias("dst"), (F.col("p_partkey") + 1000000).alias("ord"))
    return glossary.first_wins(a.union(b), ["src"], ["ord"]).select("src", "dst")
