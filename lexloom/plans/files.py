"""Queries on dictionaries, rule files, exchange files, write-back, messages and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codes, fields, glossary, matching, messages, qa, rules, writeback
from ..sources import dictionaries as d, text as source
from .registry import query


def _part(t):
    return t("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))


def _json_files(t):
    """A dictionary file for each size; every seventh is broken, every eleventh pair blank."""
    dst = F.when(F.col("k") % 11 == 0, " ").otherwise(F.col("brand"))
    rows = _part(t).groupBy("size", "name").agg(F.min_by(dst, "k").alias("dst"))
    pairs = F.map_from_entries(F.collect_list(F.struct("name", "dst")))
    text = F.to_json(pairs)
    made = rows.groupBy("size").agg(text.alias("text"))
    return made.select(F.format_string("f%03d", "size").alias("file"), F.when(F.col("size") % 7 == 0, F.concat(F.lit("{"), "text")).otherwise(F.col("text")).alias("text"))


_FILES = "SELECT 'f' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS file, p_name AS src, arg_min(CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_brand END, p_partkey) AS dst FROM part WHERE p_size % 7 <> 0 GROUP BY ALL"


@query(_FILES)
def dictionary_entries(t):
    """Pairs of all dictionaries; broken files have none."""
    return d.entries(_json_files(t))


@query(f"SELECT src, arg_min(dst, file) AS dst FROM ({_FILES}) WHERE trim(dst) <> '' GROUP BY src")
def reference_entries(t):
    return d.reference_entries(_json_files(t))


@query("SELECT 'f' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS file FROM part GROUP BY p_size HAVING p_size % 7 = 0")
def broken_files(t):
    return d.exchange_files(_json_files(t))[1].select("file")


@query("SELECT p_brand AS file, p_name AS src, arg_max(p_type, p_partkey) AS dst FROM part GROUP BY ALL")
def exchange_items(t):
    """Items as objects in some files and as lists in others, of which the last of a source wins."""
    p = t("part")
    ordered = F.sort_array(F.collect_list(F.struct("p_partkey", F.col("p_name").alias("src"), F.col("p_type").alias("dst"))))
    lists = p.groupBy("p_brand").agg(F.to_json(F.struct(F.transform(ordered, lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("items"))).alias("text"))
    last = p.groupBy("p_brand", "p_name").agg(F.max_by("p_type", "p_partkey").alias("dst"))
    maps = last.groupBy("p_brand").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("p_name", "dst"))).alias("items"))).alias("other"))
    odd = F.substring("p_brand", -1, 1).cast("int") % 2 == 1
    files = lists.join(maps, "p_brand")
    return d.exchange_items(files.select(F.col("p_brand").alias("file"), F.when(odd, F.col("text")).otherwise(F.col("other")).alias("text")))


@query("SELECT 's' || p_size AS file, 'now' AS saved_at, p_name AS src, CASE WHEN p_size % 2 = 0 THEN '' ELSE min(p_brand) END AS dst FROM part GROUP BY p_size, p_name")
def snapshot_terms(t):
    """Snapshots of terms, old ones as lists of sources."""
    rows = _part(t).groupBy("size", "name").agg(F.min("brand").alias("brand"))
    made = rows.groupBy("size").agg(F.to_json(F.struct(F.lit("now").alias("saved_at"), F.map_from_entries(F.collect_list(F.struct("name", "brand"))).alias("terms"))).alias("new"), F.to_json(F.struct(F.lit("now").alias("saved_at"), F.collect_list("name").alias("terms"))).alias("old"))
    return d.snapshot_terms(made.select(F.concat(F.lit("s"), "size").alias("file"), F.when(F.col("size") % 2 == 0, F.col("old")).otherwise(F.col("new")).alias("text")))


def _rule_files(t):
    r = _part(t).where("size < 30")
    whole = F.to_json(F.struct(F.col("name").alias("src"), F.col("brand").alias("dst"), (F.col("k") % 2 == 0).alias("regex")))
    item = F.when(F.col("k") % 5 == 0, F.to_json(F.struct(F.lit("").alias("src")))).when(F.col("k") % 3 == 0, F.concat(F.lit('"'), "name", F.lit('"'))).otherwise(whole)
    ordered = F.sort_array(F.collect_list(F.struct("k", item.alias("item"))))
    listed = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["item"]), ","), F.lit("]"))
    text = F.when(F.col("size") % 2 == 0, F.concat(F.lit('{"rules":'), "listed", F.lit("}"))).otherwise(F.col("listed"))
    return r.groupBy("size").agg(listed.alias("listed")).select(F.format_string("r%02d", "size").alias("file"), text.alias("text"))


_RULES = "SELECT 'r' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS file, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS ord, p_partkey AS k, p_name AS src, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS dst, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS regex, '' AS info FROM part WHERE p_size < 30"


@query(f"SELECT * EXCLUDE (k) FROM ({_RULES}) WHERE k % 5 <> 0")
def rule_files(t):
    """Rules as objects or plain sources, bare or under a name; blank ones go."""
    return d.rules(_rule_files(t))


@query(f"SELECT src, arg_min(dst, (file, ord)) AS dst FROM ({_RULES}) WHERE k % 5 <> 0 GROUP BY src")
def active_rules(t):
    return d.active_rules(d.rules(_rule_files(t))).select("src", "dst")


@query(f"SELECT file, count(*) AS rules FROM ({_RULES}) WHERE k % 5 <> 0 GROUP BY file")
def rule_presets(t):
    return d.presets(d.rules(_rule_files(t)))


@query("SELECT DISTINCT lower(p_brand) AS word FROM part WHERE p_size % 3 <> 1 UNION SELECT unnest(['the', 'and']) AS word")
def white_list(t):
    """Own words of files with those by default, without those taken off."""
    made = _part(t).groupBy("size").agg(F.to_json(F.struct(F.collect_set(F.lower("brand")).alias("words"))).alias("text"))
    found = d.word_lists(made.where("size % 3 <> 1").select(F.col("size").alias("file"), "text"), "words").select("word")
    return found.union(found.sparkSession.createDataFrame([("the",), ("and",)], "word string")).distinct()


@query("SELECT trim(p_name) AS src, arg_min(p_brand, (p_size, p_partkey)) AS dst FROM part GROUP BY trim(p_name)")
def prefix_files(t):
    """Prefix dictionaries, in two shapes and with white space around."""
    best = _part(t).groupBy("name").agg(F.min_by("brand", F.struct("size", "k")).alias("brand"), F.min("size").alias("size"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" "), "name"), F.concat("brand", F.lit("\t")))))
    made = best.groupBy("size").agg(pairs.alias("m"))
    text = F.when(F.col("size") % 2 == 0, F.to_json(F.struct(F.lit(1).alias("version"), F.col("m").alias("entries")))).otherwise(F.to_json("m"))
    return d.prefix_entries(made.select(F.col("size").alias("file"), text.alias("text")))


@query("SELECT p_brand AS file, p_name AS src, min(p_type || '\"' || p_partkey % 3) AS dst FROM part GROUP BY ALL")
def marker_block(t):
    """Pairs between two marker lines of a glossary file, written and read back."""
    terms = t("part").groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("src")).agg(F.min(F.concat("p_type", F.lit('"'), F.col("p_partkey") % 3)).alias("dst"))
    text = F.concat(F.lit('T = {\n    "before": "x",\n    # AUTO START\n'), "text", F.lit('\n    # AUTO END\n    "after": "y",\n}'))
    files = d.glossary_text(terms, ["file"]).select("file", text.alias("text"))
    return d.pair_lines(files, "# AUTO START", "# AUTO END").select("file", "src", "dst")


@query("SELECT p_size AS sheet, p_name AS src, p_brand AS dst FROM part WHERE p_size % 2 = 1")
def sheet_pairs(t):
    """Sheets with two rows above the header, whose columns differ; those without a header have no pairs."""
    p = _part(t)
    body = p.select(F.col("size").alias("sheet"), (F.col("k") + 10).alias("row_no"), F.when(F.col("size") % 3 == 0, F.array("brand", "name")).otherwise(F.array(F.lit("?"), "name", "brand")).alias("cells"))
    heads = p.select("size").distinct().where("size % 2 = 1").withColumn("row_no", F.lit(2).cast("long"))
    heads = heads.select(F.col("size").alias("sheet"), "row_no", F.when(F.col("size") % 3 == 0, F.array(F.lit("Chinese"), F.lit("English "))).otherwise(F.array(F.lit("Old Chinese"), F.lit("english"), F.lit("CHINESE"))).alias("cells"))
    return d.sheet_pairs(body.union(heads), "sheet", ["english", "en"], ["chinese", "zh"]).select("sheet", "src", "dst")


@query("SELECT p_size AS sheet, CAST(count(*) FILTER (WHERE k > 1 AND k NOT IN (2, 3)) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE k = 1) AS BIGINT) AS empty, CAST(count(*) FILTER (WHERE k = 2) AS BIGINT) AS same, CAST(count(*) FILTER (WHERE k = 3) AS BIGINT) AS short FROM (SELECT *, 1 + p_partkey % 7 AS k FROM part) GROUP BY p_size")
def sheet_counters(t):
    k = F.col("k") % 7
    rows = _part(t).select(F.col("size").alias("sheet"), F.when(k == 2, "ab").otherwise(F.col("name")).alias("src"), F.when(k == 0, "").when(k == 1, F.col("name")).otherwise(F.col("brand")).alias("dst"))
    return d.sheet_counters(rows, "sheet")


@query("SELECT doc_id, md5(text) AS digest, doc_id % 2 = 0 AS bom FROM documents WHERE doc_id % 3 <> 0")
def utf8_files(t):
    """Binary files: those that are no UTF-8 are rejected, byte order marks noted and taken off."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    made = d.utf8_texts(t("documents").select(F.col("doc_id").alias("file"), raw.alias("content")))
    return made.select(F.col("file").alias("doc_id"), F.md5("text").alias("digest"), "bom")


_LINES_SQL = "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'items.txt' WHEN 1 THEN 'Moves_2.txt' WHEN 2 THEN 'pokemon_metrics.txt' WHEN 3 THEN 'pokemon.txt' WHEN 4 THEN 'map.txt' ELSE 'dir/types.txt' END AS file, p_name, p_brand FROM part"


def _field_lines(t):
    k = F.col("k") % 6
    file = F.when(k == 0, "items.txt").when(k == 1, "Moves_2.txt").when(k == 2, "pokemon_metrics.txt").when(k == 3, "pokemon.txt").when(k == 4, "map.txt").otherwise("dir/types.txt")
    line = F.when(F.col("k") % 4 == 0, F.concat(F.lit('  Name = "'), "name", F.lit('"'))).when(F.col("k") % 4 == 1, F.concat(F.lit("Name="), "name", F.lit("  "))).when(F.col("k") % 4 == 2, F.concat(F.lit("Price = "), "name")).otherwise(F.concat(F.lit("Description = "), "name"))
    return _part(t).select(file.alias("file"), F.col("k").alias("line_no"), line.alias("line"))


@query("SELECT CASE p_partkey % 6 WHEN 0 THEN 'items' WHEN 1 THEN 'moves' WHEN 3 THEN 'pokemon' WHEN 5 THEN 'types' END AS class, count(*) AS n FROM part GROUP BY 1")
def file_classes(t):
    return _field_lines(t).groupBy(writeback.file_class(F.col("file")).alias("class")).agg(F.count("*").alias("n"))


_WRITTEN = f"""
SELECT k AS line_no, CASE k % 4 WHEN 0 THEN '  Name = "' || coalesce(dst, p_name) || '"' WHEN 1 THEN 'Name=' || coalesce(dst, p_name) || '  ' WHEN 2 THEN 'Price = ' || p_name ELSE 'Description = ' || coalesce(dst, p_name) END AS line,
  dst IS NOT NULL AS changed
FROM (SELECT l.k, l.p_name, CASE WHEN k % 4 = 2 OR file IN ('pokemon_metrics.txt', 'map.txt') OR (k % 4 = 3 AND file IN ('pokemon.txt', 'dir/types.txt')) THEN NULL ELSE e.dst END AS dst
  FROM ({_LINES_SQL}) l LEFT JOIN (SELECT class, src, arg_min(dst, o) AS dst FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'items' WHEN 1 THEN 'moves' ELSE 'types' END AS class, p_name AS src, 'x' || p_partkey AS dst, p_partkey AS o FROM part) GROUP BY ALL) e
  ON e.src = l.p_name AND e.class = CASE file WHEN 'items.txt' THEN 'items' WHEN 'Moves_2.txt' THEN 'moves' WHEN 'dir/types.txt' THEN 'types' WHEN 'pokemon.txt' THEN 'pokemon' END)"""


def _written(t):
    k = F.col("k") % 3
    entries = _part(t).select(F.when(k == 0, "items").when(k == 1, "moves").otherwise("types").alias("class"), F.col("name").alias("src"), F.concat(F.lit("x"), "k").alias("dst"), F.lit("f").alias("file"), F.col("k").alias("o"))
    return writeback.write_fields(_field_lines(t), "file", glossary.classed_entries(entries, "o"))


@query(_WRITTEN)
def written_fields(t):
    """Values of field lines replaced by the dictionary of the file's class; quotes and white space stay."""
    return _written(t).select("line_no", "line", "changed")


@query(f"SELECT count(*) AS n FROM ({_WRITTEN}) WHERE changed")
def written_fields_dry_run(t):
    return _written(t).where("changed").agg(F.count("*").alias("n"))


_APPLIED = "SELECT coalesce(a.src, b.src) AS src, CASE WHEN b.dst IS NOT NULL AND b.dst <> '' AND b.dst <> coalesce(a.src, b.src) THEN b.dst ELSE a.dst END AS dst, CASE WHEN b.dst IS NULL THEN 'kept' WHEN b.dst = '' OR b.dst = b.src THEN 'skipped' WHEN a.dst IS NULL THEN 'added' WHEN a.dst = b.dst THEN 'same' ELSE 'updated' END AS action FROM (SELECT 'k' || p_partkey AS src, p_brand AS dst FROM part WHERE p_partkey % 3 < 2) a FULL JOIN (SELECT 'k' || p_partkey AS src, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'k' || p_partkey WHEN 2 THEN p_brand ELSE p_type END AS dst FROM part WHERE p_partkey % 3 > 0) b ON a.src = b.src"


def _applied(t):
    p, k = t("part"), F.col("p_partkey")
    key = F.concat(F.lit("k"), k)
    fix = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(F.lit(" "), key)).when(k % 5 == 2, F.col("p_brand")).otherwise(F.col("p_type"))
    return writeback.applied(p.where(k % 3 < 2).select(key.alias("src"), F.col("p_brand").alias("dst")), p.where(k % 3 > 0).select(key.alias("src"), fix.alias("dst")))


@query(_APPLIED)
def applied_fixes(t):
    """A dictionary after fixes, with what became of each."""
    return _applied(t)


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ("updated", "added", "same", "skipped", "kept")) + f" FROM ({_APPLIED})")
def write_totals(t):
    return writeback.action_totals(_applied(t))


@query("SELECT p_size AS file, p_name AS src, CASE WHEN f <> '' THEN f ELSE coalesce(o, '') END AS dst FROM (SELECT p_size, p_name, CASE WHEN p_size % 2 = 0 THEN a ELSE '' END AS f, CASE WHEN p_size % 3 = 0 THEN b END AS o FROM (SELECT p_size, p_name, max(p_type) AS a, max(p_brand) AS b FROM part GROUP BY p_size, p_name))")
def carried_over(t):
    """Items taken out anew keep the translations that they had."""
    rows = t("part").groupBy(F.col("p_size").alias("file"), F.col("p_name").alias("src")).agg(F.max("p_type").alias("a"), F.max("p_brand").alias("b"))
    fresh = rows.select("file", "src", F.when(F.col("file") % 2 == 0, F.col("a")).otherwise("").alias("dst"))
    return writeback.carried_over(fresh, rows.select("file", "src", F.when(F.col("file") % 3 == 0, F.col("b")).alias("dst")), "file")


@query("SELECT p_size AS file, count(*) AS n, string_agg(src || '=' || dst, ';' ORDER BY src) AS items FROM (SELECT p_size, p_name AS src, arg_min(p_brand, p_partkey) AS dst FROM part GROUP BY ALL) GROUP BY p_size")
def grouped_hits(t):
    rows = _part(t).select(F.col("size").alias("file"), F.col("name").alias("src"), F.col("brand").alias("dst"), "k")
    pair = F.transform(F.map_entries("items"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return writeback.grouped_hits(rows, "file", "k").select("file", F.size("items").cast("long").alias("n"), F.array_join(pair, ";").alias("items"))


@query("SELECT a.doc_id, count(*) AS n, count(*) FILTER (WHERE a.line = b.line) AS same FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(text, 'a', 'b'), chr(10)) AS l FROM documents)) a JOIN (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) b ON a.doc_id = b.doc_id AND a.i = b.i GROUP BY a.doc_id")
def by_position(t):
    """Lines of two files met by their numbers."""
    docs = t("documents").select("doc_id", "text")
    both = writeback.by_position(source.lines(docs.withColumn("text", F.replace("text", F.lit("a"), F.lit("b"))), "doc_id"), source.lines(docs, "doc_id"), "doc_id")
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("same"))


@query("SELECT p_partkey, CASE WHEN n THEN 'no_han' WHEN s THEN 'short' WHEN c THEN 'control' ELSE 'good' END AS problem FROM (SELECT p_partkey, p_partkey % 3 <> 0 AND NOT (p_partkey % 7 = 0) AND NOT (p_partkey % 5 = 0) AS n, p_partkey % 7 = 0 AS s, p_partkey % 5 = 0 AND p_partkey % 7 <> 0 AS c FROM part)")
def new_term_problems(t):
    """Why new terms are not admitted."""
    k, name = F.col("p_partkey"), F.col("p_name")
    src = F.when(k % 7 == 0, F.substring(name, 1, 2)).when(k % 5 == 0, F.concat(name, F.lit("["))).otherwise(name)
    dst = F.when(k % 3 == 0, F.concat(F.lit(" 译"), "p_brand")).otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", F.coalesce(glossary.new_term_problem(src, dst), F.lit("good")).alias("problem"))


@query("SELECT p_name AS src, arg_min('译' || p_brand, p_partkey) AS dst, 'auto' AS origin FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size < 12) GROUP BY p_name UNION ALL SELECT p_name, arg_min(p_brand, p_partkey), 'manual' FROM part WHERE p_size < 12 GROUP BY p_name")
def glossary_with_new_terms(t):
    """New terms of a batch after those that a glossary has."""
    p = t("part").select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.col("p_partkey").alias("ord"), "p_size")
    current = glossary.first_wins(p.where("p_size < 12"), ["src"], ["ord"]).select("src", "dst", F.lit("manual").alias("origin"), "ord")
    new = p.select("src", F.concat(F.lit("译"), "dst").alias("dst"), "ord")
    return glossary.with_new_terms(current, new).select("src", "dst", "origin")


@query("SELECT src, dst, (SELECT count(DISTINCT p_name) FROM part WHERE lower(p_name) LIKE '%a%') AS matched FROM (SELECT p_name AS src, '-' AS dst, min(p_partkey) AS ord FROM part WHERE lower(p_name) LIKE '%a%' GROUP BY p_name) ORDER BY ord LIMIT 20")
def searched_terms(t):
    """The first terms that a search finds, and how many there are."""
    rows = _part(t).groupBy(F.col("name").alias("src")).agg(F.lit("-").alias("dst"), F.min("k").alias("ord"))
    return glossary.searched(rows, "A", most=20).select("src", "dst", "matched")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE p_partkey % 4 > 0) AS done, count(*) FILTER (WHERE p_partkey % 4 = 0) AS pending FROM part")
def prefix_stats(t):
    return glossary.prefix_stats(_part(t).select("name", F.when(F.col("k") % 4 == 0, " ").otherwise(F.col("brand")).alias("dst")))


@query(r"SELECT p_partkey, '\xn[' || p_brand || ']\b' AS prefix, '\.\.' || p_name AS rest FROM part WHERE p_partkey % 3 > 0")
def known_prefix(t):
    """The longest known prefix of control codes that a text begins with, and the rest."""
    head = F.concat(F.lit("\\xn["), "p_brand", F.lit("]\\b"))
    known = t("part").select(head.alias("prefix"), F.lit("x").alias("dst")).distinct()
    known = known.union(t("part").select(F.concat(F.lit("\\xn["), "p_brand", F.lit("]")).alias("prefix"), F.lit("y").alias("dst")).distinct())
    rows = t("part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "z").otherwise(""), head, F.lit("\\.\\."), "p_name").alias("text"))
    return matching.known_prefix(rows, known, ["p_partkey"]).select("p_partkey", "prefix", "rest")


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '\b > \r' ELSE '' END || CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN ',' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '\. > -' ELSE '' END AS diff FROM part")
def prefix_codes(t):
    """Control codes that a translated prefix has not kept; names in name tags may differ."""
    src = F.concat(F.lit("\\xn["), "p_name", F.lit("]\\b"), F.when(F.col("p_partkey") % 3 == 0, "\\.").otherwise(""))
    dst = F.concat(F.lit("\\xn["), "p_brand", F.lit("]"), F.when(F.col("p_partkey") % 4 == 0, "\\r").otherwise("\\b"))
    return t("part").select("p_partkey", F.array_join(codes.mismatches(src, dst), ",").alias("diff"))


@query(r"SELECT p_partkey, '\w[' || p_name || ']\tg[' || CASE WHEN p_brand = 'Brand#11' THEN 'B' ELSE p_brand END || ']' || p_type AS text FROM part")
def name_tags(t):
    """Names replaced inside name tags alone."""
    text = F.concat(F.lit("\\w["), "p_name", F.lit("]\\tg["), "p_brand", F.lit("]"), "p_type")
    return t("part").select("p_partkey", codes.name_tags(text, F.create_map(F.lit("Brand#11"), F.lit("B"))).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'zz' || p_name ELSE p_name END AS text FROM part")
def stripped_echo(t):
    """Translations without the old prefix that they repeat."""
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "old:").when(F.col("p_partkey") % 3 == 1, "new:").otherwise("zz"), "p_name")
    return t("part").select("p_partkey", codes.strip_echo(text, F.lit("new:"), F.lit("old:"), F.lit("")).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '⑤ und ②' WHEN p_partkey % 3 = 1 THEN '5 und 2 und 3' ELSE '12 und 2' END AS text FROM part")
def circled_numbers(t):
    """Digits back to circled numbers where there are as many."""
    text = F.when(F.col("p_partkey") % 3 == 0, "5 und 2").when(F.col("p_partkey") % 3 == 1, "5 und 2 und 3").otherwise("12 und 2")
    return t("part").select("p_partkey", rules.restore_circled(text, F.lit("⑤ y ②")).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a... (x) y)' WHEN 1 THEN 'a...' ELSE '(a' END AS text FROM part".replace("'a... (x) y)'", "'(a... (x) y)'"))
def steady_punctuation(t):
    """The source's ellipses, and missing halves of its pairs."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "a… (x) y)").when(k == 1, "a…").otherwise("(a")
    return t("part").select("p_partkey", rules.steady_punctuation(text, F.lit("b... (y)")).alias("text"))


@query("SELECT kind, CAST(CASE kind WHEN 'own' THEN 10 WHEN 'latin' THEN 1 WHEN 'punctuation' THEN 7 WHEN 'symbols' THEN 3 END AS INT) AS place, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'latin' WHEN 2 THEN 'punctuation' ELSE 'symbols' END AS kind FROM part) GROUP BY ALL")
def report_order(t):
    """Findings with those of other checks, in the report's order of kinds."""
    k = F.col("p_partkey") % 4
    kind = F.when(k == 1, "latin").when(k == 2, "punctuation").otherwise("symbols")
    hits = t("part").where(k > 0).select("p_partkey", kind.alias("kind"), F.lit("d").alias("detail"))
    extra = t("part").where(k == 0).select("p_partkey", F.lit("own").alias("kind"))
    return qa.with_extra(hits, extra).groupBy("kind", "place").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'game ' || p_size WHEN p_partkey % 6 IN (2, 4) THEN 'core ' || p_size WHEN p_partkey % 6 = 3 THEN 'all ' || p_name ELSE p_name END AS found FROM part")
def message_chain(t):
    """A text's message: of the game's section, the game's general ones, the core's, or the text itself."""
    p, k = t("part"), F.col("p_partkey")
    key = F.concat("p_name", F.lit("|"), k)
    row = lambda when, section, m: p.where(when).select(section.cast("long").alias("section"), key.alias("key"), m.alias("message"))
    game = row(k % 6 == 0, F.col("p_size"), F.concat(F.lit("game "), "p_size")).union(row(k % 6 == 3, F.lit(0), F.concat(F.lit("all "), "p_name"))).union(row(k % 6 == 1, F.col("p_size"), F.lit("")))
    core = row(k % 2 == 0, F.col("p_size"), F.concat(F.lit("core "), "p_size"))
    found = messages.looked_up(p.select("p_partkey", F.col("p_size").cast("long").alias("section"), key.alias("text")), [game, core])
    return found.select("p_partkey", F.regexp_replace("found", r"\|\d+$", "").alias("found"))


@query("SELECT p_size AS section, '[' || p_size || ']' || chr(13) || chr(10) || string_agg(p_partkey || chr(13) || chr(10) || p_name || chr(13) || chr(10) || p_brand, chr(13) || chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_size")
def section_texts(t):
    rows = _part(t).select(F.col("size").alias("section"), F.col("k").alias("ord"), F.col("name").alias("src"), F.col("brand").alias("dst"))
    return messages.section_text(rows, "section", numbered=True)


@query("SELECT p_size AS section, p_name AS key, arg_max(p_brand, (p_partkey % 3, p_partkey)) AS message FROM part GROUP BY ALL")
def compiled_messages(t):
    """Pairs of lines compiled to messages, later files winning."""
    p = t("part").select((F.col("p_partkey") % 3).alias("file"), F.col("p_size").alias("section"), "p_partkey", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("p_name").alias("line")), F.struct(F.lit(1).alias("o"), F.col("p_brand").alias("line")))).alias("x"))
    rows = p.select("file", "section", (F.col("p_partkey") * 2 + F.col("x.o")).alias("place"), F.col("x.line").alias("line"))
    return messages.compiled(rows, "file", "section").where("complete").select("section", "key", "message")


@query("SELECT p_partkey AS section, p_name AS key, p_brand AS message FROM part WHERE p_partkey % 3 > 0")
def new_messages(t):
    rows = t("part").select(F.col("p_partkey").alias("section"), F.col("p_name").alias("key"), F.col("p_brand").alias("message"))
    return messages.new_messages(rows.union(rows.withColumn("message", F.col("key"))), rows.where("section % 3 = 0"))


@query("SELECT p_partkey, p_name || ' \\\"x\\\"' AS src, 0 AS first FROM part UNION ALL SELECT p_partkey, p_brand, 1 FROM part")
def script_literals(t):
    """Literals of scripts."""
    text = F.concat(F.lit('p _INTL("'), "p_name", F.lit(' \\"x\\"", 1)\n  _INTL( "'), "p_brand", F.lit('")\n_INTL("'), "p_brand", F.lit('")'))
    return messages.script_literals(t("part").select("p_partkey", text.alias("text")), "p_partkey")


@query("SELECT p_partkey, 'p _INTL(\"' || CASE WHEN p_brand = 'Brand#11' THEN 'B' ELSE p_brand END || '\", x_1)' AS text FROM part")
def translated_literals(t):
    text = F.concat(F.lit('p _INTL("'), "p_brand", F.lit('", x_1)'))
    return t("part").select("p_partkey", messages.translated_literals(text, F.create_map(F.lit("Brand#11"), F.lit("B"))).alias("text"))


@query("SELECT p_partkey, p_name || '|' || p_brand || ',\"x|' || p_size AS fields, CAST(3 AS INT) AS n FROM part")
def lexed_fields(t):
    """Fields of record lines, one of them in quotes with a comma and an escaped quote."""
    line = F.concat("p_name", F.lit('  , "'), "p_brand", F.lit(',\\"x", '), "p_size")
    return t("part").select("p_partkey", fields.lexed(line).alias("f")).select("p_partkey", F.array_join("f", "|").alias("fields"), F.size("f").alias("n"))


@query("SELECT p_partkey, p_name || ',\"' || p_brand || ', \\\"y\\\"\",' || p_size AS line FROM part")
def field_writer(t):
    """The same written: quotes where they must be; reading gives the fields back."""
    own = F.array("p_name", F.concat("p_brand", F.lit(', "y"')), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", F.array_join(F.transform(own, fields.quoted_field), ",").alias("line"))


@query("SELECT p_partkey, CAST(ceil((1 + p_partkey % 6) / 2.0) AS BIGINT) AS records FROM part")
def repeated_fields(t):
    own = F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 6).cast("int")), lambda i: i.cast("string"))
    return t("part").select("p_partkey", F.size(fields.repeated(own, 2)).cast("long").alias("records"))
