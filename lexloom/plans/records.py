"""Queries on typed records, layered lookups, ranges and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline, records, rules, schemas, trees
from ..sources import text as source
from .registry import query

_SCHEMA = {"Name": "s", "Size": "v", "Price": "f", "Code": "x", "Flag": "B", "Kind": "e", "List": "*u"}
_CHOICES = {"Kind": [f"Brand#{i}{j}" for i in range(1, 5) for j in range(1, 6)]}
_CHOICES_SQL = ", ".join(f"'{x}'" for x in _CHOICES["Kind"])


def _record_files(t):
    """Sections of 50 parts to a file, some with faults."""
    p, k = t("part"), F.col("p_partkey")
    rows = [
        F.concat(F.lit("["), k, F.lit("]")),
        F.concat(F.lit("Name = "), "p_name"),
        F.concat(F.lit("Size = "), F.when(k % 10 == 0, F.lit(0)).otherwise(F.col("p_size"))),
        F.concat(F.lit("Price="), F.format_string("%.2f", F.lit(1.0) * (k % 1000))),
        F.concat(F.lit("Code = "), F.lower(F.hex(k))),
        F.concat(F.lit("Flag = "), F.when(k % 4 == 0, "y").when(k % 4 == 1, "no").when(k % 4 == 2, "").otherwise("true")),
        F.concat(F.lit("Kind = "), "p_brand"),
        F.concat(F.lit("List = "), k % 7, F.lit(","), F.when(k % 9 == 0, "-1").otherwise("3")),
        F.lit("# end"),
    ]
    each = p.select((k % 40).alias("file"), k.alias("k"), F.concat_ws("\n", *rows).alias("r"))
    joined = each.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "r")))["r"], "\n").alias("text"))
    return source.lines(joined, "file")


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS section, p_name AS "Name", CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS "Size", CAST(p_partkey % 1000 AS DOUBLE) AS "Price", p_partkey AS "Code",
  CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 1 THEN false ELSE true END AS "Flag", CASE WHEN p_brand IN ({_CHOICES_SQL}) THEN p_brand END AS "Kind",
  (p_partkey % 7) || ',' || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '3' END AS list,
  array_to_string(list_filter([CASE WHEN p_partkey % 10 = 0 THEN 'Size:invalid' END, CASE WHEN p_brand NOT IN ({_CHOICES_SQL}) THEN 'Kind:invalid' END, CASE WHEN p_partkey % 9 = 0 THEN 'List:invalid' END], lambda x: x IS NOT NULL), ' ') AS errors FROM part""")
def typed_records(t):
    """Sections read by a schema of field codes, with the errors of each record."""
    made = records.typed_records(source.key_values(_record_files(t), "file"), ["file", "section"], _SCHEMA, _CHOICES)
    listed = F.array_join(F.transform("List", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
    return made.select("section", "Name", "Size", "Price", "Code", "Flag", "Kind", listed.alias("list"), F.array_join("errors", " ").alias("errors"))


@query("SELECT p_partkey, 'Name = ' || p_name || chr(10) || 'Size = ' || p_size || chr(10) || 'Brand = ' || CASE WHEN p_partkey % 3 = 0 THEN '\"' || p_brand || ',\"' ELSE p_brand END AS text FROM part")
def record_writer(t):
    """Records as text, fields quoted where they must be."""
    brand = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(","))).otherwise(F.col("p_brand"))
    schema = {"Name": "s", "Size": "v", "Brand": "s"}
    return t("part").select("p_partkey", records.encode_record(schema, {"Name": F.col("p_name"), "Size": F.col("p_size"), "Brand": brand}).alias("text"))


@query("SELECT c_custkey, c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END AS ref FROM customer WHERE c_custkey % 50 = 0")
def foreign_key_check(t):
    ref = F.col("c_nationkey") + F.when(F.col("c_custkey") % 50 == 0, 100).otherwise(0)
    return records.missing_keys(t("customer").select("c_custkey", ref.alias("ref")), "ref", t("nation"), "n_nationkey").select("c_custkey", "ref")


_STEPS = "SELECT CAST(l AS INT) AS level, CAST(l * l * l * 4 AS DOUBLE) AS least FROM (SELECT unnest(range(0, 100)) AS l)"


@query(f"WITH s AS ({_STEPS}) SELECT o_orderkey, max(level) AS level FROM orders JOIN s ON s.least <= o_totalprice GROUP BY o_orderkey")
def level_lookup(t):
    """The largest level whose threshold a value reaches."""
    orders = t("orders")
    steps = orders.sparkSession.range(100).select(F.col("id").cast("int").alias("level"), (F.col("id") * F.col("id") * F.col("id") * 4).cast("double").alias("least"))
    return records.range_lookup(orders.select("o_orderkey", "o_totalprice"), "o_totalprice", steps, "least", "level").select("o_orderkey", "level")


@query("WITH s AS (SELECT DISTINCT o_totalprice AS low FROM orders) SELECT l_orderkey, l_linenumber, low AS below FROM lineitem ASOF JOIN s ON l_extendedprice * 5 >= low")
def as_of_lookup(t):
    """The same over many thresholds, by one sort of both sides."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 5).alias("v"))
    steps = t("orders").select(F.col("o_totalprice").alias("low"), F.col("o_totalprice").alias("below"))
    return records.as_of(rows, "v", steps, "low", "below", buckets=32).where("below is not null").select("l_orderkey", "l_linenumber", "below")


_TREE = "SELECT c_custkey AS id, CASE WHEN c_custkey > 3 THEN c_custkey // 3 END AS parent_id, c_custkey AS ord, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS v FROM customer"


def _tree(t):
    k = F.col("c_custkey")
    return t("customer").select(k.alias("id"), F.when(k > 3, F.floor(k / 3)).alias("parent_id"), k.alias("ord"), F.when(k % 5 == 0, F.col("c_mktsegment")).alias("v")).where("id > 0")


@query(f"WITH RECURSIVE n AS (SELECT * FROM ({_TREE}) WHERE id > 0), d(root, id, depth) AS (SELECT id, id, 0 FROM n WHERE parent_id IS NULL UNION ALL SELECT d.root, n.id, d.depth + 1 FROM d JOIN n ON n.parent_id = d.id) SELECT root, CAST(depth AS INT) AS depth, count(*) AS n FROM d GROUP BY ALL")
def descendants(t):
    return trees.placed(_tree(t)).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE n AS (SELECT * FROM ({_TREE}) WHERE id > 0), d(id, path) AS (SELECT id, lpad(CAST(ord AS VARCHAR), 10, '0') FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, d.path || '/' || lpad(CAST(n.ord AS VARCHAR), 10, '0') FROM d JOIN n ON n.parent_id = d.id) SELECT id, path FROM d")
def preorder(t):
    """Sort paths: their order is that of a walk of the forest."""
    return trees.walk_down(_tree(t)).select("id", "path")


@query(f"WITH RECURSIVE n AS (SELECT * FROM ({_TREE}) WHERE id > 0), u(id, a, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT u.id, n.parent_id, u.depth + 1 FROM u JOIN n ON n.id = u.a WHERE n.parent_id IS NOT NULL) SELECT id, max(depth) AS depth, arg_max(a, depth) AS root FROM u GROUP BY id")
def root_ancestor(t):
    return trees.placed(_tree(t))


@query(f"WITH RECURSIVE n AS (SELECT * FROM ({_TREE}) WHERE id > 0), u(id, a, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT u.id, n.parent_id, u.depth + 1 FROM u JOIN n ON n.id = u.a WHERE n.parent_id IS NOT NULL) SELECT id, a AS ancestor, CAST(depth AS INT) AS depth FROM u")
def all_ancestors(t):
    """Each customer and all above it."""
    return trees.ancestors(_tree(t))


# Orders of a customer as a chain by date, a third of them cut off and begun anew.
_CHAINS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS parent_id, o_orderkey % 7 AS ord, o_orderpriority AS v FROM orders"


def _chains(t):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t("orders").select(k.alias("id"), F.when(k % 3 > 0, before).alias("parent_id"), (k % 7).alias("ord"), F.col("o_orderpriority").alias("v"))


@query(f"WITH RECURSIVE n AS ({_CHAINS}), d(id, depth, path) AS (SELECT id, 0, [ord, id] FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, d.depth + 1, list_concat(d.path, [n.ord, n.id]) FROM d JOIN n ON n.parent_id = d.id) SELECT id, CAST(depth AS INT) AS depth, row_number() OVER (ORDER BY path) - 1 AS place FROM d")
def preorder_places(t):
    """The walk of a forest of all orders, numbered by sizes of subtrees."""
    return trees.preorder(_chains(t))


@query(f"WITH RECURSIVE n AS ({_CHAINS}), u(id, a, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT u.id, n.parent_id, u.depth + 1 FROM u JOIN n ON n.id = u.a JOIN n p ON p.id = n.parent_id WHERE p.v <> '1-URGENT') SELECT id, arg_max(a, depth) AS root FROM u GROUP BY id")
def conditional_roots(t):
    """How far up an order's chain one gets without a step to an urgent one."""
    return trees.roots_where(_chains(t), F.col("v") != "1-URGENT")


@query(f"WITH RECURSIVE n AS (SELECT * FROM ({_TREE}) WHERE id > 0), u(id, a, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT u.id, n.parent_id, u.depth + 1 FROM u JOIN n ON n.id = u.a WHERE n.parent_id IS NOT NULL) SELECT u.id, arg_min(n.v, depth) FILTER (WHERE n.v IS NOT NULL) AS v FROM u JOIN n ON n.id = u.a GROUP BY u.id")
def inherited_values(t):
    return trees.inherited(_tree(t), "v")


_OLD = "SELECT 's' || doc_id % 3 AS script, doc_id AS fn, sha1(text) AS fp FROM documents WHERE doc_id % 4 <> 0"
_NEW = "SELECT 's' || CASE WHEN doc_id % 5 = 0 THEN (doc_id + 1) % 3 ELSE doc_id % 3 END AS script, doc_id AS fn, sha1(CASE WHEN doc_id % 8 = 3 OR doc_id % 20 = 5 THEN text || '!' ELSE text END) AS fp FROM documents WHERE doc_id % 10 <> 1"
_COMPARED = f"SELECT coalesce(a.script, b.script) AS script, coalesce(a.fn, b.fn) AS fn, CASE WHEN a.fp IS NULL THEN 'added' WHEN b.fp IS NULL THEN CASE WHEN c.fp IS NULL THEN 'missing' WHEN c.fp = a.fp THEN 'moved' ELSE 'changed' END WHEN a.fp = b.fp THEN 'same' ELSE 'changed' END AS status FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.script = b.script AND a.fn = b.fn LEFT JOIN ({_NEW}) c ON c.fn = a.fn"


def _compared(t):
    d, k = t("documents"), F.col("doc_id")
    script = lambda x: F.concat(F.lit("s"), x % 3)
    old = d.where("doc_id % 4 <> 0").select(script(k).alias("script"), k.alias("fn"), baseline.fingerprint(F.col("text")).alias("fp"))
    text = F.when((k % 8 == 3) | (k % 20 == 5), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where("doc_id % 10 <> 1").select(script(F.when(k % 5 == 0, k + 1).otherwise(k)).alias("script"), k.alias("fn"), baseline.fingerprint(text).alias("fp"))
    return baseline.compare(old, new)


@query(_COMPARED)
def baseline_compare(t):
    """Fingerprints of a baseline against those of a later state: same, changed, moved, missing or added."""
    return _compared(t)


@query(f"SELECT status, count(*) AS n, count(DISTINCT script) AS scripts FROM ({_COMPARED}) GROUP BY status")
def baseline_totals(t):
    return baseline.compare_totals(_compared(t))


@query("SELECT source AS version, avg(CASE WHEN a.fp = b.fp THEN 1.0 ELSE 0.0 END) AS overlap FROM (SELECT source, lang, doc_id % 50 AS k, min(sha1(text)) AS fp FROM documents GROUP BY ALL) a LEFT JOIN (SELECT lang, doc_id % 50 AS k, min(sha1(text)) AS fp FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) b USING (lang, k) GROUP BY source")
def baseline_overlap(t):
    """Share of each version's functions that a state has with equal fingerprints."""
    d = t("documents").withColumn("fp", F.sha1("text"))
    versions = d.groupBy(F.col("source").alias("version"), F.col("lang").alias("script"), (F.col("doc_id") % 50).alias("fn")).agg(F.min("fp").alias("fp"))
    state = d.where("doc_id % 2 = 0").groupBy(F.col("lang").alias("script"), (F.col("doc_id") % 50).alias("fn")).agg(F.min("fp").alias("fp"))
    return baseline.overlap(versions, state)


@query("SELECT page_id, regexp_replace(trim(url), '\\s{2,}', ' ', 'g') || ' (' || page_id || ')' AS line FROM pages")
def positional_format(t):
    return t("pages").select("page_id", rules.positional(F.lit("{1} ({2})"), rules.squeeze_key(F.col("url")), F.col("page_id")).alias("line"))


_ORDER_SCHEMA = {
    "Customer": "u",
    "Status": ("e", "Status"),
    "Price": "f",
    "Lines": ("*uvE", "Flag"),
    "Suppliers": ("*e", "Supplier"),
    "Note": "sq",
    "Date": "^x",
}
#: A part of the statuses is left out, so that some are undefined.
_ORDER_ENUMS = {"Status": ["O", "F"], "Flag": {"A": 10, "N": 20}}


def _order_records(t):
    """Rows (o_orderkey, place, name, value) of a record for each order."""
    line = F.col("l_linenumber")
    lines = t("lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(line, F.concat_ws(",", "l_partkey", F.col("l_quantity").cast("int"), "l_returnflag").alias("x"), F.concat(F.lit("S"), "l_suppkey").alias("s")))).alias("l")
    )
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    values = {
        "Customer": F.col("o_custkey").cast("string"),
        "Status": F.col("o_orderstatus"),
        "Price": F.col("o_totalprice").cast("string"),
        "Lines": F.array_join("l.x", ","),
        "Suppliers": F.array_join("l.s", " , "),
        "Note": F.concat(F.lit(' "'), "o_orderpriority", F.lit(', \\"x\\"" , rest, of "'), "o_orderstatus"),
        "Date": F.lower(F.hex("o_custkey")),
        "Unknown": F.lit("1"),
    }
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(values.items())]
    again = F.struct(F.lit(99).alias("place"), F.lit("Date").alias("name"), F.lit("xyz").alias("value"))
    return o.select("o_orderkey", F.explode(F.array(*rows, again)).alias("r")).select("o_orderkey", "r.*")


def _order_enums(t):
    return _ORDER_ENUMS | {"Supplier": t("supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("id"))}


_ORDERS_SQL = """
WITH l AS (
  SELECT l_orderkey, array_agg({'p': l_partkey, 'q': CAST(l_quantity AS BIGINT), 'f': l_returnflag, 's': l_suppkey, 'known': s_acctbal > 0} ORDER BY l_linenumber, l_partkey || ',' || CAST(l_quantity AS BIGINT) || ',' || l_returnflag, 'S' || l_suppkey) AS l
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey
)
SELECT o_orderkey, o_custkey AS customer, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS status, o_totalprice AS price,
  array_to_string(list_transform(l, lambda x: x.p || '/' || x.q || '/' || coalesce(CASE x.f WHEN 'A' THEN '10' WHEN 'N' THEN '20' END, '')), ' ') AS lines,
  array_to_string(list_transform(l, lambda x: CASE WHEN x.known THEN 'S' || x.s ELSE '-' END), ' ') AS suppliers,
  o_orderpriority || ', "x"' AS note, ' rest, of "' || o_orderstatus AS rest, o_custkey AS date,
  len(list_filter(l, lambda x: NOT x.known)) + CASE WHEN o_orderstatus IN ('O', 'F') THEN 0 ELSE 1 END + 1 AS errors
FROM orders JOIN l ON l_orderkey = o_orderkey
"""


@query(_ORDERS_SQL)
def compound_records(t):
    """Records of compound, repeated and enumerated fields, read by a schema and checked against a table."""
    made = schemas.read_records(_order_records(t), ["o_orderkey"], _ORDER_SCHEMA, _order_enums(t))
    lines = F.transform(F.col("Lines"), lambda x: F.concat(x["f0"], F.lit("/"), x["f1"], F.lit("/"), F.coalesce(x["f2"].cast("string"), F.lit(""))))
    return made.select(
        "o_orderkey",
        F.col("Customer").alias("customer"),
        F.col("Status").alias("status"),
        F.col("Price").alias("price"),
        F.array_join(lines, " ").alias("lines"),
        F.array_join(F.transform("Suppliers", lambda x: F.coalesce(x, F.lit("-"))), " ").alias("suppliers"),
        F.col("Note.f0").alias("note"),
        F.col("Note.f1").alias("rest"),
        F.col("Date")[0].alias("date"),
        F.size("errors").cast("long").alias("errors"),
    )


@query("""
SELECT o_orderkey, 'Customer = ' || (o_custkey + 1) || CASE WHEN o_orderstatus IN ('O', 'F') THEN chr(10) || 'Status = ' || o_orderstatus ELSE '' END
  || chr(10) || 'Lines = ' || string_agg(l_partkey || ',' || CAST(l_quantity AS BIGINT) || ',' || CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE '' END, ',' ORDER BY l_linenumber, l_partkey || ',' || CAST(l_quantity AS BIGINT) || ',' || l_returnflag, 'S' || l_suppkey)
  || chr(10) || 'Note = "' || o_orderpriority || ', \\"x\\"", rest, of "' || o_orderstatus || chr(10) || 'Date = ' || upper(to_hex(o_custkey)) || chr(10) || 'Date = ' AS text
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderpriority""")
def compound_records_written(t):
    """The same records read, changed and written back."""
    schema = {k: v for k, v in _ORDER_SCHEMA.items() if k not in ("Price", "Suppliers")}
    made = schemas.read_records(_order_records(t), ["o_orderkey"], schema, _ORDER_ENUMS)
    changed = made.withColumn("Customer", F.col("Customer") + 1)
    return changed.select("o_orderkey", schemas.write_records(changed, schema, _ORDER_ENUMS).alias("text"))


def _scripts(t):
    """A script of each document: two functions of one name in two classes and one of the module, with comments that count and that don't."""
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    # fmt: off
    text = F.concat(
        F.lit("module Top\n  class A"), (k % 3).cast("string"), F.lit("\n    def run\n      if size > "), n, F.lit(" # goes\n\n        x.each do |y|\n          # goes too\n        end\n      end\n    end\n  end\n"),
        F.lit("  class B\n    def run\n      name = '#"), "lang", F.lit("' # stays\n    end\n  end\n  def size\n    "), n, F.lit("\n  end\n  def one; 1; end\nend\n"),
    )
    # fmt: on
    return t("documents").select(k.alias("script"), text.alias("text"), n.alias("n"))


@query("""
SELECT script, fn, left(sha1(body), 12) AS fp FROM (
  SELECT doc_id AS script, 'Top.A' || doc_id % 3 || '.run' AS fn, 'if size > ' || n_chars || chr(10) || 'x.each do |y|' || chr(10) || 'end' || chr(10) || 'end' AS body, lang FROM documents
  UNION ALL SELECT doc_id, 'Top.B.run', 'name = ''#' || lang || ''' # stays', lang FROM documents
  UNION ALL SELECT doc_id, 'Top.size', CAST(n_chars AS VARCHAR), lang FROM documents) WHERE lang IS NOT NULL AND body IS NOT NULL""")
def scanned_functions(t):
    """Functions of scripts by qualified names, with fingerprints of their bodies."""
    return baseline.scan_functions(_scripts(t).select("script", "text"))


@query("SELECT doc_id AS script, strlen(CAST(n_chars AS VARCHAR)) AS longer FROM documents WHERE lang IS NOT NULL")
def replaced_functions(t):
    """By how many bytes scripts grow when a function is replaced by one that has its number twice."""
    new = F.concat(F.lit("  def size\n    "), "n", "n", F.lit("\n  end"))
    made = baseline.replaced_function(F.col("text"), F.lit("Top.size"), new)
    return _scripts(t).where("text is not null").select("script", (F.octet_length(made) - F.octet_length("text")).cast("long").alias("longer"))
