"""Queries and oracles of digests, comparisons, scans, file layout and module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.operators import compare as cp, digest as dg, graph, scan
from auditframe.operators import lifecycle as lc
from auditframe.plans.contracts import DAY, TABLE_COLUMNS, contracts, export, record
from auditframe.plans.ledger import whole_ledgers
from auditframe.plans.registry import query
from auditframe.plans.views import frame, remembered, sql_with, view
from auditframe.session import cut_lineage, scratch_path
from auditframe.sources import delimited as dl, layout as ly
from auditframe.sources.ledger import read_ledger
from auditframe.sources.records import assemble_records, in_blocks

# --- K: digests --------------------------------------------------------------------------------------------------------

KEYS = ["id", "row_index"]
view("s_small", """
SELECT o_orderkey AS row_index, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_orderpriority || chr(92) || CAST(o_custkey AS STRING) END AS id, o_totalprice / 7 AS price,
  CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS flag, o_orderstatus AS status FROM orders
""")
_COLS = ["row_index", "id", "price", "day", "flag", "status"]
_TEXT = {
    "row_index": "CASE WHEN row_index = 0 THEN '0.00000000e+00' ELSE printf('%.8e', row_index::DOUBLE) END", "id": "coalesce(replace(id, chr(92), chr(92) || chr(92)), 'NA')",
    "price": "printf('%.8e', price)", "day": "CAST(day - DATE '1970-01-01' AS VARCHAR)", "flag": "CASE WHEN flag IS NULL THEN 'NA' WHEN flag THEN 'true' ELSE 'false' END", "status": "status",
}
_ORDER = "id NULLS LAST, row_index"


def _column_sql(by: str = "", block: int = dg.BLOCK_ROWS) -> str:
    """Columns as hash trees of two levels at most: enough for block * block rows."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    placed = f"(SELECT *, row_number() OVER ({part}ORDER BY {_ORDER}) - 1 AS p, count(*) OVER ({part}) AS n FROM s_small)"
    return "\nUNION ALL ".join(
        f"""SELECT {lead}{i} AS ord, '{c}' AS "column", n AS rows, sha256('col' || chr(10) || '{c}' || chr(10) || CAST(n AS VARCHAR) || chr(10) || string_agg(h, chr(10) ORDER BY b)) AS digest FROM (
  SELECT {lead}n, p // {block} AS b, CASE WHEN n <= {block} THEN string_agg({_TEXT[c]}, chr(10) ORDER BY p) ELSE sha256(string_agg({_TEXT[c]}, chr(10) ORDER BY p)) END AS h FROM {placed} x GROUP BY {lead}n, p // {block}) y GROUP BY {lead}n"""
        for i, c in enumerate(_COLS) if c != by
    )


def _object_sql(by: str = "") -> str:
    n = len(_COLS) - (1 if by else 0)
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by} AS entry, " if by else ""
    return f"""SELECT {lead}min(rows) AS rows, {n} AS cols, sha256('obj' || chr(10) || 'frame' || chr(10) || CAST(min(rows) AS VARCHAR) || chr(10) || '{n}' || chr(10) || string_agg("column" || '=' || digest, chr(10) ORDER BY ord)) AS digest FROM ({_column_sql(by)}) c{group}"""


def small(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "s_small")


@query("k1_canonical_order", sql_with("o_book", body="SELECT id, row_index, row_number() OVER (ORDER BY id NULLS LAST, row_index) AS position FROM o_book"))
def k1(spark, sf):
    return dg.canonical_order(record(spark, sf).select("id", "row_index"), KEYS)


@query("k2_order_violations", sql_with("v_contracts", body="SELECT BSV, count(*) AS rows FROM v_contracts GROUP BY BSV HAVING count(*) > 1"))
def k2(spark, sf):
    return dg.order_violations(contracts(spark, sf), ["BSV"])


@query("k3_column_digests", sql_with("s_small", body=f'SELECT "column", rows, digest FROM ({_column_sql()}) x'))
def k3(spark, sf):
    return dg.column_digests(small(spark, sf), KEYS)


@query("k3_book_column_digests")
def k3b(spark, sf):
    return dg.column_digests(record(spark, sf), KEYS)


@query("k4_object_digest", sql_with("s_small", body=f"SELECT *, '{dg.CANONICALISATION}' AS canonicalisation FROM ({_object_sql()}) x"))
def k4(spark, sf):
    return dg.object_digest(small(spark, sf), KEYS)


@query("k5_keyed_digests", sql_with("s_small", body=_object_sql("status")))
def k5(spark, sf):
    return dg.keyed_digests(small(spark, sf), "status", KEYS)


@query("k5_keyed_list_digest", sql_with("s_small", body=f"SELECT sha256(string_agg(entry || '=' || digest, chr(10) ORDER BY entry)) AS digest, count(*) AS entries FROM ({_object_sql('status')}) x"))
def k5b(spark, sf):
    return dg.keyed_list_digest(dg.keyed_digests(small(spark, sf), "status", KEYS))


_FIELDS = " || ',' || ".join(f"'{c}=' || {_TEXT[c]}" for c in sorted(_COLS))


@query("k6_probes", sql_with("s_small", body=f"""SELECT selection_rule, fields FROM (SELECT *, {_FIELDS} AS fields FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS p, count(*) OVER () AS n FROM s_small) a) b
JOIN (VALUES ('index:1'), ('index:ceil(n/2)'), ('index:n')) r(selection_rule) ON p = CASE selection_rule WHEN 'index:1' THEN 1 WHEN 'index:n' THEN n ELSE CAST(ceil(n / 2) AS BIGINT) END"""))
def k6(spark, sf):
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return dg.probes(small(spark, sf), KEYS).select("selection_rule", F.array_join(pairs, ",").alias("fields"))


@query("k7_coverage", sql_with("s_small", body="""SELECT count(*) AS row_count, 6 AS field_count, count(*) FILTER (id IS NULL) + count(*) FILTER (flag IS NULL) AS null_count,
  CASE WHEN least(min(row_index), min(price)) = 0 THEN '0.00000000e+00' ELSE printf('%.8e', least(min(row_index), min(price))) END AS min, printf('%.8e', greatest(max(row_index), max(price))) AS max FROM s_small"""))
def k7(spark, sf):
    return dg.coverage(small(spark, sf))


view("v_inputs", "SELECT n_name AS name, n_name || ',' || CAST(n_nationkey AS STRING) || ',' || CAST(n_regionkey AS STRING) AS content FROM nation")
_FIRST = ", ".join(f"{c} := {_TEXT[c]}" for c in _COLS)


@query("k8_checkpoint", sql_with("s_small", "v_inputs", body=f"""
SELECT 'U01' AS unit, 'orders_view' AS name, 'frame' AS kind, o.rows, o.cols, '{",".join(_COLS)}' AS colnames, 'id asc,row_index asc' AS canonical_order, 'SHA-256 {dg.CANONICALISATION} ' || o.digest AS digest,
  (SELECT CAST(count(*) AS VARCHAR) || ' {len(_COLS)} ' || CAST(count(*) FILTER (id IS NULL) + count(*) FILTER (flag IS NULL) AS VARCHAR) || ' ' || CASE WHEN least(min(row_index), min(price)) = 0 THEN '0.00000000e+00' ELSE printf('%.8e', least(min(row_index), min(price))) END || ' ' || printf('%.8e', greatest(max(row_index), max(price))) FROM s_small) AS coverage,
  (SELECT string_agg(selection_rule || ' ' || CAST(to_json(struct_pack({_FIRST})) AS VARCHAR), ' ' ORDER BY selection_rule) FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS p, count(*) OVER () AS n FROM s_small) a
    JOIN (VALUES ('index:1'), ('index:ceil(n/2)'), ('index:n')) r(selection_rule) ON p = CASE selection_rule WHEN 'index:1' THEN 1 WHEN 'index:n' THEN n ELSE CAST(ceil(n / 2) AS BIGINT) END) AS probes,
  (SELECT string_agg(name || ' ' || CAST(strlen(content) AS VARCHAR) || ' ' || sha256(content), ' ' ORDER BY name) FROM v_inputs) AS inputs
FROM ({_object_sql()}) o"""))
def k8(spark, sf):
    content = F.encode("content", "UTF-8")
    inputs = frame(spark, sf, "v_inputs").select("name", F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"))
    row = dg.checkpoint(small(spark, sf), "orders_view", KEYS, inputs)
    listed = lambda column, *names: F.array_join(F.transform(column, lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in names])), " ")
    return row.select(
        "unit", "name", "kind", "rows", "cols", F.array_join("colnames", ",").alias("colnames"), F.array_join(F.transform("canonical_order", lambda k: F.concat_ws(" ", k["column"], k["direction"])), ",").alias("canonical_order"),
        F.concat_ws(" ", "digest.algorithm", "digest.canonicalisation", "digest.value").alias("digest"), F.concat_ws(" ", *[F.col(f"coverage.{c}").cast("string") for c in ("row_count", "field_count", "null_count", "min", "max")]).alias("coverage"),
        listed("probes", "selection_rule", "fields").alias("probes"), listed("inputs", "name", "bytes", "sha256").alias("inputs"),
    )


_BLOCK = 1000


def _tree_sql(block: int) -> str:
    """Column digests as hash trees of as many levels as the rows need."""
    head = """'col' || chr(10) || "column" || chr(10) || CAST(rows AS VARCHAR) || chr(10)"""
    hashed = lambda size, lines, order: f"sha256(CASE WHEN {size} <= {block} THEN {head} ELSE '' END || string_agg({lines}, chr(10) ORDER BY {order}))"
    cells = "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", n AS rows, p, {_TEXT[c]} AS cell FROM placed""" for c in _COLS)
    return f"""WITH RECURSIVE placed AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS p, count(*) OVER () AS n FROM s_small),
tree AS (SELECT "column", rows, (rows + {block - 1}) // {block} AS items, p // {block} AS b, {hashed("rows", "cell", "p")} AS h FROM ({cells}) x GROUP BY "column", rows, p // {block}
  UNION ALL SELECT "column", rows, (items + {block - 1}) // {block}, b // {block}, {hashed("items", "h", "b")} FROM tree WHERE items > 1 GROUP BY "column", rows, items, b // {block})
SELECT "column", rows, h AS digest, '{dg.CELLS}/blocks-{block}' AS canonicalisation FROM tree WHERE items = 1"""


@query("k9_block_digests", sql_with("s_small", body=_tree_sql(_BLOCK)))
def k9(spark, sf):
    return dg.block_digests(small(spark, sf), KEYS, block_rows=_BLOCK)


# --- L: comparisons ----------------------------------------------------------------------------------------------------

view("v_table_a", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
view("v_table_b", """
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 89 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 211 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 97 <> 0 AND c_nationkey <> 3
UNION ALL SELECT 10000000 + c_custkey, c_name || ' new', 25, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 101 = 0
""")


@remembered
def objects_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One checkpoint object per nation of a customer table."""
    df = frame(spark, sf, name)
    numbers = df.groupBy(F.col("c_nationkey").cast("string").alias("entry")).agg(
        F.count_if(F.col("c_mktsegment").isNull()).alias("null_count"), F.min(F.col("c_custkey")).alias("min"), F.max(F.col("c_custkey")).alias("max")
    )
    digests = dg.keyed_digests(df, "c_nationkey", ["c_custkey"], ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]).join(numbers, "entry")
    return digests.select(
        F.lit("U01").alias("unit"), F.concat(F.lit("customers["), "entry", F.lit("]")).alias("object"), "rows", "cols", F.lit("c_custkey,c_name,c_acctbal,c_mktsegment").alias("colnames"),
        "null_count", "min", "max", "digest", F.lit(dg.CANONICALISATION).alias("canonicalisation"),
    )


@remembered
def probes_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """First, middle and last row of each object, by its own key, as canonical text."""
    found = dg.keyed_probes(frame(spark, sf, name), "c_nationkey", ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])
    return found.select(F.lit("U01").alias("unit"), F.concat(F.lit("customers["), "entry", F.lit("]")).alias("object"), "selection_rule", "fields")


def _digest_of(table: str) -> str:
    bal = "CASE WHEN c_acctbal = 0 THEN '0.00000000e+00' ELSE printf('%.8e', c_acctbal) END"
    key = "CASE WHEN c_custkey = 0 THEN '0.00000000e+00' ELSE printf('%.8e', c_custkey::DOUBLE) END"
    texts = {"c_custkey": key, "c_name": "c_name", "c_acctbal": bal, "c_mktsegment": "coalesce(c_mktsegment, 'NA')"}
    cols = " || chr(10) || ".join(
        f"'{c}=' || sha256('col' || chr(10) || '{c}' || chr(10) || CAST(count(*) AS VARCHAR) || chr(10) || string_agg({t}, chr(10) ORDER BY c_custkey))" for c, t in texts.items()
    )
    return f"""SELECT 'U01' AS unit, 'customers[' || CAST(c_nationkey AS VARCHAR) || ']' AS object, count(*) AS rows, 4 AS cols, count(*) FILTER (c_mktsegment IS NULL) AS null_count, min(c_custkey) AS mn, max(c_custkey) AS mx,
  sha256('obj' || chr(10) || 'frame' || chr(10) || CAST(count(*) AS VARCHAR) || chr(10) || '4' || chr(10) || {cols}) AS digest FROM {table} GROUP BY c_nationkey"""


_A, _B = _digest_of("v_table_a"), _digest_of("v_table_b")
AB = ("v_table_a", "v_table_b")


def _bound(spark: SparkSession, sf: str, shift: int) -> DataFrame:
    """Input bindings taken from the documents table: name, size and hash of the text."""
    docs = frame(spark, sf, "documents")
    size = F.when(F.col("doc_id") % 50 == shift, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), size.alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query("l1_inputs_match", "SELECT count(*) FILTER (doc_id % 50 = 7) AS only_a, count(*) FILTER (doc_id % 50 = 7) AS only_b, count(*) FILTER (doc_id % 50 = 7) = 0 AS inputs_match FROM documents")
def l1(spark, sf):
    return cp.inputs_match(_bound(spark, sf, -1), _bound(spark, sf, 7))


@query("l2_object_keys_diff", sql_with(*AB, body=f"SELECT unit, object, CASE WHEN b.object IS NULL THEN 'only_source' WHEN a.object IS NULL THEN 'only_target' ELSE 'common' END AS side FROM (SELECT unit, object FROM ({_A}) x) a FULL OUTER JOIN (SELECT unit, object FROM ({_B}) y) b USING (unit, object)".replace("SELECT unit, object, CASE WHEN b.object IS NULL", "SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.object, b.object) AS object, CASE WHEN b.object IS NULL").replace("USING (unit, object)", "ON a.unit = b.unit AND a.object = b.object")))
def l2(spark, sf):
    return cp.object_keys_diff(objects_of(spark, sf, "v_table_a"), objects_of(spark, sf, "v_table_b"))


@query("l3_digest_compare", sql_with(*AB, body=f"SELECT a.unit, a.object, a.digest = b.digest AS agree FROM ({_A}) a JOIN ({_B}) b ON a.object = b.object"))
def l3(spark, sf):
    return cp.digest_compare(objects_of(spark, sf, "v_table_a"), objects_of(spark, sf, "v_table_b"))


_PAIR = f"(SELECT a.unit, a.object, a.rows AS r1, b.rows AS r2, a.null_count AS n1, b.null_count AS n2, a.mn AS m1, b.mn AS m2, a.mx AS x1, b.mx AS x2 FROM ({_A}) a JOIN ({_B}) b ON a.object = b.object WHERE a.digest <> b.digest)"


def _probe_sql(table: str) -> str:
    key = "CASE WHEN c_custkey = 0 THEN '0.00000000e+00' ELSE printf('%.8e', c_custkey::DOUBLE) END"
    return f"""(SELECT 'customers[' || CAST(c_nationkey AS VARCHAR) || ']' AS object, rule, {key} AS c_custkey, c_name, coalesce(c_mktsegment, 'NA') AS c_mktsegment
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM {table}) t
  JOIN (VALUES ('index:1'), ('index:ceil(n/2)'), ('index:n')) r(rule) ON p = CASE rule WHEN 'index:1' THEN 1 WHEN 'index:n' THEN n ELSE CAST(ceil(n / 2) AS BIGINT) END)"""


_PROBED = "\nUNION ALL ".join(f"SELECT p.unit, p.object, 'probe' AS what, a.rule || ' {c}' AS item, a.{c} AS source, b.{c} AS target FROM {_PAIR} p JOIN {_probe_sql('v_table_a')} a ON a.object = p.object JOIN {_probe_sql('v_table_b')} b ON b.object = p.object AND b.rule = a.rule" for c in ("c_custkey", "c_name", "c_mktsegment"))


@query("l4_localise", sql_with(*AB, body="SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT unit, object, 'shape' AS what, '{item}' AS item, CAST({x} AS VARCHAR) AS source, CAST({y} AS VARCHAR) AS target FROM {_PAIR} p"
    for item, x, y in [("rows", "r1", "r2"), ("null_count", "n1", "n2"), ("min", "m1", "m2"), ("max", "x1", "x2")]) + f"\nUNION ALL {_PROBED}) z WHERE source IS DISTINCT FROM target"))
def l4(spark, sf):
    return cp.localise(objects_of(spark, sf, "v_table_a"), objects_of(spark, sf, "v_table_b"), probes_of(spark, sf, "v_table_a"), probes_of(spark, sf, "v_table_b"))


@query("l5_compare_outcome", sql_with(*AB, body=f"""SELECT true AS inputs_match, count(*) FILTER (b.object IS NULL) AS only_source, count(*) FILTER (a.object IS NULL) AS only_target, count(*) FILTER (a.digest = b.digest) AS agree,
  count(*) FILTER (a.digest <> b.digest) AS differ, CASE WHEN count(*) FILTER (b.object IS NULL OR a.object IS NULL) > 0 THEN 2 WHEN count(*) FILTER (a.digest <> b.digest) > 0 THEN 1 ELSE 0 END AS outcome
FROM ({_A}) a FULL OUTER JOIN ({_B}) b ON a.object = b.object"""))
def l5(spark, sf):
    a, b = objects_of(spark, sf, "v_table_a"), objects_of(spark, sf, "v_table_b")
    return cp.compare_outcome(cp.inputs_match(_bound(spark, sf, -1), _bound(spark, sf, -1)), cp.object_keys_diff(a, b), cp.digest_compare(a, b))


@query("l6_compare_many", sql_with(*AB, body=f"""SELECT 'copy' AS target, count(*) AS agree, 0 AS differ, 0 AS missing, 0 AS unexpected, true AS agrees FROM ({_A}) a
UNION ALL SELECT 'revised', count(*) FILTER (a.digest = b.digest), count(*) FILTER (a.digest <> b.digest), count(*) FILTER (b.object IS NULL), count(*) FILTER (a.object IS NULL), false FROM ({_A}) a FULL OUTER JOIN ({_B}) b ON a.object = b.object"""))
def l6(spark, sf):
    a = objects_of(spark, sf, "v_table_a")
    return cp.compare_many(a, {"copy": a, "revised": objects_of(spark, sf, "v_table_b")})


_BAL = "CASE WHEN {0} = 0 THEN '0.00000000e+00' ELSE printf('%.8e', {0}::DOUBLE) END"


@query("l7_table_diff", sql_with(*AB, body="SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT c_custkey, 'changed' AS change, '{c}' AS field, {t.format('a.' + c)} AS source, {t.format('b.' + c)} AS target FROM v_table_a a JOIN v_table_b b USING (c_custkey) WHERE a.{c} IS DISTINCT FROM b.{c}" for c, t in [
        ("c_name", "{0}"), ("c_nationkey", _BAL), ("c_acctbal", _BAL), ("c_mktsegment", "coalesce({0}, 'NA')")]) + """
UNION ALL SELECT c_custkey, 'removed', NULL, NULL, NULL FROM v_table_a WHERE c_custkey NOT IN (SELECT c_custkey FROM v_table_b)
UNION ALL SELECT c_custkey, 'added', NULL, NULL, NULL FROM v_table_b WHERE c_custkey NOT IN (SELECT c_custkey FROM v_table_a)) z"""))
def l7(spark, sf):
    return cp.table_diff(frame(spark, sf, "v_table_a"), frame(spark, sf, "v_table_b"), ["c_custkey"])


view("v_aborts", """
SELECT 'run-' || CAST(o_custkey AS STRING) AS run_id, 'DATE_PARSE_ABORT' AS abort_code, min(o_orderkey) AS row_index, min(o_orderpriority) AS "column", max(o_orderstatus) AS raw_value, count(*) AS rows_completed FROM orders GROUP BY o_custkey
""")
view("s_aborts", """
SELECT 'run-' || CAST(o_custkey AS STRING) AS run_id, 'DATE_PARSE_ABORT' AS abort_code, min(o_orderkey) AS row_index, min(o_orderpriority) AS `column`, max(o_orderstatus) AS raw_value, count(*) AS rows_completed FROM orders GROUP BY o_custkey
""")


@query("l8_compare_abort", sql_with("v_aborts", body="""
SELECT run_id, CASE WHEN rows_completed % 11 = 0 THEN 'one_side_only' WHEN row_index % 7 = 0 THEN 'differ' ELSE 'agree' END AS state, CASE WHEN rows_completed % 11 <> 0 AND row_index % 7 = 0 THEN 'row_index,rows_completed' ELSE '' END AS differing FROM v_aborts"""))
def l8(spark, sf):
    a = frame(spark, sf, "s_aborts")
    off = F.when(F.col("row_index") % 7 == 0, 1).otherwise(0)
    b = a.filter("rows_completed % 11 <> 0").select("run_id", "abort_code", (F.col("row_index") + off).alias("row_index"), "column", "raw_value", (F.col("rows_completed") + off).alias("rows_completed"))
    return cp.compare_abort(a, b)


view("v_usage", "SELECT l_linestatus AS file, p_brand AS object, p_type || CAST(p_size AS STRING) AS field FROM lineitem JOIN part ON l_partkey = p_partkey")
view("v_groups", """
SELECT file, object || '_fields' AS grp, row_number() OVER (PARTITION BY file, object ORDER BY field) AS ordinal, field FROM (SELECT DISTINCT file, object, field FROM v_usage) u
""", "v_usage")
# the declared side: one brand reordered, one shortened, one absent, one of its own
_DECL = "SELECT 'U-' || file AS unit, CASE WHEN object = 'Brand#9' THEN 'Own' ELSE object END || '_const' AS const, CASE WHEN object = 'Brand#2' THEN -ordinal ELSE ordinal END AS ordinal, field AS value FROM (SELECT *, replace(grp, '_fields', '') AS object FROM v_groups) g WHERE NOT (object = 'Brand#3' AND ordinal = 2)"
view("v_declared", _DECL, "v_groups")
_BIND = "SELECT DISTINCT file, grp, 'U-' || file AS unit, replace(grp, '_fields', '_const') AS const FROM v_groups WHERE grp <> 'Brand#4_fields' UNION ALL SELECT DISTINCT file, 'Nothing_fields', 'U-' || file, 'Nothing_const' FROM v_groups"
view("v_bindings", _BIND, "v_groups")


@remembered
def detected_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cp.field_groups(frame(spark, sf, "v_usage"))


def declared_vectors(spark: SparkSession, sf: str) -> DataFrame:
    d = detected_groups(spark, sf)
    brand = F.replace("group", F.lit("_fields"), F.lit(""))
    return d.filter(~((brand == "Brand#3") & (F.col("ordinal") == 2))).select(
        F.concat(F.lit("U-"), "file").alias("unit"), F.concat(F.when(brand == "Brand#9", "Own").otherwise(brand), F.lit("_const")).alias("constant"),
        F.when(brand == "Brand#2", -F.col("ordinal")).otherwise(F.col("ordinal")).alias("ordinal"), F.col("field").alias("value"),
    )


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    d = detected_groups(spark, sf).select("file", "group").distinct()
    bound = d.filter("group != 'Brand#4_fields'").select("file", "group", F.concat(F.lit("U-"), "file").alias("unit"), F.replace("group", F.lit("_fields"), F.lit("_const")).alias("constant"))
    none = d.select("file").distinct().select("file", F.lit("Nothing_fields").alias("group"), F.concat(F.lit("U-"), "file").alias("unit"), F.lit("Nothing_const").alias("constant"))
    return bound.unionByName(none)


_VEC = """SELECT file, grp, unit, const, n1, n2, CAST(o1 AS BIGINT) AS o1, CAST(o2 AS BIGINT) AS o2,
  CASE WHEN n1 = 0 AND n2 = 0 THEN 'VACUOUS' WHEN n1 = 0 THEN 'MISSING_DETECTED' WHEN n2 = 0 THEN 'MISSING_DECLARED' WHEN l = r THEN 'AGREE' WHEN o1 = 0 AND o2 = 0 THEN 'SAME_VALUES_OTHER_ORDER' ELSE 'DIFFER' END AS state FROM (
  SELECT b.*, l, r, coalesce(len(l), 0) AS n1, coalesce(len(r), 0) AS n2, len(list_filter(coalesce(l, []), lambda x: NOT list_contains(coalesce(r, []), x))) AS o1, len(list_filter(coalesce(r, []), lambda x: NOT list_contains(coalesce(l, []), x))) AS o2
  FROM v_bindings b LEFT JOIN (SELECT file, grp, list(field ORDER BY ordinal, field) AS l FROM v_groups GROUP BY ALL) d USING (file, grp)
  LEFT JOIN (SELECT unit, const, list(value ORDER BY ordinal, value) AS r FROM v_declared GROUP BY ALL) e USING (unit, const)) z"""
_UNC = """SELECT 'detected' AS side, file AS scope, grp AS name FROM (SELECT DISTINCT file, grp FROM v_groups) d WHERE NOT EXISTS (SELECT 1 FROM v_bindings b WHERE b.file = d.file AND b.grp = d.grp) AND NOT (file = 'F' AND grp = 'Brand#4_fields')
UNION ALL SELECT 'declared', unit, const FROM (SELECT DISTINCT unit, const FROM v_declared) e WHERE NOT EXISTS (SELECT 1 FROM v_bindings b WHERE b.unit = e.unit AND b.const = e.const)"""
VEC = ("v_groups", "v_declared", "v_bindings")


def _waivers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("detected", "F", "Brand#4_fields")], "side string, scope string, name string")


@query("l9_compare_vectors", sql_with(*VEC, body=f'SELECT file, grp AS "group", unit, const AS "constant", n1 AS n_detected, n2 AS n_declared, o1 AS only_detected, o2 AS only_declared, state FROM ({_VEC}) v'))
def l9(spark, sf):
    return cp.compare_vectors(detected_groups(spark, sf), declared_vectors(spark, sf), bindings(spark, sf))


@query("l10_uncovered", sql_with(*VEC, body=_UNC))
def l10(spark, sf):
    return cp.uncovered(detected_groups(spark, sf), declared_vectors(spark, sf), bindings(spark, sf), _waivers(spark))


@query("l11_vector_gate", sql_with(*VEC, body=f"""SELECT count(*) AS pairs, count(*) FILTER (state = 'VACUOUS') AS vacuous, count(*) FILTER (state NOT IN ('AGREE', 'VACUOUS')) AS divergent, (SELECT count(*) FROM ({_UNC}) u) AS uncovered, 2 AS outcome FROM ({_VEC}) v"""))
def l11(spark, sf):
    d, e, b = detected_groups(spark, sf), declared_vectors(spark, sf), bindings(spark, sf)
    return cp.vector_gate(cp.compare_vectors(d, e, b), cp.uncovered(d, e, b, _waivers(spark)))


@query("l12_field_groups", sql_with("v_groups", body='SELECT file, grp AS "group", ordinal, field FROM v_groups'))
def l12(spark, sf):
    return cp.field_groups(frame(spark, sf, "v_usage"))


@query("l13_anchor_positions", sql_with("v_groups", body="""
WITH layout AS (SELECT grp AS object, field, min(ordinal) AS position, count(*) AS copies FROM v_groups GROUP BY ALL), sizes AS (SELECT grp AS object, count(*) AS n FROM v_groups GROUP BY grp)
SELECT a.object, a.field, position, coalesce(n, 0) AS n_fields, CASE WHEN n IS NULL THEN 'OBJECT_ABSENT' WHEN position IS NULL THEN 'FIELD_ABSENT' ELSE 'FOUND' END AS state
FROM (SELECT DISTINCT 'Brand#' || CAST(p_size AS VARCHAR) || '_fields' AS object, p_type || CAST(p_size AS VARCHAR) AS field FROM part) a LEFT JOIN sizes s ON s.object = a.object LEFT JOIN layout l ON l.object = a.object AND l.field = a.field"""))
def l13(spark, sf):
    layout = detected_groups(spark, sf).select(F.col("group").alias("object"), "field", F.col("ordinal").alias("position"))
    size = F.col("p_size").cast("string")
    anchors = frame(spark, sf, "part").select(F.concat(F.lit("Brand#"), size, F.lit("_fields")).alias("object"), F.concat("p_type", size).alias("field")).distinct()
    return cp.anchor_positions(layout, anchors)


# --- M: scans ----------------------------------------------------------------------------------------------------------

_PROSE = {"arrow entity": r"&[a-z]+;", "capital word": r"[A-Z][a-z]+", "number": r"[0-9]+", "address": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "call": r"[a-z]+\("}
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents"
_LINES = f"SELECT * FROM ({_LINES}) l0 WHERE line <> '' OR line_no < n"
_HITS = "\nUNION ALL ".join(f"SELECT doc_id, line_no, '{n}' AS pattern, regexp_extract(line, '{p}') AS token, trim(line, ' ') AS context FROM ({_LINES}) l WHERE regexp_matches(line, '{p}')" for n, p in _PROSE.items())
_PAGE_LINES = f"SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM (SELECT page_id, '{scan.CONTROL_LINE}' || chr(10) || html AS t FROM pages) p0"


@remembered
def prose_hits(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_patterns(frame(spark, sf, "documents"), "doc_id", "text", _PROSE)


@query("m1_scan_patterns", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, pattern, token, context FROM ({_HITS}) h")
def m1(spark, sf):
    return prose_hits(spark, sf)


def _re2(pattern: str) -> str:
    return pattern.replace(r"(?<!Boolean\.)", "").replace("'", "''")


@query("m1_scan_source_syntax", "SELECT page_id, CAST(line_no AS INTEGER) AS line_no, pattern, token FROM (" + "\nUNION ALL ".join(
    f"SELECT page_id, line_no, '{n}' AS pattern, regexp_extract(line, '{_re2(p)}') AS token FROM ({_PAGE_LINES}) l WHERE regexp_matches(line, '{_re2(p)}')" for n, p in scan.PATTERNS.items()) + ") h")
def m1b(spark, sf):
    # every page behind the control line, so that the scan has something to find
    pages = frame(spark, sf, "pages").select("page_id", F.concat(F.lit(scan.CONTROL_LINE + "\n"), "html").alias("text"))
    return scan.scan_patterns(pages, "page_id", "text").drop("context")


@query("m2_scan_gate", "SELECT page_id, fired, fired >= 4 AS valid FROM (SELECT page_id, " + " + ".join(
    f"regexp_matches('{scan.CONTROL_LINE}' || html, '{_re2(p)}')::INT" for p in scan.PATTERNS.values()) + " AS fired FROM pages) x")
def m2(spark, sf):
    controls = frame(spark, sf, "pages").select("page_id", F.concat(F.lit(scan.CONTROL_LINE), "html").alias("text"))
    return scan.scan_gate(controls, "text").select("page_id", "fired", "valid")


@query("m3_scan_summary", f"SELECT doc_id, CASE WHEN count(h.pattern) > 0 THEN 'FAIL' ELSE 'CLEAN' END AS verdict, count(h.pattern) AS hits FROM documents LEFT JOIN ({_HITS}) h USING (doc_id) GROUP BY doc_id")
def m3(spark, sf):
    return scan.scan_summary(frame(spark, sf, "documents"), prose_hits(spark, sf), "doc_id")


@query("m3_first_hits", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, pattern, token, context, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pattern) AS rank FROM ({_HITS}) h) r")
def m3b(spark, sf):
    return scan.first_hits(prose_hits(spark, sf), "doc_id")


_PROBES = {"RSD-CONTACT": [r"@", r"[0-9]{3}"], "RSD-LICENCE": [r"(?i)licen[cs]e"], "RSD-SHOUT": [r"[A-Z]{4,}", r"!"]}


@query("m4_phrase_probes", "\nUNION ALL ".join(f"SELECT doc_id, '{c}' AS code FROM documents WHERE " + " AND ".join(f"regexp_matches(text, '{p}')" for p in ps) for c, ps in _PROBES.items()))
def m4(spark, sf):
    return scan.phrase_probes(frame(spark, sf, "documents"), "doc_id", "text", _PROBES)


_REQUIRED = ["The", "La", "Der", "It"]
_FIRST_WORD = r"(?m)^([A-Za-zÀ-ÿ]+)"


@query("m5_section_coverage", f"SELECT doc_id, missing FROM (SELECT doc_id, unnest({_REQUIRED}) AS missing, regexp_extract_all(text, '{_FIRST_WORD}', 1) AS names FROM documents) x WHERE NOT list_contains(names, missing)")
def m5(spark, sf):
    return scan.section_coverage(frame(spark, sf, "documents"), "doc_id", "text", _REQUIRED, _FIRST_WORD)


# --- A: layout and files -----------------------------------------------------------------------------------------------


def contract_lines(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_contract_lines")


def _bare(d: str) -> str:
    e = "\\|" if d == "|" else d
    return f"""regexp_replace(line, '(^|{e})"(?:[^"]|"")*"?', '\\1', 'g')"""


def _fc(d: str) -> str:
    return f"(length({_bare(d)}) - length(replace({_bare(d)}, '{d}', '')) + 1)"


_NAIVE = "(length(line) - length(replace(line, ',', '')) + 1)"
_RECORD_FC = _fc(",")
_SCORES = "\nUNION ALL ".join(f"""SELECT file, {i} AS ord, '{n}' AS label, k, CASE WHEN k <= 1 THEN 0 ELSE c * (k - 1) END AS score FROM (SELECT file, k, c, row_number() OVER (PARTITION BY file ORDER BY c DESC, k DESC) AS best
  FROM (SELECT file, {_fc(d)} AS k, count(*) AS c FROM v_contract_records GROUP BY ALL) a) b WHERE best = 1"""
    if d == "," else f"""SELECT file, {i} AS ord, '{n}' AS label, 1 AS k, 0 AS score FROM v_contract_records GROUP BY file""" for i, (n, d) in enumerate(ly.CANDIDATES.items()))


def contract_records(spark: SparkSession, sf: str) -> DataFrame:
    return assemble_records(contract_lines(spark, sf), ",")


@query("a4_detect_delimiter", sql_with("v_contract_records", body=f"""
SELECT a.file, a.label AS winner, a.k AS field_count, a.score, b.label AS runner_up, b.score AS runner_up_score, a.score - b.score AS margin
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) AS r FROM ({_SCORES}) s) a JOIN (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, ord) AS r FROM ({_SCORES}) s) b ON a.file = b.file AND a.r = 1 AND b.r = 2"""))
def a4(spark, sf):
    return ly.detect_delimiter(contract_lines(spark, sf))


_CELLS = """list_transform(regexp_extract_all(',' || regexp_replace(line, '^\ufeff|\r$', '', 'g'), ',("(?:[^"]|"")*"?[^,]*|[^,]*)', 1), lambda p: trim(CASE WHEN p LIKE '"%' THEN replace(regexp_replace(p, '^"((?:[^"]|"")*)"?', '\\1'), '""', '"') ELSE p END))"""


@query("a5_detect_header", sql_with("v_contract_records", body=f"""
WITH numbered AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY record_no) AS place, {_CELLS} AS cells FROM v_contract_records),
head AS (SELECT * FROM numbered WHERE place <= {ly.HEADER_CANDIDATES}),
scored AS (SELECT h.file, h.place, h.cells, len(h.cells) AS n, len(list_filter(h.cells, lambda c: length(c) > 0 AND NOT regexp_full_match(c, '[+-]?[0-9.,]+'))) AS texty, len(list_distinct(h.cells)) AS uniq,
  count(b.place) AS below, coalesce(sum(len(list_filter(list_zip(h.cells, b.cells), lambda z: z[1] = z[2]))), 0) AS repeats FROM head h LEFT JOIN numbered b ON b.file = h.file AND b.place > h.place GROUP BY ALL),
ranked AS (SELECT *, texty / n * 0.5 + uniq / n * 0.5 - repeats / (n * greatest(1, below)) AS score, row_number() OVER (PARTITION BY file ORDER BY texty / n * 0.5 + uniq / n * 0.5 - repeats / (n * greatest(1, below)) DESC, place) AS r FROM scored)
SELECT a.file, a.place AS header_place, CAST(round(a.score * 1000) AS BIGINT) AS score, CAST(round(coalesce(b.score, 0) * 1000) AS BIGINT) AS runner_up_score, array_to_string(a.cells, '|') AS names
FROM ranked a LEFT JOIN ranked b ON b.file = a.file AND b.r = 2 WHERE a.r = 1"""))
def a5(spark, sf):
    return ly.detect_header(contract_records(spark, sf), ",")


@query("a6_field_count_histogram", sql_with("v_contract_records", body=f"SELECT file, {_RECORD_FC} AS field_count, count(*) AS records FROM v_contract_records GROUP BY ALL"))
def a6(spark, sf):
    return ly.field_count_histogram(contract_records(spark, sf))


@query("a6_ragged_files", sql_with("v_contract_records", body=f"SELECT file, string_agg(CAST(k AS VARCHAR) || 'x' || CAST(c AS VARCHAR), ', ' ORDER BY k) AS histogram, count(*) > 1 AS ragged FROM (SELECT file, {_RECORD_FC} AS k, count(*) AS c FROM v_contract_records GROUP BY ALL) x GROUP BY file"))
def a6b(spark, sf):
    return ly.ragged(ly.field_count_histogram(contract_records(spark, sf)))


@query("a7_naive_histogram", sql_with("v_contract_records", "v_contract_lines", body=f"""
SELECT file, field_count, coalesce(l, 0) AS lines, coalesce(r, 0) AS records, greatest(0, coalesce(l, 0) - coalesce(r, 0)) AS disagreeing
FROM (SELECT file, {_NAIVE} AS field_count, count(*) AS l FROM v_contract_lines WHERE line <> '' GROUP BY ALL) x FULL JOIN (SELECT file, {_RECORD_FC} AS field_count, count(*) AS r FROM v_contract_records GROUP BY ALL) y USING (file, field_count)"""))
def a7(spark, sf):
    lines = in_blocks(contract_lines(spark, sf))
    return ly.naive_field_count_histogram(lines, assemble_records(lines, ","), ",")


@query("a8_quoted_delimiter_stats", sql_with("v_contract_records", body=f"SELECT file, count(*) AS records, count(*) FILTER ({_NAIVE} <> {_RECORD_FC}) AS quoted_delimiter, count(*) FILTER (suffix(line, chr(13))) AS crlf, 0 AS invalid_utf8, bool_or(starts_with(line, '\ufeff')) AS byte_order_mark FROM v_contract_records GROUP BY file"))
def a8(spark, sf):
    lines = in_blocks(contract_lines(spark, sf))
    return ly.quoted_delimiter_stats(lines, assemble_records(lines, ","))


@query("a1_read_ledger", sql_with("v_claims", body="SELECT 'ok' AS state, count(DISTINCT ledger_id) AS ledgers FROM v_claims"))
def a1(spark, sf):
    path = scratch_path(spark, "ledgers")
    whole_ledgers(spark, sf).select(F.col("ledger_id").alias("part"), F.col("raw").alias("value")).write.partitionBy("part").option("compression", "gzip").text(path)
    return read_ledger(spark, path).groupBy("state").agg(F.count("*").alias("ledgers"))


@query("a3_read_contract_csv", sql_with("v_contracts", body="SELECT " + ", ".join(TABLE_COLUMNS) + " FROM v_contracts"))
def a3(spark, sf):
    path = scratch_path(spark, "contracts")
    contracts(spark, sf).select(*TABLE_COLUMNS).write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)
    return dl.read_contract_csv(spark, path).select(*TABLE_COLUMNS)


@query("a9_bind_inputs")
def a9(spark, sf):
    return dl.bind_inputs(spark, [f"{sf}/{t}.parquet" for t in ("orders", "customer", "lineitem", "documents")])


_NINE = ", ".join(f"CASE WHEN len(string_split(line, '|')) >= {i} THEN split_part(line, '|', {i}) END AS f{i}" for i in range(1, 10))


@query("a10_read_positional", sql_with("v_positional", body=f"SELECT {_NINE} FROM v_positional"))
def a10(spark, sf):
    path = scratch_path(spark, "positional")
    frame(spark, sf, "v_positional").select("line").write.text(path)
    return dl.read_positional(spark, path, [f"f{i}" for i in range(1, 10)]).drop("file")


@query("a11_sinks", sql_with("o_book", body="SELECT 'parquet' AS sink, count(*) AS rows FROM o_book UNION ALL SELECT 'json', count(*) FROM o_book UNION ALL SELECT 'document', count(*) + 4 FROM o_book"))
def a11(spark, sf):
    where = {name: scratch_path(spark, name) for name in ("parquet", "json", "document")}
    dl.write_parquet(record(spark, sf), where["parquet"])
    # the other sinks take the records as the first one holds them; the book is computed once
    book = spark.read.parquet(where["parquet"])
    dl.write_json(book, where["json"])
    dl.write_document(lc.render_document(lc.export_rows(book), DAY), where["document"])
    read = {"parquet": spark.read.parquet(where["parquet"]), "json": spark.read.schema(book.schema).json(where["json"]), "document": spark.read.text(where["document"])}
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sink"), "rows") for name, df in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d24_artifact_presence", "SELECT 'R-0' AS ledger_id, 'V-026' AS rule_id, 'RELEASE_BLOCKING' AS severity, 'Artifact ' || s_name || ' is listed as produced but missing.' AS message, CAST(NULL AS VARCHAR) AS claim_id FROM supplier WHERE s_suppkey % 5 = 0")
def d24(spark, sf):
    from auditframe.operators.ledger_rules import artifact_presence

    path = scratch_path(spark, "artifacts")
    # one file per supplier stands for a produced artifact; the manifest also lists some that were never written
    made = frame(spark, sf, "supplier").filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("part"), F.col("s_name").alias("value"))
    # a fixed number of tasks, as the files are the work and not the bytes; each puts its own folders in place, where the
    # driver would move all of them one by one
    made.repartition(4 * spark.sparkContext.defaultParallelism, "part").write.partitionBy("part").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    stored = dl.stored_files(spark, path).select(F.regexp_extract("path", r"part=(\d+)", 1).alias("path"), "bytes")
    manifest = frame(spark, sf, "supplier").select(F.lit("R-0").alias("ledger_id"), F.col("s_name").alias("name"), F.lit("PRODUCED").alias("status"), F.col("s_suppkey").cast("string").alias("path"))
    return artifact_presence(manifest, stored)


# --- E: module graphs --------------------------------------------------------------------------------------------------

view("v_flow_nodes", "SELECT 'mod:' || CAST(s_suppkey AS STRING) AS id, 'module' AS kind FROM supplier UNION ALL SELECT 'obj:' || CAST(p_partkey AS STRING), 'object' FROM part")
view("v_flow_edges", """
SELECT DISTINCT 'mod:' || CAST(l_suppkey AS STRING) AS src, 'obj:' || CAST(l_partkey AS STRING) AS dst, 'PRODUCE' AS kind FROM lineitem WHERE l_linenumber % 2 = 1
UNION ALL SELECT DISTINCT 'obj:' || CAST(l_partkey AS STRING), 'mod:' || CAST(l_suppkey AS STRING), 'READ' FROM lineitem WHERE l_linenumber % 2 = 0
""")
view("v_alias", "SELECT 'mod:' || CAST(s_suppkey AS STRING) AS source, 'unit:' || CAST(s_suppkey AS STRING) AS target, CAST(1000000 - s_suppkey AS INT) AS ordinal FROM supplier WHERE s_suppkey % 3 <> 0")
_REN = "coalesce((SELECT target FROM v_alias a WHERE a.source = {0}), {0})"
view("v_target_nodes", "SELECT CASE WHEN s_suppkey % 3 <> 0 THEN 'unit:' ELSE 'mod:' END || CAST(s_suppkey AS STRING) AS id FROM supplier WHERE s_suppkey % 10 <> 4 UNION ALL SELECT 'obj:' || CAST(p_partkey AS STRING) FROM part UNION ALL SELECT 'extra:' || r_name FROM region")
view("v_target_edges", """
SELECT CASE WHEN n % 3 <> 0 THEN 'unit:' ELSE 'mod:' END || CAST(n AS STRING) AS src, dst, kind FROM (SELECT CAST(substring(src, 5) AS BIGINT) AS n, dst, kind FROM v_flow_edges WHERE kind = 'PRODUCE') x WHERE n % 10 <> 4
UNION ALL SELECT src, CASE WHEN n % 3 <> 0 THEN 'unit:' ELSE 'mod:' END || CAST(n AS STRING), kind FROM (SELECT src, CAST(substring(dst, 5) AS BIGINT) AS n, kind FROM v_flow_edges WHERE kind = 'READ') y
""", "v_flow_edges")


@query("e5_module_outputs", sql_with("v_flow_nodes", "v_flow_edges", "v_alias", body="""
SELECT n.id AS module, coalesce(a.target, n.id) AS unit, coalesce(a.ordinal, 2147483647) AS position, e.dst AS object, count(e.dst) OVER (PARTITION BY n.id) AS n_objects
FROM v_flow_nodes n LEFT JOIN v_alias a ON a.source = n.id LEFT JOIN (SELECT * FROM v_flow_edges WHERE kind = 'PRODUCE' AND dst IN (SELECT id FROM v_flow_nodes WHERE kind = 'object')) e ON e.src = n.id WHERE n.kind = 'module'"""))
def e5(spark, sf):
    return graph.module_outputs(frame(spark, sf, "v_flow_nodes"), frame(spark, sf, "v_flow_edges"), frame(spark, sf, "v_alias"))


@query("e6_graph_diff", sql_with("v_flow_nodes", "v_flow_edges", "v_alias", "v_target_nodes", "v_target_edges", body="""
WITH sn AS (SELECT DISTINCT coalesce(target, id) AS id FROM v_flow_nodes LEFT JOIN v_alias ON source = id),
se AS (SELECT DISTINCT coalesce(a.target, e.src) AS src, coalesce(b.target, e.dst) AS dst, kind FROM v_flow_edges e LEFT JOIN v_alias a ON a.source = e.src LEFT JOIN v_alias b ON b.source = e.dst)
SELECT 'node' AS what, id AS item, 'source_only' AS side FROM sn WHERE id NOT IN (SELECT id FROM v_target_nodes) UNION ALL SELECT DISTINCT 'node', id, 'target_only' FROM v_target_nodes WHERE id NOT IN (SELECT id FROM sn)
UNION ALL SELECT 'edge', src || ' ' || kind || ' ' || dst, 'source_only' FROM (SELECT * FROM se EXCEPT SELECT src, dst, kind FROM v_target_edges) x
UNION ALL SELECT 'edge', src || ' ' || kind || ' ' || dst, 'target_only' FROM (SELECT src, dst, kind FROM v_target_edges EXCEPT SELECT * FROM se) y"""))
def e6(spark, sf):
    return graph.graph_diff(frame(spark, sf, "v_flow_nodes"), frame(spark, sf, "v_flow_edges"), frame(spark, sf, "v_target_nodes"), frame(spark, sf, "v_target_edges"), frame(spark, sf, "v_alias"))


# modules by year of the order: what a module makes in a year is read in the next one, so the flow has no cycle
_SEASON = "JOIN orders ON o_orderkey = l_orderkey"
view("v_season_edges", f"""
SELECT DISTINCT 'mod:' || CAST(l_suppkey AS STRING) || ':' || CAST(year(o_orderdate) AS STRING) AS src, 'obj:' || CAST(l_partkey AS STRING) || ':' || CAST(year(o_orderdate) AS STRING) AS dst, 'PRODUCE' AS kind
FROM lineitem {_SEASON} WHERE l_linenumber % 2 = 1
UNION ALL SELECT DISTINCT 'obj:' || CAST(l_partkey AS STRING) || ':' || CAST(year(o_orderdate) AS STRING), 'mod:' || CAST(l_suppkey AS STRING) || ':' || CAST(year(o_orderdate) + 1 AS STRING), 'READ'
FROM lineitem {_SEASON} WHERE l_linenumber % 2 = 0
""")
view("v_season_target", "SELECT src, dst, kind FROM v_season_edges WHERE NOT (kind = 'READ' AND src LIKE '%7:1996') UNION ALL SELECT 'obj:1:1999', 'mod:late:2000', 'READ' FROM region WHERE r_regionkey = 0", "v_season_edges")
_ENDS = "(SELECT src AS id FROM {0} UNION SELECT dst FROM {0})"


def _depth_sql(table: str) -> str:
    return f"""(WITH RECURSIVE p AS (SELECT DISTINCT dst AS node, 1 AS depth FROM {table} UNION SELECT e.dst, p.depth + 1 FROM p JOIN {table} e ON e.src = p.node) SELECT max(depth) FROM p)"""


def _side_sql(side: str, own: str, other: str) -> str:
    return f"""SELECT '{side}' AS side, (SELECT count(*) FROM {_ENDS.format(own)} x) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst, kind FROM {own}) x) AS edges, {_depth_sql(own)} AS depth,
(SELECT count(*) FROM (SELECT id FROM {_ENDS.format(own)} x EXCEPT SELECT id FROM {_ENDS.format(other)} y) z) AS nodes_alone, (SELECT count(*) FROM (SELECT src, dst, kind FROM {own} EXCEPT SELECT src, dst, kind FROM {other}) z) AS edges_alone"""


@query("e6_graph_sizes", sql_with("v_season_edges", "v_season_target", body=f"{_side_sql('source', 'v_season_edges', 'v_season_target')} UNION ALL {_side_sql('target', 'v_season_target', 'v_season_edges')}"))
def e6b(spark, sf):
    sides = {side: cut_lineage(frame(spark, sf, name).distinct()) for side, name in (("source", "v_season_edges"), ("target", "v_season_target"))}
    nodes = {side: cut_lineage(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()) for side, e in sides.items()}
    alias = frame(spark, sf, "v_alias").limit(0)
    diff = cut_lineage(graph.graph_diff(nodes["source"], sides["source"], nodes["target"], sides["target"], alias))
    return graph.graph_sizes(nodes["source"], sides["source"], diff, "source").unionByName(graph.graph_sizes(nodes["target"], sides["target"], diff, "target"))
