"""Ledger, contract and graph tables derived from the driver tables.

Each view is plain SQL (integer arithmetic and string concatenation) that Spark and DuckDB read alike; the operators
run on the Spark side of a view, the oracles on the DuckDB side.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]

# name -> (views it builds on, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (list(needs), sql.strip())


def _ledger(k: str) -> str:
    return f"'R-' || CAST(CAST(floor({k} / 500) AS BIGINT) AS STRING)"


view("v_claims", f"""
SELECT {_ledger('o_orderkey')} AS ledger_id, o_orderkey AS pos, o_orderkey AS k,
  'C-' || CAST(CASE WHEN o_orderkey % 997 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS claim_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'DERIVED' WHEN 2 THEN 'INTERPRETIVE' ELSE 'DEFINITION' END AS claim_type,
  CASE o_orderkey % 8 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SUPPORTED' WHEN 2 THEN 'SUPPORTED_CONDITIONAL'
    WHEN 3 THEN 'UNESTABLISHED' WHEN 4 THEN 'SUPPORTED' WHEN 5 THEN 'SUPPORTED_CONDITIONAL' WHEN 6 THEN 'OUTDATED'
    ELSE 'UNRESOLVED' END AS claim_status,
  CASE CAST(floor(o_orderkey / 3) AS BIGINT) % 6 WHEN 0 THEN 'PRIMARY_VERIFIED' WHEN 1 THEN 'AUTHORITATIVE_SECONDARY'
    WHEN 2 THEN 'SECONDARY_ONLY' WHEN 3 THEN 'LICENSE_REQUIRED' WHEN 4 THEN 'NOT_RETRIEVED' ELSE 'SOURCE_CONFLICT' END AS evidence_status,
  CASE WHEN o_orderkey % 4 = 1 THEN 'C-' || CAST(o_orderkey - 1 AS STRING) END AS dep1,
  CASE WHEN o_orderkey % 252 = 0 THEN 'C-' || CAST(o_orderkey + 1 AS STRING) END AS dep2,
  CASE WHEN o_orderkey % 333 = 5 THEN 'C-9000000-' || CAST(o_orderkey AS STRING) END AS dep3,
  CASE WHEN o_orderkey % 252 = 0 THEN NULL WHEN o_orderkey % 500 >= 10 AND o_orderkey % 500 <= 13 THEN 'C-' || CAST(o_orderkey + 1 AS STRING)
    WHEN o_orderkey % 500 = 14 THEN 'C-' || CAST(o_orderkey - 4 AS STRING) END AS dep4,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'rule ' || CAST(o_orderkey % 7 AS STRING) END AS derivation_rule,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'only as far as checked' END AS qualification,
  o_orderpriority || '-' || CAST(o_orderkey % 50 AS STRING) || '-' || CAST(o_custkey % 3 AS STRING) AS normalised_claim,
  CAST(o_orderdate AS DATE) AS last_checked, o_orderkey % 3 = 0 AS time_sensitive, o_orderkey % 101 = 0 AS reopened,
  CASE WHEN o_orderkey % 6 = 0 THEN 'D-' || CAST(o_orderkey % 25 AS STRING) END AS blocked_by,
  CASE WHEN o_orderkey % 12 = 0 THEN 'D-' || CAST(o_orderkey % 25 AS STRING) END AS condition_on,
  CASE WHEN o_orderkey % 13 = 0 THEN 'S-' || CAST(CAST(floor(o_orderkey / 13) AS BIGINT) AS STRING) END AS span1,
  CASE WHEN o_orderkey % 391 = 0 THEN 'S-missing-' || CAST(o_orderkey AS STRING) END AS span2
FROM orders
""")
view("v_deps", """
SELECT ledger_id, pos, claim_id, claim_type, claim_status, derivation_rule, 1 AS slot, dep1 AS dep FROM v_claims WHERE dep1 IS NOT NULL
UNION ALL SELECT ledger_id, pos, claim_id, claim_type, claim_status, derivation_rule, 2, dep2 FROM v_claims WHERE dep2 IS NOT NULL
UNION ALL SELECT ledger_id, pos, claim_id, claim_type, claim_status, derivation_rule, 3, dep3 FROM v_claims WHERE dep3 IS NOT NULL
UNION ALL SELECT ledger_id, pos, claim_id, claim_type, claim_status, derivation_rule, 4, dep4 FROM v_claims WHERE dep4 IS NOT NULL
""", "v_claims")
view("v_runs", """
SELECT ledger_id, ledger_id AS run_id, max(last_checked) AS as_of_date, count(*) AS n_claims FROM v_claims GROUP BY ledger_id
""", "v_claims")
view("v_bundle", """
SELECT ledger_id, name, CASE WHEN name = 'notes.md' AND n % 3 = 0 THEN 'SKIPPED' ELSE 'PRODUCED' END AS status, ledger_id || '/' || name AS path, n
FROM (SELECT ledger_id, CAST(substring(ledger_id, 3) AS BIGINT) AS n FROM v_runs) r JOIN (VALUES ('claims.json', 1), ('report.md', 2), ('notes.md', 3)) a(name, i) ON i > 0
""", "v_runs")
view("v_bundle_stored", """
SELECT path, CASE WHEN n % 8 = 3 AND name = 'claims.json' THEN 0 ELSE length(path) END AS bytes FROM v_bundle WHERE NOT (name = 'report.md' AND n % 6 = 2) AND NOT (name = 'notes.md' AND n % 2 = 0)
""", "v_bundle")
view("v_sources", """
SELECT ledger_id, source_id, kind, access, sufficient, min(pos) AS pos FROM (
  SELECT """ + _ledger("l_orderkey") + """ AS ledger_id, 'SRC-' || CAST(s_suppkey AS STRING) AS source_id, l_orderkey AS pos,
    CASE s_suppkey % 11 WHEN 0 THEN 'statute' WHEN 1 THEN 'regulation' WHEN 2 THEN 'judgment' WHEN 3 THEN 'regulator_guidance'
      WHEN 4 THEN 'professional_standard' WHEN 5 THEN 'official_guidance' WHEN 6 THEN 'commentary' WHEN 7 THEN 'academic'
      WHEN 8 THEN 'secondary' WHEN 9 THEN 'data' ELSE 'internal' END AS kind,
    CASE s_suppkey % 4 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'LICENSED' WHEN 2 THEN 'PAYWALLED' ELSE 'INTERNAL' END AS access,
    CASE WHEN s_suppkey % 3 = 0 THEN 'existence' ELSE 'citation' END AS sufficient
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
) x GROUP BY ledger_id, source_id, kind, access, sufficient
""")
view("v_evidence", f"""
SELECT {_ledger('l_orderkey')} AS ledger_id, 'EV-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS evidence_id,
  l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS pos,
  CASE WHEN l_partkey % 101 = 0 THEN 'SRC-missing' WHEN l_partkey % 7 = 6 AND l_partkey % 2 = 0 THEN NULL
    ELSE 'SRC-' || CAST(l_suppkey AS STRING) END AS source_id,
  CASE l_partkey % 7 WHEN 0 THEN 'primary_text' WHEN 1 THEN 'official_portal' WHEN 2 THEN 'licensed_database'
    WHEN 3 THEN 'authoritative_secondary' WHEN 4 THEN 'secondary_summary' WHEN 5 THEN 'internal_source' ELSE 'none' END AS retrieval_method,
  l_partkey % 211 = 0 AS has_stance, CAST(l_shipdate AS DATE) AS retrieved_at
FROM lineitem
""")
view("v_edges", f"""
SELECT {_ledger('l_orderkey')} AS ledger_id, 'C-' || CAST(CASE WHEN l_partkey % 401 = 0 THEN -1 ELSE l_orderkey END AS STRING) AS src,
  'EV-' || CAST(l_orderkey AS STRING) || '-' || CAST(CASE WHEN l_partkey % 307 = 0 THEN 99 ELSE l_linenumber END AS STRING) AS dst,
  'EVIDENCED_BY' AS type,
  CASE l_returnflag WHEN 'A' THEN 'AFFIRMS' WHEN 'R' THEN 'CONTRADICTS' ELSE 'SILENT' END AS stance
FROM lineitem
UNION ALL
SELECT {_ledger('l_orderkey')} AS ledger_id, CASE WHEN l_partkey % 503 = 0 THEN ' ' ELSE 'EV-' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS src,
  CASE WHEN l_partkey % 101 = 0 THEN 'SRC-missing' ELSE 'SRC-' || CAST(l_suppkey AS STRING) END AS dst, 'RETRIEVED_FROM' AS type, NULL AS stance
FROM lineitem WHERE l_partkey % 53 <> 0
""")
view("v_assumptions", f"""
SELECT {_ledger('p_partkey * 7')} AS ledger_id, 'A-' || CAST(p_partkey AS STRING) AS assumption_id,
  CASE p_partkey % 4 WHEN 0 THEN 'HOLDS' WHEN 1 THEN 'VIOLATED' WHEN 2 THEN 'UNTESTED' ELSE 'CONTINGENT_ON_DECISION' END AS status,
  'C-' || CAST(p_partkey * 7 AS STRING) AS used_by1, 'C-' || CAST(p_partkey * 7 + p_size AS STRING) AS used_by2
FROM part
""")
view("v_decisions", """
SELECT ledger_id, decision_id, k25 % 2 = 0 AS blocking, CASE WHEN k25 % 3 = 0 THEN NULL ELSE 'option ' || CAST(k25 AS STRING) END AS chosen FROM (
  SELECT DISTINCT ledger_id, 'D-' || CAST(k % 25 AS STRING) AS decision_id, k % 25 AS k25 FROM v_claims
) x
""", "v_claims")
view("v_quantities", """
SELECT 'R-0' AS ledger_id, 'Q-' || CAST(p_partkey % 400 AS STRING) AS quantity_id, p_type AS scenario, CAST(p_size AS STRING) AS context,
  DATE '2020-01-01' AS effective_from, CASE WHEN p_partkey % 9 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS value, 'EUR' AS unit
FROM part
""")
view("v_spans", """
SELECT """ + _ledger("doc_id * 13") + """ AS ledger_id, 'S-' || CAST(doc_id AS STRING) AS span_id, source AS document_id,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'C-' || CAST(doc_id * 13 AS STRING) END AS claim_id, doc_id % 2 = 0 AS assertive,
  CASE WHEN doc_id % 5 = 0 THEN 'as far as known' END AS qualification_marker
FROM documents
""")
view("v_reviews", """
SELECT ledger_id, 'F-' || CAST(k AS STRING) AS finding_id, claim_id AS target_id,
  CASE WHEN k % 5 = 0 THEN 'SOURCE_CONFLICT' ELSE 'HIDDEN_ASSUMPTION' END AS kind,
  CASE k % 4 WHEN 0 THEN 'BLOCKING' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE CAST(floor(k / 4) AS BIGINT) % 5 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'OPEN' ELSE 'ESCALATED' END AS resolution,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN 'AUTO_FIXABLE' WHEN k % 3 = 1 THEN 'AUTO_SOFTENABLE' ELSE 'HUMAN_LICENSED_SOURCE' END AS remediation_class
FROM v_claims
""", "v_claims")
view("v_artifacts", """
SELECT ledger_id, name, status, CASE WHEN n % 7 = 0 THEN NULL ELSE 'out/' || ledger_id || '/' || name END AS path,
  CASE WHEN n % 5 = 0 THEN NULL ELSE 'not asked for' END AS reason, n % 4 <> 1 AS non_empty FROM (
  SELECT ledger_id, 'artifact-' || CAST(k % 500 % 9 AS STRING) AS name, max(k) AS n,
    CASE WHEN max(k) % 3 = 0 THEN 'NOT_PRODUCED' ELSE 'PRODUCED' END AS status
  FROM v_claims GROUP BY ledger_id, k % 500 % 9
) x
""", "v_claims")
view("v_requested", """
SELECT DISTINCT ledger_id, 'artifact-' || CAST(k % 500 % 12 AS STRING) AS name FROM v_claims
""", "v_claims")
view("v_claim_json", """
SELECT ledger_id, pos, k, '{' ||
  CASE WHEN k % 211 = 1 THEN '' ELSE '"claim_type":"' || CASE WHEN k % 229 = 4 THEN 'ASSUMPTION' ELSE claim_type END || '",' END ||
  CASE WHEN k % 223 = 2 THEN '' WHEN k % 241 = 7 THEN '"depends_on":["C-1","C-1"],' WHEN k % 251 = 8 THEN '"depends_on":"C-1",'
    WHEN dep1 IS NOT NULL THEN '"depends_on":["' || dep1 || '"],' ELSE '"depends_on":[],' END ||
  CASE WHEN k % 227 = 3 THEN '"extra_note":"x","other":1,' ELSE '' END ||
  '"time_sensitive":' || CASE WHEN k % 233 = 5 THEN '"yes"' WHEN time_sensitive THEN 'true' ELSE 'false' END || ',' ||
  '"last_checked":' || CASE WHEN k % 239 = 6 THEN '"2026-13-40"' WHEN k % 17 = 0 THEN 'null' ELSE '"' || CAST(last_checked AS STRING) || '"' END || ',' ||
  '"normalised_claim":' || CASE WHEN k % 257 = 9 THEN '"  "' WHEN k % 263 = 10 THEN '7' ELSE '"' || normalised_claim || '"' END || ',' ||
  CASE WHEN qualification IS NULL THEN '' ELSE '"qualification":"' || qualification || '",' END ||
  '"derivation_rule":' || CASE WHEN derivation_rule IS NULL THEN 'null' WHEN k % 269 = 11 THEN '""' ELSE '"' || derivation_rule || '"' END || ',' ||
  '"blocked_by":' || CASE WHEN k % 271 = 12 THEN '[1,"D-1"]' WHEN blocked_by IS NULL THEN '[]' ELSE '["' || blocked_by || '"]' END || ',' ||
  CASE WHEN k % 277 = 13 THEN '"decision_conditions":[{"decision_id":"D-1"}],' WHEN k % 281 = 14 THEN '"decision_conditions":[{"decision_id":"D-1","equals":" "}],'
    WHEN condition_on IS NULL THEN '' ELSE '"decision_conditions":[{"decision_id":"' || condition_on || '","equals":"a"}],' END ||
  CASE WHEN k % 293 = 15 THEN '"severity_if_wrong":["HIGH"],' WHEN k % 3 = 1 THEN '"severity_if_wrong":"HIGH",' ELSE '' END ||
  '"claim_status":"' || claim_status || '","evidence_status":"' || CASE WHEN k % 307 = 16 THEN 'HEARSAY' ELSE evidence_status END || '"' ||
  CASE WHEN k % 311 = 17 THEN '' WHEN k % 313 = 18 THEN ',"claim_id":' || CAST(k AS STRING) ELSE ',"claim_id":"' || claim_id || '"' END || '}' AS raw
FROM v_claims
""", "v_claims")
view("v_source_json", """
SELECT ledger_id, pos, '{"source_id":' || CASE WHEN pos % 97 = 3 THEN '""' ELSE '"' || source_id || '"' END ||
  ',"kind":"' || CASE WHEN pos % 31 = 1 THEN 'rumour' ELSE kind END || '","access":' || CASE WHEN pos % 37 = 2 THEN '{"value":"PUBLIC"}' ELSE '"' || access || '"' END ||
  CASE WHEN pos % 41 = 4 THEN '' ELSE ',"title":"' || CASE WHEN pos % 43 = 5 THEN '' ELSE 't' END || '"' END ||
  ',"identifier":"i","version_label":' || CASE WHEN pos % 47 = 6 THEN '5' ELSE 'null' END || ',"version_date":' || CASE WHEN pos % 53 = 7 THEN '"20260821"' ELSE '"2026-08-21"' END ||
  ',"locator":null,"sufficient_for":' || CASE WHEN pos % 59 = 8 THEN '[""]' ELSE '["' || sufficient || '"]' END ||
  CASE WHEN pos % 61 = 9 THEN ',"evidence_level":0' WHEN pos % 61 = 10 THEN ',"evidence_level":2' ELSE '' END ||
  CASE WHEN pos % 67 = 10 THEN ',"shelf":"b"' ELSE '' END || '}' AS raw
FROM v_sources
""", "v_sources")
view("v_run_json", """
SELECT ledger_id, rank_key, '{"run_id":"' || run_id || '","as_of_date":' || CASE WHEN rank_key % 3 = 1 THEN '"2026-W34-5"' ELSE '"' || CAST(as_of_date AS STRING) || '"' END ||
  CASE WHEN rank_key % 5 = 2 THEN '' ELSE ',"document_manifest":[]' END || ',"requested_output_formats":' || CASE WHEN rank_key % 7 = 3 THEN '"pdf"' ELSE '["pdf"]' END ||
  ',"strict_blind_audit_required":' || CASE WHEN rank_key % 4 = 3 THEN '0' ELSE 'false' END || ',"prompt_version":"' || CASE WHEN rank_key % 6 = 5 THEN 'v2.1' ELSE 'v2.2' END || '"' ||
  ',"capabilities":' || CASE WHEN rank_key % 4 = 0 THEN '{"file_output":"yes","telepathy":true}' ELSE '{"file_output":true}' END ||
  ',"gates":' || CASE WHEN rank_key % 5 = 0 THEN '{"G-01":"PASS","G-02":"MAYBE"}' WHEN rank_key % 5 = 1 THEN '[]' ELSE 'null' END || '}' AS raw
FROM (SELECT *, CAST(substring(ledger_id, 3) AS BIGINT) AS rank_key FROM v_runs) x
""", "v_runs")



_CENTS = "CAST(floor({} * 100 + 0.5) AS BIGINT)"
_DIV = "CAST(floor({} / {}) AS BIGINT)"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


def _whole(c: str, unit: int) -> str:
    return f"CAST(CAST(floor({c} / {unit}) AS BIGINT) AS STRING)"


def _compact(day: str) -> str:
    return f"replace(CAST({day} AS STRING), '-', '')"


view("v_money", """
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d0, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, c_mktsegment,
  coalesce(line_cents, 0) AS line_cents
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS line_cents FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
""")
view("v_contracts", f"""
SELECT k + 1 AS row_index,
  CASE WHEN k % 1009 = 5 THEN '1.5e+' || CAST(k % 90 + 10 AS STRING) WHEN k % 983 = 0 AND k > 0 THEN CAST(k - 1 AS STRING) ELSE CAST(k AS STRING) END AS BSV,
  CASE WHEN k % 7 = 3 THEN '' WHEN k % 29 = 2 THEN '0' WHEN k % 31 = 4 THEN 'NA' WHEN k % 211 = 9 THEN '2013-13-45' ELSE CAST(d0 AS STRING) END AS abschlussdatum,
  CASE WHEN k % 5 = 4 THEN '00000000' WHEN k % 37 = 6 THEN '2011/04/01' ELSE CAST(d0 + 30 AS STRING) END AS einloesungsdatum,
  CASE WHEN k % 6 = 1 THEN 'NA' WHEN k % 223 = 11 THEN '2013112' WHEN k % 227 = 13 THEN '2011/04/01' WHEN k % 17 = 5 THEN {_compact('(d0 + 3652)')} || '.0'
    ELSE {_compact('(d0 + CAST(3652 + k % 5 * 400 AS INT))')} END AS erstmalige_zuteilungsanwartschaft,
  CASE WHEN k % 3 = 0 THEN '' WHEN k % 8 = 1 THEN CAST(d0 + CAST(8000 + k % 9 * 500 AS INT) AS STRING) ELSE {_compact('(d0 + CAST(8000 + k % 9 * 500 AS INT))')} END AS Tilgungsbeginn,
  CASE WHEN k % 4 = 2 THEN '0' WHEN k % 229 = 17 THEN '21501231' ELSE {_compact('(d0 + CAST(9500 + k % 11 * 300 AS INT))')} END AS Vertragsende,
  CASE WHEN k % 401 = 7 THEN '' WHEN k % 409 = 8 THEN '1,2,3' WHEN k % 419 = 9 THEN '-500' WHEN k % 421 = 10 THEN '36.263'
    WHEN k % 4 = 0 AND cents >= 100000 THEN {_whole('cents', 100000)} || '.' || lpad(CAST(CAST(floor(cents / 100) AS BIGINT) % 1000 AS STRING), 3, '0') || ',' || {_two('cents % 100')}
    ELSE {_whole('cents', 100)} || '.' || {_two('cents % 100')} END AS DaBetrag,
  CASE WHEN k % 37 = 1 THEN '0' WHEN k % 41 = 2 THEN '' WHEN k % 10 = 0 THEN {_whole('cents', 300000)} || '.' || lpad(CAST(cents % 1000 AS STRING), 3, '0')
    ELSE {_whole('(cents * (1 + k % 3))', 100000)} || '.' || lpad(CAST(cents * (1 + k % 3) % 100000 AS STRING), 5, '0') END AS bausparsumme_teuro,
  CASE WHEN k % 431 = 11 THEN 'n/a' WHEN k % 433 = 12 THEN 'unknown' ELSE {_whole('line_cents * (k % 10)', 2000)} || ',' || {_two('line_cents % 100')} END AS guthaben,
  CASE k % 5 WHEN 0 THEN '0.3' WHEN 1 THEN '0,3500' WHEN 2 THEN '0.4' WHEN 3 THEN '0.5' ELSE 'NA' END AS tariff_amount,
  CASE WHEN k % 6 = 5 THEN '' ELSE c_mktsegment END AS contract_type
FROM v_money
""", "v_money")
view("v_contract_records", """
SELECT '' || file AS file, row_index + 1 AS record_no, '"' || BSV || '",' || abschlussdatum || ',' || einloesungsdatum || ',' || erstmalige_zuteilungsanwartschaft || ',' || Tilgungsbeginn || ',' ||
  Vertragsende || ',"' || DaBetrag || '",' || bausparsumme_teuro || ',"' || guthaben || '",' || CASE WHEN contains_comma THEN '"' || tariff_amount || '"' ELSE tariff_amount END || ',' || CASE WHEN row_index % 101 = 7 THEN '"' || contract_type || chr(10) || 'see, below"' ELSE contract_type END ||
  CASE WHEN row_index % 499 = 3 THEN ',surplus' ELSE '' END || CASE WHEN row_index % 7 = 5 THEN chr(13) ELSE '' END AS line
FROM (SELECT *, CASE WHEN contract_type = '' THEN 'none.csv' ELSE lower(contract_type) || '.csv' END AS file, tariff_amount LIKE '%,%' AS contains_comma FROM v_contracts) x
UNION ALL SELECT DISTINCT CASE WHEN contract_type = '' THEN 'none.csv' ELSE lower(contract_type) || '.csv' END, 0,
  CASE WHEN contract_type = '' THEN '﻿' ELSE '' END || 'BSV,abschlussdatum,einloesungsdatum,erstmalige_zuteilungsanwartschaft,Tilgungsbeginn,Vertragsende,DaBetrag,bausparsumme_teuro,guthaben,tariff_amount,contract_type' FROM v_contracts
""", "v_contracts")
# the same as physical lines: a quoted field of some records holds a line break
view("v_contract_lines", """
SELECT file, 2 * record_no AS line_no, split_part(line, chr(10), 1) AS line FROM v_contract_records
UNION ALL SELECT file, 2 * record_no + 1, split_part(line, chr(10), 2) FROM v_contract_records WHERE line LIKE '%' || chr(10) || '%'
""", "v_contract_records")


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for need in VIEWS[name][0]:
            visit(need)
        out.append(name)

    for name in names:
        visit(name)
    return out


def sql_with(*names: str, body: str) -> str:
    """Query text with the definitions of the views it reads in front."""
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in _closure(names))
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_SCHEMAS: dict[tuple[str, str], object] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its schema is looked up once per folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = _SCHEMAS.get((sf_dir, name))
    if schema is None:
        schema = _SCHEMAS[(sf_dir, name)] = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(path)


def _tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]


_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


def remembered(fn):
    """Keep the (lazy) DataFrame a function builds for one session and folder: plans are reused, data is not held."""

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__module__ + fn.__name__ + "/".join(args))
        if key not in _FRAMES:
            _FRAMES[key] = fn(spark, sf_dir, *args)
        return _FRAMES[key]

    return wrapper


@remembered
def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over the driver tables."""
    # wide projections outgrow what the JVM compiles in one method; let those stages run unfused
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if name in TABLES:
        return _table(spark, sf_dir, name)
    sql = sql_with(name, body=f"SELECT * FROM {name}")
    for table in _tables_of(sql):
        _table(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql)
