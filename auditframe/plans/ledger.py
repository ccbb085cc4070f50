"""Queries and oracles of the ledger checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.operators import gates, graph, ledger_rules, references as refs, structure, vocabulary as voc
from auditframe.plans.registry import query
from auditframe.plans.views import frame, remembered, sql_with

# --- typed tables of the derived ledgers ---------------------------------------------------------------------------


@remembered
def claims(spark: SparkSession, sf: str) -> DataFrame:
    base = frame(spark, sf, "v_claims")
    condition = F.struct(F.col("condition_on").alias("decision_id"), F.lit("a").alias("equals"))
    return base.select(
        "*",
        F.array_compact(F.array("dep1", "dep2", "dep3", "dep4")).alias("depends_on"),
        F.array_compact(F.array("blocked_by")).alias("blocking_ids"),
        F.when(F.col("condition_on").isNotNull(), F.array(condition)).alias("decision_conditions"),
        F.array_compact(F.array("span1", "span2")).alias("appears_in"),
    ).withColumn("blocked_by", F.col("blocking_ids")).drop("blocking_ids")


@remembered
def sources(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_sources").withColumn("sufficient_for", F.array(F.lit("existence"), F.col("sufficient")))


@remembered
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_evidence")


@remembered
def edges(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_edges")


@remembered
def spans(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_spans").withColumn("claim_ids", F.array_compact(F.array("claim_id"))).drop("claim_id")


@remembered
def assumptions(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_assumptions").withColumn("used_by", F.array("used_by1", "used_by2"))


@remembered
def claim_objects(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_claim_json").select("ledger_id", "pos", F.col("pos").alias("idx"), "raw")


@remembered
def source_objects(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_source_json").select("ledger_id", "pos", F.col("pos").alias("idx"), "raw")


@remembered
def run_objects(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_run_json").select("ledger_id", F.lit(0).alias("pos"), F.lit(0).alias("idx"), "raw")


# --- oracle building blocks ----------------------------------------------------------------------------------------

BLOCK = "'RELEASE_BLOCKING' AS severity"
ID_RE = "'^C-?[A-Za-z0-9][A-Za-z0-9._-]*$'"


def _finding_sql(rule: str, message: str, claim: str = "CAST(NULL AS VARCHAR)", source: str = "") -> str:
    return f"SELECT ledger_id, '{rule}' AS rule_id, {BLOCK}, {message} AS message, {claim} AS claim_id {source}"


def _type(f: str) -> str:
    return f"json_type(raw, '$.{f}')"


def _str(f: str) -> str:
    return f"(CASE WHEN {_type(f)} = 'VARCHAR' THEN raw->>'$.{f}' END)"


def _show(f: str) -> str:
    text = f"(raw->>'$.{f}')"
    return (
        f"(CASE WHEN {_type(f)} IS NULL OR {_type(f)} = 'NULL' THEN 'None' WHEN {_type(f)} = 'BOOLEAN' "
        f"THEN upper(substr({text}, 1, 1)) || substr({text}, 2) ELSE {text} END)"
    )


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_LISTED = {"claims": ("v_claim_json", "'Claim ' || " + _show("claim_id"), _str("claim_id")),
           "sources": ("v_source_json", "'Source ' || " + _show("source_id"), "CAST(NULL AS VARCHAR)"),
           "runs": ("v_run_json", "'Run'", "CAST(NULL AS VARCHAR)")}


def _where(kind: str) -> str:
    return "'Run'" if kind == "runs" else f"'{structure.LABEL[kind]} at index ' || CAST(pos AS VARCHAR)"


def missing_sql(kind: str) -> str:
    table, _, claim = _LISTED[kind]
    parts = [
        _finding_sql("V-000", f"{_where(kind)} || ' is missing required field ''{f}''.'", claim, f"FROM {table} WHERE NOT list_contains(json_keys(raw), '{f}')")
        for f in structure.REQUIRED[kind]
    ]
    return "\nUNION ALL ".join(parts)


def unknown_sql(kind: str) -> str:
    table, subject, claim = _LISTED[kind]
    where = _where(kind) if kind == "claims" else subject
    return _finding_sql(
        "V-000", f"{where} || ' has unknown field ''' || name || '''.'", claim,
        f"FROM (SELECT *, unnest(json_keys(raw)) AS name FROM {table}) x WHERE name NOT IN {_in(structure.KNOWN[kind])}",
    )


def vocab_sql(kind: str) -> str:
    table, subject, claim = _LISTED[kind]
    parts = [
        _finding_sql(
            "V-000", f"{subject} || ' has invalid {f}=' || {_show(f)} || '.'", claim,
            f"FROM {table} WHERE {_type(f)} IS NOT NULL AND coalesce({_str(f)} NOT IN {_in(values)}, true)",
        )
        for f, values in structure.VOCABULARY[kind].items()
    ]
    return "\nUNION ALL ".join(parts)


def types_sql(kind: str) -> str:
    table, subject, claim = _LISTED[kind]
    day = r"'^\d{4}-\d{2}-\d{2}$'"
    parts = []
    for f, shape in structure.SHAPES[kind].items():
        base = shape.removesuffix(" or null")
        items = f"(CASE WHEN {_type(f)} = 'ARRAY' THEN CAST(raw->'$.{f}' AS JSON[]) END)"
        holds = {
            "a non-empty string": f"length(trim({_str(f)})) > 0",
            "a string": f"{_type(f)} = 'VARCHAR'",
            "boolean": f"{_type(f)} = 'BOOLEAN'",
            "an ISO date": f"(regexp_matches({_str(f)}, {day}) AND TRY_CAST({_str(f)} AS DATE) IS NOT NULL)",
            "a list of strings": f"({_type(f)} = 'ARRAY' AND len(list_filter({items}, lambda x: json_type(x) <> 'VARCHAR'"
            + (" OR trim(x->>'$') = ''" if f == "sufficient_for" else "") + ")) = 0)",
            "a positive integer": f"({_type(f)} IN ('UBIGINT', 'BIGINT') AND CAST(raw->>'$.{f}' AS BIGINT) >= 1)",
        }[base]
        allowed = f"coalesce({holds}, false)" + (f" OR {_type(f)} = 'NULL'" if shape.endswith("null") else "")
        parts.append(
            _finding_sql("V-000", f"{subject} || ' field ''{f}'' must be {shape}.'", claim, f"FROM {table} WHERE {_type(f)} IS NOT NULL AND NOT ({allowed})")
        )
    if kind == "claims":
        parts.append(_finding_sql("V-000", f"{_where(kind)} || ' has an invalid ''claim_id''.'", claim,
                                  f"FROM {table} WHERE {_type('claim_id')} IS NOT NULL AND NOT coalesce(regexp_matches({_str('claim_id')}, {ID_RE}), false)"))
    if kind == "sources":
        parts.append(_finding_sql("V-000", f"{_where(kind)} || ' has an invalid ''source_id''.'", claim,
                                  f"FROM {table} WHERE NOT coalesce(length(trim({_str('source_id')})) > 0, false)"))
    if kind == "runs":
        parts.append(_finding_sql("V-000", "'Run field ''prompt_version'' must equal ''v2.2''.'", claim,
                                  f"FROM {table} WHERE {_type('prompt_version')} IS NOT NULL AND coalesce({_str('prompt_version')} <> 'v2.2', true)"))
    return "\nUNION ALL ".join(parts)


# --- A2: explode whole ledgers -------------------------------------------------------------------------------------


def whole_ledgers(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per ledger, assembled from its claim and source objects."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        items = df.groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("x"))
        return items.select("ledger_id", F.array_join("x.raw", ",").alias(name))

    joined = listed(claim_objects(spark, sf), "c").join(listed(source_objects(spark, sf), "s"), "ledger_id", "left")
    text = F.concat(F.lit('{"run":{},"claims":[5,'), F.col("c"), F.lit('],"sources":['), F.coalesce("s", F.lit("")), F.lit('],"edges":"none"}'))
    return joined.select("ledger_id", text.alias("raw"))


@query("a2_explode_ledger", sql_with("v_claim_json", "v_source_json", body="""
SELECT ledger_id, 'claims' AS kind, 1 + row_number() OVER (PARTITION BY ledger_id ORDER BY pos) - 1 AS pos,
  row_number() OVER (PARTITION BY ledger_id ORDER BY pos) - 1 AS idx, json_extract_string(raw, '$.claim_id') AS object_id FROM v_claim_json
UNION ALL SELECT ledger_id, 'sources', row_number() OVER (PARTITION BY ledger_id ORDER BY pos, raw) - 1,
  row_number() OVER (PARTITION BY ledger_id ORDER BY pos, raw) - 1, json_extract_string(raw, '$.source_id') FROM v_source_json
UNION ALL SELECT DISTINCT ledger_id, 'finding', 0, 0, 'Claim at index 0 must be an object.' FROM v_claim_json
UNION ALL SELECT DISTINCT ledger_id, 'finding', 0, 0, 'Ledger field ''edges'' must be a list.' FROM v_claim_json
"""))
def a2_explode_ledger(spark: SparkSession, sf: str) -> DataFrame:
    from auditframe.sources.ledger import explode_ledger, ledger_state, root_findings

    ledgers = ledger_state(whole_ledgers(spark, sf))
    tables = explode_ledger(ledgers)
    found = tables["item_findings"].unionByName(root_findings(ledgers))
    out = found.select("ledger_id", F.lit("finding").alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("idx"), F.col("message").alias("object_id"))
    for kind, key in (("claims", "claim_id"), ("sources", "source_id")):
        part = tables[kind].select("ledger_id", F.lit(kind).alias("kind"), "pos", "idx", F.try_variant_get(F.parse_json("raw"), f"$.{key}", "string").alias("object_id"))
        out = out.unionByName(part)
    return out


# --- C: structure --------------------------------------------------------------------------------------------------


def _union(*parts: DataFrame) -> DataFrame:
    return refs.union_findings(list(parts))


ALL_JSON = ("v_claim_json", "v_source_json", "v_run_json")


@query("c1_missing_fields", sql_with(*ALL_JSON, body="\nUNION ALL ".join(missing_sql(k) for k in _LISTED)))
def c1_missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _union(
        structure.missing_fields(claim_objects(spark, sf), "claims"),
        structure.missing_fields(source_objects(spark, sf), "sources"),
        structure.missing_fields(run_objects(spark, sf), "runs"),
    )


@query("c2_unknown_fields", sql_with(*ALL_JSON, body=unknown_sql("claims") + "\nUNION ALL " + unknown_sql("sources") + "\nUNION ALL " + _finding_sql(
    "V-000", "'Unknown capability field ''' || name || '''.'", source="FROM (SELECT *, unnest(json_keys(raw, '$.capabilities')) AS name FROM v_run_json) x WHERE name NOT IN " + _in(voc.CAPABILITIES))))
def c2_unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    maps = structure.check_run_maps(run_objects(spark, sf))
    return _union(
        structure.unknown_fields(claim_objects(spark, sf), "claims"),
        structure.unknown_fields(source_objects(spark, sf), "sources"),
        maps.filter(F.col("message").startswith("Unknown capability")),
    )


@query("c3_check_vocab", sql_with(*ALL_JSON, "v_edges", body=vocab_sql("claims") + "\nUNION ALL " + vocab_sql("sources") + "\nUNION ALL " + _finding_sql(
    "V-000", "'Run gate ''' || name || ''' has invalid status=' || state || '.'",
    source="FROM (SELECT ledger_id, name, raw->'$.gates'->>name AS state FROM (SELECT *, unnest(json_keys(raw, '$.gates')) AS name FROM v_run_json WHERE json_type(raw, '$.gates') = 'OBJECT') y) x WHERE state NOT IN " + _in(voc.GATE_STATES))
    + "\nUNION ALL " + _finding_sql("V-000", "'EVIDENCED_BY edge has invalid stance=' || stance || '.'", "src", "FROM v_edges WHERE type = 'EVIDENCED_BY' AND stance NOT IN " + _in(voc.STANCES))))
def c3_check_vocab(spark: SparkSession, sf: str) -> DataFrame:
    maps = structure.check_run_maps(run_objects(spark, sf))
    edge_objects = edges(spark, sf).select(
        "ledger_id", F.lit(0).alias("pos"), F.lit(0).alias("idx"),
        F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type", "stance")).alias("raw"),
    )
    return _union(
        structure.check_vocab(claim_objects(spark, sf), "claims"),
        structure.check_vocab(source_objects(spark, sf), "sources"),
        maps.filter(F.col("message").contains("has invalid status=")),
        structure.check_stances(edge_objects),
    )


@query("c4_check_types", sql_with(*ALL_JSON, body="\nUNION ALL ".join(types_sql(k) for k in _LISTED)))
def c4_check_types(spark: SparkSession, sf: str) -> DataFrame:
    return _union(
        structure.check_types(claim_objects(spark, sf), "claims"),
        structure.check_types(source_objects(spark, sf), "sources"),
        structure.check_types(run_objects(spark, sf), "runs"),
    )


@query("c5_check_id_list", sql_with("v_claim_json", body=_finding_sql(
    "V-000", "'Claim ' || " + _show("claim_id") + " || ' field ''depends_on'' must be a unique list of Claim IDs.'", _str("claim_id"),
    f"""FROM v_claim_json WHERE {_type('depends_on')} IS NOT NULL AND NOT ({_type('depends_on')} = 'ARRAY'
      AND len(list_filter(TRY_CAST(raw->'$.depends_on' AS VARCHAR[]), lambda x: NOT regexp_matches(x, {ID_RE}))) = 0
      AND len(list_distinct(TRY_CAST(raw->'$.depends_on' AS VARCHAR[]))) = len(TRY_CAST(raw->'$.depends_on' AS VARCHAR[])))""")))
def c5_check_id_list(spark: SparkSession, sf: str) -> DataFrame:
    return structure.check_id_list(claim_objects(spark, sf))


@query("c6_check_decision_conditions", sql_with("v_claim_json", body=_finding_sql(
    "V-000", "'Claim ' || " + _show("claim_id") + " || ' field ''decision_conditions'' is malformed.'", _str("claim_id"),
    """FROM v_claim_json WHERE json_type(raw, '$.decision_conditions') IS NOT NULL AND len(list_filter(CAST(raw->'$.decision_conditions' AS JSON[]),
      lambda x: list_sort(json_keys(x)) = ['decision_id', 'equals'] AND trim(x->>'$.decision_id') <> '' AND trim(x->>'$.equals') <> ''))
      < json_array_length(raw, '$.decision_conditions')""")))
def c6_check_decision_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return structure.check_decision_conditions(claim_objects(spark, sf))


@query("c7_check_nonempty", sql_with("v_runs", "v_reviews", body=_finding_sql(
    "V-000", "'Ledger field ''claims'' must not be empty.'", source="FROM (SELECT 'R-' || CAST(s_suppkey AS VARCHAR) AS ledger_id FROM supplier) l WHERE ledger_id NOT IN (SELECT ledger_id FROM v_runs)")))
def c7_check_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    ledgers = frame(spark, sf, "supplier").select(F.concat(F.lit("R-"), F.col("s_suppkey").cast("string")).alias("ledger_id"))
    return structure.check_nonempty(ledgers, claims(spark, sf))


@query("c8_conditional_required", sql_with("v_claims", "v_evidence", "v_artifacts", "v_reviews", body=
    _finding_sql("V-000", "'Derived claim needs a rule and a premise.'", "claim_id", "FROM v_claims WHERE claim_type = 'DERIVED' AND (derivation_rule IS NULL OR (dep1 IS NULL AND dep2 IS NULL AND dep3 IS NULL AND dep4 IS NULL))")
    + "\nUNION ALL " + _finding_sql("V-000", "'Evidence ' || evidence_id || ' names a source although nothing was retrieved.'", source="FROM v_evidence WHERE retrieval_method = 'none' AND source_id IS NOT NULL")
    + "\nUNION ALL " + _finding_sql("V-000", "'Evidence ' || evidence_id || ' names no source.'", source="FROM v_evidence WHERE retrieval_method <> 'none' AND source_id IS NULL")
    + "\nUNION ALL " + _finding_sql("V-000", "'Artifact ' || name || ' needs a path and content.'", source="FROM v_artifacts WHERE status = 'PRODUCED' AND (path IS NULL OR NOT non_empty)")
    + "\nUNION ALL " + _finding_sql("V-000", "'Artifact ' || name || ' needs a reason.'", source="FROM v_artifacts WHERE status <> 'PRODUCED' AND reason IS NULL")
    + "\nUNION ALL " + _finding_sql("V-000", "'Finding ' || finding_id || ' needs a remediation class.'", source="FROM v_reviews WHERE resolution IN ('ACCEPTED', 'PARTIAL', 'ESCALATED') AND remediation_class IS NULL")))
def c8_conditional_required(spark: SparkSession, sf: str) -> DataFrame:
    ev, art = evidence(spark, sf), frame(spark, sf, "v_artifacts")
    none = F.col("retrieval_method") == "none"
    made = F.col("status") == "PRODUCED"
    rule = structure.conditional_required
    say = refs._text
    return _union(
        rule(claims(spark, sf), F.col("claim_type") == "DERIVED", F.col("derivation_rule").isNotNull() & (F.size("depends_on") > 0), F.lit("Derived claim needs a rule and a premise.")),
        rule(ev, none, F.col("source_id").isNull(), say("Evidence ", F.col("evidence_id"), " names a source although nothing was retrieved.")),
        rule(ev, ~none, F.col("source_id").isNotNull(), say("Evidence ", F.col("evidence_id"), " names no source.")),
        rule(art, made, F.col("path").isNotNull() & F.col("non_empty"), say("Artifact ", F.col("name"), " needs a path and content.")),
        rule(art, ~made, F.col("reason").isNotNull(), say("Artifact ", F.col("name"), " needs a reason.")),
        rule(frame(spark, sf, "v_reviews"), F.col("resolution").isin("ACCEPTED", "PARTIAL", "ESCALATED"), F.col("remediation_class").isNotNull(),
             say("Finding ", F.col("finding_id"), " needs a remediation class.")),
    )


@query("c9_artifact_coverage", sql_with("v_requested", "v_artifacts", body=_finding_sql(
    "V-026", "'Requested output ' || name || ' was not produced.'",
    source="FROM v_requested r WHERE NOT EXISTS (SELECT 1 FROM v_artifacts a WHERE a.ledger_id = r.ledger_id AND a.name = r.name AND a.status = 'PRODUCED')")))
def c9_artifact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return structure.artifact_coverage(frame(spark, sf, "v_requested"), frame(spark, sf, "v_artifacts"))


# --- D: keys, references, states -----------------------------------------------------------------------------------

_V001 = _finding_sql("V-001", "'Duplicate Claim ID: ' || claim_id || '.'", "claim_id", f"FROM (SELECT ledger_id, claim_id FROM v_claims WHERE regexp_matches(claim_id, {ID_RE}) GROUP BY ALL HAVING count(*) > 1) x")
_DUP = "\nUNION ALL ".join(
    _finding_sql("V-000", f"'Duplicate {label} ID: ' || {key} || '.'", source=f"FROM (SELECT ledger_id, {key} FROM {table} WHERE trim({key}) <> '' GROUP BY ALL HAVING count(*) > 1) x")
    for table, key, label in (("v_sources", "source_id", "Source"), ("v_evidence", "evidence_id", "Evidence"))
)
_IDS = f"(SELECT DISTINCT ledger_id, claim_id FROM v_claims WHERE regexp_matches(claim_id, {ID_RE}))"
_V003 = _finding_sql("V-003", "'Claim ' || claim_id || ' depends on missing Claim ' || dep || '.'", "claim_id", f"FROM v_deps d WHERE NOT EXISTS (SELECT 1 FROM {_IDS} i WHERE i.ledger_id = d.ledger_id AND i.claim_id = d.dep)")


def _gone(table: str, key: str, end: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM {table} t WHERE t.ledger_id = e.ledger_id AND t.{key} = e.{end})"


_ENDS1 = (
    _finding_sql("V-000", "'EVIDENCED_BY edges require non-empty ''from'' and ''to'' IDs.'", source="FROM v_edges e WHERE type = 'EVIDENCED_BY' AND (trim(src) = '' OR trim(dst) = '')")
    + "\nUNION ALL " + _finding_sql("V-003", "'EVIDENCED_BY edge references missing Claim ' || src || '.'", "src", f"FROM v_edges e WHERE type = 'EVIDENCED_BY' AND {_gone('v_claims', 'claim_id', 'src')}")
    + "\nUNION ALL " + _finding_sql("V-003", "'EVIDENCED_BY edge references missing Evidence ' || dst || '.'", "src", f"FROM v_edges e WHERE type = 'EVIDENCED_BY' AND {_gone('v_evidence', 'evidence_id', 'dst')}")
)
_ENDS2 = (
    _finding_sql("V-000", "'RETRIEVED_FROM edges require non-empty ''from'' and ''to'' IDs.'", source="FROM v_edges e WHERE type = 'RETRIEVED_FROM' AND (trim(src) = '' OR trim(dst) = '')")
    + "\nUNION ALL " + _finding_sql("V-003", "'RETRIEVED_FROM edge references missing Evidence ' || src || '.'", source=f"FROM v_edges e WHERE type = 'RETRIEVED_FROM' AND trim(src) <> '' AND {_gone('v_evidence', 'evidence_id', 'src')}")
    + "\nUNION ALL " + _finding_sql("V-003", "'RETRIEVED_FROM edge references missing Source ' || dst || '.'", source=f"FROM v_edges e WHERE type = 'RETRIEVED_FROM' AND trim(src) <> '' AND {_gone('v_sources', 'source_id', 'dst')}")
)
_POS = "retrieval_method <> 'none'"
_V003P = _finding_sql("V-003", "'Positive-retrieval Evidence ' || evidence_id || ' references missing Source ' || coalesce(source_id, 'None') || '.'", source=f"FROM v_evidence e WHERE {_POS} AND {_gone('v_sources', 'source_id', 'source_id')}")
_LINKS = "(SELECT ledger_id, src AS evidence_id, count(*) AS n, min(dst) AS dst FROM v_edges WHERE type = 'RETRIEVED_FROM' AND trim(src) <> '' GROUP BY ALL)"
_V003E = _finding_sql("V-003", "'Evidence ' || e.evidence_id || ' must have exactly one RETRIEVED_FROM edge to ' || coalesce(source_id, 'None') || '.'", source=f"FROM v_evidence e LEFT JOIN {_LINKS} l USING (ledger_id, evidence_id) WHERE {_POS} AND NOT coalesce(n = 1 AND dst = source_id, false)")
_V003N = _finding_sql("V-003", "'Negative-retrieval Evidence ' || e.evidence_id || ' must have no Source or RETRIEVED_FROM edge.'", source=f"FROM v_evidence e LEFT JOIN {_LINKS} l USING (ledger_id, evidence_id) WHERE retrieval_method = 'none' AND (source_id IS NOT NULL OR n IS NOT NULL)")
_V025 = _finding_sql("V-025", "'Negative-retrieval Evidence ' || dst || ' requires stance=SILENT.'", "src", "FROM v_edges e WHERE type = 'EVIDENCED_BY' AND stance <> 'SILENT' AND EXISTS (SELECT 1 FROM v_evidence v WHERE v.ledger_id = e.ledger_id AND v.evidence_id = e.dst AND v.retrieval_method = 'none')")
_V025G = _finding_sql("V-025", "'Evidence ' || evidence_id || ' stores stance globally instead of on an EVIDENCED_BY edge.'", source="FROM v_evidence WHERE has_stance")
_V006 = _finding_sql("V-006", "'Supported Claim ' || claim_id || ' requires Claim-specific AFFIRMS or QUALIFIES Evidence.'", "claim_id", """FROM v_claims c
WHERE claim_type IN ('SOURCE', 'INTERPRETIVE', 'DEFINITION') AND claim_status IN ('SUPPORTED', 'SUPPORTED_CONDITIONAL') AND NOT EXISTS (
  SELECT 1 FROM v_edges e JOIN (SELECT ledger_id, evidence_id, arg_max(retrieval_method, pos) AS m FROM v_evidence GROUP BY ALL) v
    ON v.ledger_id = e.ledger_id AND v.evidence_id = e.dst
  WHERE e.type = 'EVIDENCED_BY' AND e.stance IN ('AFFIRMS', 'QUALIFIES') AND v.m <> 'none' AND e.ledger_id = c.ledger_id AND e.src = c.claim_id)""")
_CELLS = ", ".join(f"('{s}', '{e}', {'NULL' if c is None else chr(39) + c + chr(39)})" for s, row in voc.STATUS_MATRIX.items() for e, c in zip(voc.EVIDENCE_STATUSES, row))
_V005 = f"""SELECT ledger_id, CASE WHEN cell IS NULL THEN 'V-005' ELSE 'V-024' END AS rule_id, {BLOCK},
  CASE WHEN cell IS NULL THEN 'Illegal §3.5 combination for ' || claim_id || ': claim_status=' || s || ', evidence_status=' || e || '.'
    ELSE 'FLAG matrix cell for ' || claim_id || ' requires an explicit qualification.' END AS message, claim_id
FROM v_claims JOIN (VALUES {_CELLS}) m(s, e, cell) ON claim_status = s AND evidence_status = e
WHERE cell IS NULL OR (cell = 'FLAG' AND qualification IS NULL)"""
_NDEP = "((dep1 IS NOT NULL)::INT + (dep2 IS NOT NULL)::INT + (dep3 IS NOT NULL)::INT + (dep4 IS NOT NULL)::INT)"
_V008 = _finding_sql("V-008", f"'Derived Claim ' || claim_id || ' requires ' || concat_ws(' and ', CASE WHEN derivation_rule IS NULL THEN 'derivation_rule' END, CASE WHEN {_NDEP} = 0 THEN 'at least one dependency/premise' END) || '.'",
                     "claim_id", f"FROM v_claims WHERE claim_type = 'DERIVED' AND (derivation_rule IS NULL OR {_NDEP} = 0)")
_V006D = f"""SELECT ledger_id, 'V-006D' AS rule_id, {BLOCK}, 'Derived Claim ' || claim_id || ' outranks its premises: ' || string_agg(dep || '=' || st, ', ' ORDER BY slot) || '.' AS message, claim_id
FROM v_deps d JOIN (SELECT ledger_id, claim_id AS dep, arg_min(claim_status, pos) AS st FROM v_claims GROUP BY ALL) p USING (ledger_id, dep)
WHERE claim_type = 'DERIVED' AND derivation_rule IS NOT NULL AND (claim_status = 'SUPPORTED' AND st <> 'SUPPORTED' OR claim_status = 'SUPPORTED_CONDITIONAL' AND st NOT IN ('SUPPORTED', 'SUPPORTED_CONDITIONAL'))
GROUP BY ledger_id, claim_id, pos"""
LEDGER = ("v_claims", "v_deps", "v_sources", "v_evidence", "v_edges")


@query("d1_duplicate_claim_ids", sql_with("v_claims", body=_V001))
def d1(spark, sf):
    return refs.duplicate_claims(claims(spark, sf))


@query("d2_duplicate_object_ids", sql_with("v_sources", "v_evidence", body=_DUP))
def d2(spark, sf):
    return _union(refs.duplicate_keys(sources(spark, sf), "source_id", "Source"), refs.duplicate_keys(evidence(spark, sf), "evidence_id", "Evidence"))


@query("d3_dangling_dependencies", sql_with("v_claims", "v_deps", body=_V003))
def d3(spark, sf):
    return refs.dangling_refs(claims(spark, sf))


@query("d4_evidenced_by_endpoints", sql_with("v_claims", "v_evidence", "v_edges", body=_ENDS1))
def d4(spark, sf):
    return refs.evidenced_by_endpoints(edges(spark, sf), claims(spark, sf), evidence(spark, sf))


@query("d5_retrieved_from_endpoints", sql_with("v_sources", "v_evidence", "v_edges", body=_ENDS2))
def d5(spark, sf):
    return refs.retrieved_from_endpoints(edges(spark, sf), evidence(spark, sf), sources(spark, sf))


@query("d6_positive_evidence_source", sql_with("v_sources", "v_evidence", body=_V003P))
def d6(spark, sf):
    return refs.positive_evidence_source(evidence(spark, sf), sources(spark, sf))


@query("d7_exactly_one_edge", sql_with("v_evidence", "v_edges", body=_V003E))
def d7(spark, sf):
    return refs.exactly_one_edge(evidence(spark, sf), edges(spark, sf))


@query("d8_negative_retrieval_clean", sql_with("v_evidence", "v_edges", body=_V003N))
def d8(spark, sf):
    return refs.negative_retrieval_clean(evidence(spark, sf), edges(spark, sf))


@query("d9_silent_stance", sql_with("v_evidence", "v_edges", body=_V025))
def d9(spark, sf):
    return refs.silent_stance(edges(spark, sf), evidence(spark, sf))


@query("d10_global_stance", sql_with("v_evidence", body=_V025G))
def d10(spark, sf):
    return refs.global_stance(evidence(spark, sf))


@query("d11_unsupported_claims", sql_with("v_claims", "v_evidence", "v_edges", body=_V006))
def d11(spark, sf):
    return refs.unsupported_claims(claims(spark, sf), edges(spark, sf), evidence(spark, sf))


@query("d12_status_matrix", sql_with("v_claims", body=_V005))
def d12(spark, sf):
    return refs.status_matrix(claims(spark, sf))


@query("d13_derived_requirements", sql_with("v_claims", body=_V008))
def d13(spark, sf):
    return refs.derived_requirements(claims(spark, sf))


@query("d14_premise_rank", sql_with("v_claims", "v_deps", body=_V006D))
def d14(spark, sf):
    return refs.premise_rank(claims(spark, sf))


_ALL_FINDINGS = "\nUNION ALL ".join([_V001, _DUP, _V003, _ENDS1, _ENDS2, _V003P, _V003E, _V003N, _V025, _V025G, _V006, _V005, _V008, _V006D])


def reference_finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    tables = refs.stored(claims(spark, sf), sources(spark, sf), evidence(spark, sf), edges(spark, sf))
    return refs.finding_counts(refs.reference_findings(*tables))


@query("d15_validate_rule_tally", sql_with(*LEDGER, body=f"SELECT rule_id, severity, count(*) AS findings, count(DISTINCT ledger_id) AS ledgers FROM ({_ALL_FINDINGS}) f GROUP BY rule_id, severity"))
def d15_tally(spark, sf):
    return refs.rule_tally(reference_finding_counts(spark, sf))


@query("d15_validate_verdict", sql_with(*LEDGER, "v_runs", body=f"SELECT r.ledger_id, count(f.rule_id) = 0 AS ok, count(f.rule_id) AS finding_count FROM v_runs r LEFT JOIN ({_ALL_FINDINGS}) f ON f.ledger_id = r.ledger_id GROUP BY r.ledger_id"))
def d15_verdict(spark, sf):
    return refs.verdict(frame(spark, sf, "v_runs"), reference_finding_counts(spark, sf))


@query("d16_duplicate_text", sql_with("v_claims", body=_finding_sql(
    "V-002", "'Normalised claim shared by ' || CAST(n AS VARCHAR) || ' Claim IDs from ' || a || ' to ' || b || '.'", "a",
    "FROM (SELECT ledger_id, normalised_claim, min(claim_id) AS a, max(claim_id) AS b, count(DISTINCT claim_id) AS n FROM v_claims GROUP BY ALL HAVING count(DISTINCT claim_id) > 1) x")))
def d16(spark, sf):
    return refs.duplicate_text(claims(spark, sf))


_STALE = f"""SELECT ledger_id, CASE WHEN last_checked IS NULL THEN 'V-007' ELSE 'V-018' END AS rule_id, {BLOCK},
  'Time-sensitive Claim ' || claim_id || ' was last checked ' || coalesce(CAST(last_checked AS VARCHAR), 'never') || '.' AS message, claim_id
FROM v_claims JOIN v_runs USING (ledger_id) WHERE time_sensitive AND (last_checked IS NULL OR last_checked <> as_of_date)"""
_SPANNED = "SELECT 1 FROM v_spans s WHERE s.ledger_id = c.ledger_id AND s.claim_id = c.claim_id AND assertive"
_V010 = _finding_sql("V-010", "'Claim ' || c.claim_id || ' is rendered assertively but relies on violated Assumption ' || assumption_id || '.'", "c.claim_id",
    f"FROM (SELECT DISTINCT ledger_id AS lid, claim_id FROM v_claims) c0 JOIN (SELECT ledger_id, assumption_id, used_by1 AS claim_id FROM v_assumptions WHERE status = 'VIOLATED' UNION ALL SELECT ledger_id, assumption_id, used_by2 FROM v_assumptions WHERE status = 'VIOLATED') c ON c.ledger_id = lid AND c.claim_id = c0.claim_id WHERE EXISTS ({_SPANNED})")
_V011 = _finding_sql("V-011", "'Claim ' || claim_id || ' is asserted although Decision ' || blocked_by || ' is open.'", "claim_id",
    f"""FROM (SELECT DISTINCT ledger_id, claim_id, blocked_by FROM v_claims) c WHERE EXISTS ({_SPANNED} AND qualification_marker IS NULL)
    AND EXISTS (SELECT 1 FROM v_decisions d WHERE d.ledger_id = c.ledger_id AND d.decision_id = c.blocked_by AND blocking AND chosen IS NULL)
    AND NOT EXISTS (SELECT 1 FROM v_claims n WHERE n.ledger_id = c.ledger_id AND n.claim_id = c.claim_id AND n.condition_on = c.blocked_by)""")
_V016 = _finding_sql("V-016", "'SOURCE_CONFLICT of Claim ' || claim_id || ' has no escalation Finding.'", "claim_id",
    "FROM v_claims c WHERE evidence_status = 'SOURCE_CONFLICT' AND NOT EXISTS (SELECT 1 FROM v_reviews r WHERE r.ledger_id = c.ledger_id AND r.target_id = c.claim_id AND resolution = 'ESCALATED')")
_V017 = _finding_sql("V-017", "'Claim ' || claim_id || ' is still reopened.'", "claim_id", "FROM v_claims WHERE reopened")
_V014 = _finding_sql("V-014", "'Claim ' || claim_id || ' appears in missing span ' || span_id || '.'", "claim_id",
    "FROM (SELECT ledger_id, claim_id, span1 AS span_id FROM v_claims WHERE span1 IS NOT NULL UNION ALL SELECT ledger_id, claim_id, span2 FROM v_claims WHERE span2 IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM v_spans s WHERE s.ledger_id = c.ledger_id AND s.span_id = c.span_id)")
_V021 = _finding_sql("V-021", "'Rendered span ' || span_id || ' maps to no Claim.'",
    source="FROM v_spans s WHERE NOT EXISTS (SELECT 1 FROM v_claims c WHERE c.ledger_id = s.ledger_id AND c.claim_id = s.claim_id)")


@query("d17_stale_claims", sql_with("v_claims", "v_runs", body=_STALE))
def d17(spark, sf):
    return ledger_rules.stale_claims(claims(spark, sf), frame(spark, sf, "v_runs"))


@query("d18_blocked_rendering", sql_with("v_claims", "v_assumptions", "v_decisions", "v_spans", body=_V010 + "\nUNION ALL " + _V011))
def d18(spark, sf):
    c, s = claims(spark, sf), spans(spark, sf)
    return _union(ledger_rules.violated_rendering(c, assumptions(spark, sf), s), ledger_rules.blocked_rendering(c, frame(spark, sf, "v_decisions"), s))


@query("d19_citation_sufficiency", sql_with("v_evidence", "v_edges", "v_sources", body=f"""
SELECT ledger_id, CASE WHEN sufficient IS NULL THEN 'V-012' ELSE 'V-013' END AS rule_id, {BLOCK},
  CASE WHEN sufficient IS NULL THEN 'Claim ' || claim_id || ' cites missing Source ' || source_id || '.'
    ELSE 'Source ' || source_id || ' does not suffice for the citation by Claim ' || claim_id || '.' END AS message, claim_id
FROM (SELECT DISTINCT e.ledger_id, e.src AS claim_id, v.source_id FROM v_edges e JOIN v_evidence v ON v.ledger_id = e.ledger_id AND v.evidence_id = e.dst
  WHERE e.type = 'EVIDENCED_BY' AND e.stance IN ('AFFIRMS', 'QUALIFIES') AND v.source_id IS NOT NULL) x
LEFT JOIN v_sources USING (ledger_id, source_id) WHERE sufficient IS NULL OR sufficient <> 'citation'"""))
def d19(spark, sf):
    return ledger_rules.citation_sufficiency(evidence(spark, sf), edges(spark, sf), sources(spark, sf))


@query("d20_span_coverage", sql_with("v_claims", "v_spans", body=_V014 + "\nUNION ALL " + _V021))
def d20(spark, sf):
    return ledger_rules.span_coverage(claims(spark, sf), spans(spark, sf))


@query("d21_unescalated_conflict", sql_with("v_claims", "v_reviews", body=_V016))
def d21(spark, sf):
    return ledger_rules.unescalated_conflict(claims(spark, sf), frame(spark, sf, "v_reviews"))


@query("d22_reopened_claims", sql_with("v_claims", body=_V017))
def d22(spark, sf):
    return ledger_rules.reopened_claims(claims(spark, sf))


@query("d23_quantity_conflicts", sql_with("v_quantities", body=_finding_sql(
    "V-019", "'Quantity ' || quantity_id || ' has ' || CAST(n AS VARCHAR) || ' values for scenario ' || scenario || ', context ' || context || '.'",
    source="FROM (SELECT ledger_id, quantity_id, effective_from, scenario, context, count(DISTINCT (value, unit)) AS n FROM v_quantities GROUP BY ALL HAVING count(DISTINCT (value, unit)) > 1) x")))
def d23(spark, sf):

    return ledger_rules.quantity_conflicts(frame(spark, sf, "v_quantities"))


# --- F: gates and tallies ------------------------------------------------------------------------------------------

GATES = ["G-01", "G-02", "G-03", "G-04", "G-05", "G-06", "G-09", "G-10", "G-13", "G-15"]
_OFFENCES = f"""SELECT ledger_id, CASE rule_id WHEN 'V-008' THEN 'G-03' WHEN 'V-010' THEN 'G-04' WHEN 'V-017' THEN 'G-05' WHEN 'V-011' THEN 'G-06' WHEN 'V-007' THEN 'G-09'
    WHEN 'V-018' THEN 'G-09' WHEN 'V-016' THEN 'G-10' WHEN 'V-021' THEN 'G-13' END AS gate
  FROM ({_V008} UNION ALL {_V010} UNION ALL {_V017} UNION ALL {_V011} UNION ALL {_STALE} UNION ALL {_V016} UNION ALL {_V021}) f
  UNION ALL SELECT ledger_id, 'G-01' FROM v_reviews WHERE severity = 'BLOCKING' AND resolution = 'OPEN'
  UNION ALL SELECT a.ledger_id, 'G-15' FROM v_bundle a LEFT JOIN v_bundle_stored s ON s.path = a.path WHERE a.status = 'PRODUCED' AND coalesce(s.bytes, 0) = 0
  UNION ALL SELECT ledger_id, 'G-02' FROM v_claims c WHERE claim_status = 'SUPPORTED' AND evidence_status IN ('NOT_RETRIEVED', 'LICENSE_REQUIRED') AND EXISTS ({_SPANNED})"""
_GRID = "SELECT ledger_id, gate FROM v_runs, (VALUES " + ", ".join(f"('{g}')" for g in GATES) + ") g(gate)"
_COUNTS = f"SELECT ledger_id, gate, count(o.hit) AS offences FROM ({_GRID}) x LEFT JOIN (SELECT *, 1 AS hit FROM ({_OFFENCES}) y) o USING (ledger_id, gate) GROUP BY ledger_id, gate"
# a gate is left without input where the ledger number says so: a ledger without reviews, spans or decisions
_STATES = f"""SELECT ledger_id, gate, offences, CASE WHEN gate = 'G-04' AND n % 5 = 1 THEN 'NOT_APPLICABLE' WHEN gate IN ('G-01', 'G-10') AND n % 7 = 3 THEN 'NOT_EVALUATED'
  WHEN offences > 0 THEN 'FAIL' ELSE 'PASS' END AS state FROM (SELECT *, CAST(substring(ledger_id, 3) AS BIGINT) AS n FROM ({_COUNTS}) c) z"""
GATE_VIEWS = ("v_claims", "v_deps", "v_runs", "v_reviews", "v_assumptions", "v_decisions", "v_spans", "v_bundle", "v_bundle_stored")


def gate_counts(spark: SparkSession, sf: str) -> DataFrame:
    c, s, r = claims(spark, sf), spans(spark, sf), frame(spark, sf, "v_reviews")
    runs = frame(spark, sf, "v_runs")
    found = _union(
        refs.derived_requirements(c), ledger_rules.violated_rendering(c, assumptions(spark, sf), s), ledger_rules.reopened_claims(c),
        ledger_rules.blocked_rendering(c, frame(spark, sf, "v_decisions"), s), ledger_rules.stale_claims(c, runs),
        ledger_rules.unescalated_conflict(c, r), ledger_rules.span_coverage(c, s).filter("rule_id = 'V-021'"),
        ledger_rules.artifact_presence(frame(spark, sf, "v_bundle"), frame(spark, sf, "v_bundle_stored")),
    )
    offences = gates.findings_as_offences(found).unionByName(gates.open_blocking(r)).unionByName(gates.unbacked_assertions(c, s))
    return gates.gate_counts(runs, offences, GATES)


def gate_inputs(counts: DataFrame) -> DataFrame:
    n = F.substring("ledger_id", 3, 20).cast("bigint")
    return counts.select(
        "ledger_id", "gate",
        (~((F.col("gate") == "G-04") & (n % 5 == 1))).alias("applicable"),
        (~(F.col("gate").isin("G-01", "G-10") & (n % 7 == 3))).alias("available"),
    )


def gate_states(spark: SparkSession, sf: str) -> DataFrame:
    counts = gate_counts(spark, sf)
    grid = frame(spark, sf, "v_runs").select("ledger_id", F.explode(F.array(*[F.lit(g) for g in GATES])).alias("gate"))
    return gates.gate_states(counts, gate_inputs(grid))


@query("f1_gate_counts", sql_with(*GATE_VIEWS, body=_COUNTS))
def f1(spark, sf):
    return gate_counts(spark, sf)


@query("f2_gate_states", sql_with(*GATE_VIEWS, body=_STATES))
def f2(spark, sf):
    return gate_states(spark, sf)


@query("f3_release_status", sql_with(*GATE_VIEWS, body=f"""SELECT ledger_id, CASE WHEN bool_and(state IN ('PASS', 'NOT_APPLICABLE')) THEN 'RELEASED'
  WHEN bool_and(state IN ('PASS', 'NOT_APPLICABLE') OR state = 'NOT_EVALUATED' AND gate = 'G-10') THEN 'QUALIFIED_RELEASE' ELSE 'BLOCKED' END AS release_status FROM ({_STATES}) s GROUP BY ledger_id"""))
def f3(spark, sf):
    return gates.release_status(gate_states(spark, sf), waivable=["G-10"])


@query("f4_worst_of", sql_with(*GATE_VIEWS, body=f"""SELECT ledger_id, worst, CASE worst WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'CANNOT RUN' END AS verdict, worst = 0 AS releasable
FROM (SELECT ledger_id, coalesce(max(CASE state WHEN 'NOT_EVALUATED' THEN 2 WHEN 'FAIL' THEN 1 WHEN 'PASS' THEN 0 END), 2) AS worst FROM ({_STATES}) s GROUP BY ledger_id) w"""))
def f4(spark, sf):
    return gates.worst_of(gate_states(spark, sf))


@query("f5_claim_tally", sql_with("v_claims", body="SELECT claim_type, claim_status, evidence_status, count(*) AS claims FROM v_claims GROUP BY ROLLUP (claim_type, claim_status, evidence_status)"))
def f5(spark, sf):
    return gates.claim_tally(claims(spark, sf))


_NEW = """SELECT ledger_id, claim_id, CASE WHEN k % 19 = 0 THEN normalised_claim || ' (revised)' ELSE normalised_claim END AS normalised_claim,
  CASE WHEN reopened THEN 'UNESTABLISHED' ELSE claim_status END AS claim_status, evidence_status, concat_ws(',', span1, span2) AS places FROM v_unique WHERE NOT k % 113 = 7
  UNION ALL SELECT ledger_id, claim_id || '.new', normalised_claim, claim_status, evidence_status, concat_ws(',', span1, span2) FROM v_unique WHERE k % 127 = 3"""
_UNIQUE = "(SELECT * FROM v_claims WHERE k % 997 <> 0)"


@query("f6_change_log", sql_with("v_claims", body=f"""
SELECT coalesce(o.ledger_id, n.ledger_id) AS ledger_id, coalesce(o.claim_id, n.claim_id) AS claim_id,
  CASE WHEN o.claim_id IS NULL THEN 'added' WHEN n.claim_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  o.normalised_claim AS old_normalised_claim, o.claim_status AS old_claim_status, o.evidence_status AS old_evidence_status,
  n.normalised_claim AS new_normalised_claim, n.claim_status AS new_claim_status, n.evidence_status AS new_evidence_status, n.places AS affected_locations
FROM v_claims o FULL OUTER JOIN ({_NEW.replace('v_unique', 'v_claims')}) n ON n.ledger_id = o.ledger_id AND n.claim_id = o.claim_id
WHERE o.claim_id IS NULL OR n.claim_id IS NULL OR o.normalised_claim <> n.normalised_claim OR o.claim_status <> n.claim_status OR o.evidence_status <> n.evidence_status"""))
def f6(spark, sf):
    old = claims(spark, sf)
    revised = old.filter("NOT k % 113 = 7").select(
        "ledger_id", "claim_id",
        F.when(F.col("k") % 19 == 0, F.concat("normalised_claim", F.lit(" (revised)"))).otherwise(F.col("normalised_claim")).alias("normalised_claim"),
        F.when(F.col("reopened"), "UNESTABLISHED").otherwise(F.col("claim_status")).alias("claim_status"), "evidence_status", "appears_in",
    )
    added = old.filter("k % 127 = 3").select("ledger_id", F.concat("claim_id", F.lit(".new")).alias("claim_id"), "normalised_claim", "claim_status", "evidence_status", "appears_in")
    return gates.change_log(old, revised.unionByName(added))


@query("f7_remediation_queue", sql_with("v_reviews", body="""SELECT coalesce(remediation_class, '<unclassified>') AS remediation_class, count(*) AS findings,
  count(*) FILTER (severity = 'BLOCKING') AS blocking, count(DISTINCT ledger_id) AS ledgers FROM v_reviews WHERE resolution IN ('ACCEPTED', 'PARTIAL', 'ESCALATED') GROUP BY 1"""))
def f7(spark, sf):
    return gates.remediation_queue(frame(spark, sf, "v_reviews"))


@query("f8_licensed_requests", sql_with("v_claims", "v_evidence", "v_edges", "v_sources", body="""
SELECT ledger_id, source_id, claim_id, count(*) OVER (PARTITION BY ledger_id, source_id) AS claims_waiting FROM (
SELECT DISTINCT e.ledger_id, v.source_id, e.src AS claim_id FROM v_edges e
JOIN v_evidence v ON v.ledger_id = e.ledger_id AND v.evidence_id = e.dst JOIN v_sources s ON s.ledger_id = v.ledger_id AND s.source_id = v.source_id
JOIN v_claims c ON c.ledger_id = e.ledger_id AND c.claim_id = e.src
WHERE e.type = 'EVIDENCED_BY' AND c.evidence_status = 'LICENSE_REQUIRED' AND s.access IN ('LICENSED', 'PAYWALLED')) x"""))
def f8(spark, sf):
    return gates.licensed_requests(claims(spark, sf), evidence(spark, sf), edges(spark, sf), sources(spark, sf))


# --- E: graphs -----------------------------------------------------------------------------------------------------


_LAST_DEPS = f"""SELECT d.ledger_id, d.claim_id AS src, d.dep AS dst FROM v_deps d JOIN (SELECT ledger_id, claim_id, max(pos) AS pos FROM v_claims GROUP BY ALL) l USING (ledger_id, claim_id, pos)
WHERE regexp_matches(d.claim_id, {ID_RE}) AND EXISTS (SELECT 1 FROM {_IDS} i WHERE i.ledger_id = d.ledger_id AND i.claim_id = d.dep)"""


@query("e1_cycle_witnesses", sql_with("v_claims", "v_deps", body=f"""
WITH RECURSIVE e AS ({_LAST_DEPS}), walk AS (SELECT ledger_id, src, dst FROM e UNION SELECT w.ledger_id, w.src, e.dst FROM walk w JOIN e ON e.ledger_id = w.ledger_id AND e.src = w.dst),
home AS (SELECT a.ledger_id, a.src AS node, min(a.dst) AS home FROM walk a JOIN walk b ON b.ledger_id = a.ledger_id AND b.src = a.dst AND b.dst = a.src GROUP BY ALL),
inside AS (SELECT e.ledger_id, h.home, e.src, e.dst FROM e JOIN home h ON h.ledger_id = e.ledger_id AND h.node = e.src JOIN home g ON g.ledger_id = e.ledger_id AND g.node = e.dst AND g.home = h.home),
size AS (SELECT ledger_id, home, count(*) AS n FROM home GROUP BY ALL),
met AS (SELECT ledger_id, home, dst AS node, 1 AS length FROM inside WHERE src = home
  UNION SELECT i.ledger_id, i.home, i.dst, m.length + 1 FROM met m JOIN inside i ON i.ledger_id = m.ledger_id AND i.home = m.home AND i.src = m.node JOIN size s ON s.ledger_id = m.ledger_id AND s.home = m.home WHERE m.node <> m.home AND m.length < s.n),
short AS (SELECT ledger_id, home, node, min(length) AS length FROM met GROUP BY ALL),
parent AS (SELECT s.ledger_id, s.home, s.node, s.length, min(i.src) AS src FROM short s JOIN inside i ON i.ledger_id = s.ledger_id AND i.home = s.home AND i.dst = s.node
  LEFT JOIN short p ON p.ledger_id = i.ledger_id AND p.home = i.home AND p.node = i.src WHERE CASE WHEN i.src = s.home THEN s.length = 1 ELSE p.length = s.length - 1 END GROUP BY ALL),
back AS (SELECT * FROM parent WHERE node = home UNION SELECT p.* FROM back b JOIN parent p ON p.ledger_id = b.ledger_id AND p.home = b.home AND p.node = b.src WHERE b.src <> b.home)
SELECT ledger_id, 'V-004' AS rule_id, 'RELEASE_BLOCKING' AS severity, 'Dependency-cycle witness: ' || string_agg(src, ' -> ' ORDER BY length) || ' -> ' || home || '.' AS message, home AS claim_id FROM back GROUP BY ledger_id, home"""))
def e1(spark, sf):
    return graph.cycle_witnesses(graph.dependency_edges(claims(spark, sf)))


@query("e2_cycle_members", sql_with("v_claims", "v_deps", body=f"""
WITH RECURSIVE e AS ({_LAST_DEPS}), walk AS (SELECT ledger_id, src, dst FROM e UNION SELECT w.ledger_id, w.src, e.dst FROM walk w JOIN e ON e.ledger_id = w.ledger_id AND e.src = w.dst)
SELECT DISTINCT ledger_id, src AS node FROM walk WHERE src = dst"""))
def e2(spark, sf):
    return graph.cycle_members(graph.dependency_edges(claims(spark, sf)))


_TYPED = """SELECT ledger_id, claim_id AS src, dep AS dst FROM v_deps
UNION SELECT ledger_id, used_by1, assumption_id FROM v_assumptions UNION SELECT ledger_id, used_by2, assumption_id FROM v_assumptions
UNION SELECT ledger_id, claim_id, blocked_by FROM v_claims WHERE blocked_by IS NOT NULL"""
_REOPEN = f"""WITH RECURSIVE e AS ({_TYPED}), r AS (
  SELECT ledger_id, claim_id AS node FROM v_claims WHERE reopened UNION SELECT ledger_id, assumption_id FROM v_assumptions WHERE status = 'VIOLATED'
  UNION SELECT e.ledger_id, e.src FROM r JOIN e ON e.ledger_id = r.ledger_id AND e.dst = r.node)
"""


def typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    c, a = claims(spark, sf), assumptions(spark, sf)
    deps = c.select("ledger_id", F.col("claim_id").alias("src"), F.explode("depends_on").alias("dst"), F.lit("DEPENDS_ON").alias("type"))
    uses = a.select("ledger_id", F.explode("used_by").alias("src"), F.col("assumption_id").alias("dst"), F.lit("ASSUMES").alias("type"))
    blocks = c.select("ledger_id", F.col("claim_id").alias("src"), F.explode("blocked_by").alias("dst"), F.lit("BLOCKED_BY").alias("type"))
    return deps.unionByName(uses).unionByName(blocks)


def changed_objects(spark: SparkSession, sf: str) -> DataFrame:
    reopened = claims(spark, sf).filter("reopened").select("ledger_id", F.col("claim_id").alias("node"))
    violated = assumptions(spark, sf).filter("status = 'VIOLATED'").select("ledger_id", F.col("assumption_id").alias("node"))
    return reopened.unionByName(violated)


@query("e3_reopen_closure", sql_with("v_claims", "v_deps", "v_assumptions", body=_REOPEN + "SELECT DISTINCT ledger_id, node AS object_id, true AS reopened FROM r"))
def e3(spark, sf):
    return graph.reopen_closure(typed_edges(spark, sf), changed_objects(spark, sf))


@query("e4_invalidate_spans", sql_with("v_claims", "v_deps", "v_assumptions", body=_REOPEN + """
SELECT DISTINCT ledger_id, span_id FROM (SELECT ledger_id, claim_id, span1 AS span_id FROM v_claims UNION ALL SELECT ledger_id, claim_id, span2 FROM v_claims) c
WHERE span_id IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.ledger_id = c.ledger_id AND r.node = c.claim_id)"""))
def e4(spark, sf):
    return graph.invalidate_spans(graph.reopen_closure(typed_edges(spark, sf), changed_objects(spark, sf)), claims(spark, sf))


@query("e7_lineage", sql_with("v_claims", "v_evidence", "v_edges", "v_spans", body=f"""
SELECT DISTINCT r.ledger_id, r.dst AS source_id, r.src AS evidence_id, b.src AS claim_id, s.span_id, b.stance
FROM v_edges r JOIN v_edges b ON b.ledger_id = r.ledger_id AND b.dst = r.src JOIN v_spans s ON s.ledger_id = b.ledger_id AND s.claim_id = b.src
WHERE r.type = 'RETRIEVED_FROM' AND b.type = 'EVIDENCED_BY' AND EXISTS (SELECT 1 FROM v_evidence v WHERE v.ledger_id = r.ledger_id AND v.evidence_id = r.src)
  AND EXISTS (SELECT 1 FROM {_IDS} i WHERE i.ledger_id = b.ledger_id AND i.claim_id = b.src)"""))
def e7(spark, sf):
    return graph.lineage(claims(spark, sf), evidence(spark, sf), edges(spark, sf), spans(spark, sf))
