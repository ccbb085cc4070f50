"""Further ledger rules: staleness, assumptions and decisions, citations, spans, quantities, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditframe.operators.references import _text, finding_rows


def stale_claims(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Time-sensitive claims never checked, or not checked on the run date."""
    timed = claims.filter("time_sensitive").join(runs.select("ledger_id", "as_of_date"), "ledger_id")
    missing = F.col("last_checked").isNull()
    stale = timed.filter(missing | (F.col("last_checked") != F.col("as_of_date")))
    rows = finding_rows(stale, "V-018", _text("Time-sensitive Claim ", F.col("claim_id"), " was last checked ", F.coalesce(F.col("last_checked").cast("string"), F.lit("never")), "."), F.col("claim_id"))
    return rows.withColumn("rule_id", F.when(F.col("message").endswith(" never."), "V-007").otherwise("V-018"))


def _assertive(spans: DataFrame, unconditional: bool = False) -> DataFrame:
    chosen = spans.filter("assertive")
    if unconditional:
        chosen = chosen.filter("qualification_marker IS NULL")
    return chosen.select("ledger_id", F.explode("claim_ids").alias("claim_id")).distinct()


def violated_rendering(claims: DataFrame, assumptions: DataFrame, spans: DataFrame) -> DataFrame:
    """Assertively rendered claims that rest on a violated assumption."""
    uses = assumptions.filter("status = 'VIOLATED'").select("ledger_id", "assumption_id", F.explode("used_by").alias("claim_id"))
    resting = claims.select("ledger_id", "claim_id").distinct().join(uses, ["ledger_id", "claim_id"])
    hits = resting.join(_assertive(spans), ["ledger_id", "claim_id"], "left_semi")
    return finding_rows(hits, "V-010", _text("Claim ", F.col("claim_id"), " is rendered assertively but relies on violated Assumption ", F.col("assumption_id"), "."), F.col("claim_id"))


def blocked_rendering(claims: DataFrame, decisions: DataFrame, spans: DataFrame) -> DataFrame:
    """Unconditionally rendered claims blocked by an open blocking decision, unless the claim names that decision as a condition."""
    blocked = claims.select("ledger_id", "claim_id", F.explode("blocked_by").alias("decision_id")).distinct()
    named = claims.select("ledger_id", "claim_id", F.explode("decision_conditions.decision_id").alias("decision_id")).distinct()
    open_ones = decisions.filter("blocking AND chosen IS NULL").select("ledger_id", "decision_id")
    hits = (
        blocked.join(named, ["ledger_id", "claim_id", "decision_id"], "left_anti")
        .join(open_ones, ["ledger_id", "decision_id"], "left_semi")
        .join(_assertive(spans, unconditional=True), ["ledger_id", "claim_id"], "left_semi")
    )
    return finding_rows(hits, "V-011", _text("Claim ", F.col("claim_id"), " is asserted although Decision ", F.col("decision_id"), " is open."), F.col("claim_id"))


def citation_sufficiency(evidence: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited sources that do not exist (V-012) or do not suffice for a citation (V-013), one row per claim and source."""
    cited = (
        edges.filter("type = 'EVIDENCED_BY' AND stance IN ('AFFIRMS', 'QUALIFIES')")
        .select("ledger_id", F.col("src").alias("claim_id"), F.col("dst").alias("evidence_id"))
        .join(evidence.filter("source_id IS NOT NULL").select("ledger_id", "evidence_id", "source_id"), ["ledger_id", "evidence_id"])
        .select("ledger_id", "claim_id", "source_id")
        .distinct()
    )
    known = sources.select("ledger_id", "source_id", F.array_contains("sufficient_for", "citation").alias("citable"))
    judged = cited.join(known, ["ledger_id", "source_id"], "left").filter("citable IS NULL OR NOT citable")
    message = F.when(F.col("citable").isNull(), _text("Claim ", F.col("claim_id"), " cites missing Source ", F.col("source_id"), ".")).otherwise(
        _text("Source ", F.col("source_id"), " does not suffice for the citation by Claim ", F.col("claim_id"), ".")
    )
    return finding_rows(judged, "V-012", message, F.col("claim_id")).withColumn(
        "rule_id", F.when(F.col("message").startswith("Claim"), "V-012").otherwise("V-013")
    )


def span_coverage(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Locations of claims that are no rendered span (V-014), spans that map to no known claim (V-021)."""
    places = claims.select("ledger_id", "claim_id", F.explode("appears_in").alias("span_id"))
    lost = places.join(spans.select("ledger_id", "span_id").distinct(), ["ledger_id", "span_id"], "left_anti")
    mapped = spans.select("ledger_id", "span_id", F.explode("claim_ids").alias("claim_id")).join(
        claims.select("ledger_id", "claim_id").distinct(), ["ledger_id", "claim_id"], "left_semi"
    )
    bare = spans.join(mapped.select("ledger_id", "span_id").distinct(), ["ledger_id", "span_id"], "left_anti")
    return finding_rows(lost, "V-014", _text("Claim ", F.col("claim_id"), " appears in missing span ", F.col("span_id"), "."), F.col("claim_id")).unionByName(
        finding_rows(bare, "V-021", _text("Rendered span ", F.col("span_id"), " maps to no Claim."))
    )


def unescalated_conflict(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Source conflicts without an escalated finding."""
    raised = reviews.filter("resolution = 'ESCALATED'").select("ledger_id", F.col("target_id").alias("claim_id"))
    open_ones = claims.filter("evidence_status = 'SOURCE_CONFLICT'").join(raised, ["ledger_id", "claim_id"], "left_anti")
    return finding_rows(open_ones, "V-016", _text("SOURCE_CONFLICT of Claim ", F.col("claim_id"), " has no escalation Finding."), F.col("claim_id"))


def reopened_claims(claims: DataFrame) -> DataFrame:
    return finding_rows(claims.filter("reopened"), "V-017", _text("Claim ", F.col("claim_id"), " is still reopened."), F.col("claim_id"))


def quantity_conflicts(quantities: DataFrame) -> DataFrame:
    """Quantity identifiers whose value or unit disagrees within one (effective date, scenario, context)."""
    groups = quantities.groupBy("ledger_id", "quantity_id", "effective_from", "scenario", "context").agg(
        F.count_distinct(F.struct("value", "unit")).alias("versions")  # a missing unit is a unit of its own
    )
    bad = groups.filter("versions > 1")
    message = _text("Quantity ", F.col("quantity_id"), " has ", F.col("versions").cast("string"), " values for scenario ", F.col("scenario"), ", context ", F.col("context"), ".")
    return finding_rows(bad, "V-019", message)


def artifact_presence(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts listed as PRODUCED that storage does not hold, or holds empty; ``stored`` has (path, bytes)."""
    listed = manifest.filter("status = 'PRODUCED'").join(stored.select("path", "bytes"), "path", "left")
    bad = listed.filter("bytes IS NULL OR bytes = 0")
    state = F.when(F.col("bytes").isNull(), "missing").otherwise("empty")
    return finding_rows(bad, "V-026", _text("Artifact ", F.col("name"), " is listed as produced but ", state, "."))
