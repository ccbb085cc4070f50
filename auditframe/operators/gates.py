"""Release gates, roll-ups, tallies and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditframe.operators.references import status_matrix  # noqa: F401  (re-exported for callers of the gate set)

# Gate, the rules whose findings it counts, the tables it needs.
RULE_GATES = [
    ("G-03", ["V-008"], ["claims"]),
    ("G-04", ["V-010"], ["claims", "assumptions", "spans"]),
    ("G-05", ["V-017"], ["claims"]),
    ("G-06", ["V-011"], ["claims", "decisions", "spans"]),
    ("G-09", ["V-007", "V-018"], ["claims", "runs"]),
    ("G-10", ["V-016"], ["claims", "reviews"]),
    ("G-13", ["V-021"], ["claims", "spans"]),
    ("G-15", ["V-026"], ["artifacts"]),
]


def open_blocking(reviews: DataFrame) -> DataFrame:
    """G-01: blocking findings that are still open."""
    return reviews.filter("severity = 'BLOCKING' AND resolution = 'OPEN'").select("ledger_id", F.lit("G-01").alias("gate"))


def unbacked_assertions(claims: DataFrame, spans: DataFrame) -> DataFrame:
    """G-02: assertively rendered supported claims whose evidence was not retrieved or needs a licence."""
    told = spans.filter("assertive").select("ledger_id", F.explode("claim_ids").alias("claim_id")).distinct()
    weak = claims.filter("claim_status = 'SUPPORTED' AND evidence_status IN ('NOT_RETRIEVED', 'LICENSE_REQUIRED')")
    return weak.join(told, ["ledger_id", "claim_id"], "left_semi").select("ledger_id", F.lit("G-02").alias("gate"))


def gate_counts(ledgers: DataFrame, offences: DataFrame, gates: list[str]) -> DataFrame:
    """(ledger_id, gate, offences) for every ledger and gate, zero included; ``offences`` has (ledger_id, gate)."""
    wanted = F.array(*[F.lit(g) for g in gates])
    grid = ledgers.select("ledger_id", F.explode(wanted).alias("gate"))
    counted = offences.groupBy("ledger_id", "gate").agg(F.count("*").alias("n"))
    return grid.join(counted, ["ledger_id", "gate"], "left").select(
        "ledger_id", "gate", F.coalesce("n", F.lit(0)).cast("bigint").alias("offences")
    )


def findings_as_offences(findings: DataFrame) -> DataFrame:
    """Findings mapped to the gate that counts their rule."""
    gate = F.lit(None).cast("string")
    for name, rules, _ in RULE_GATES:
        gate = F.when(F.col("rule_id").isin(rules), name).otherwise(gate)
    return findings.select("ledger_id", gate.alias("gate")).filter("gate IS NOT NULL")


def gate_states(counts: DataFrame, inputs: DataFrame) -> DataFrame:
    """PASS / FAIL / NOT_EVALUATED / NOT_APPLICABLE; ``inputs`` has (ledger_id, gate, applicable, available).

    A gate whose input is missing is never a pass; a gate without an entry was not evaluated either.
    """
    joined = counts.join(inputs, ["ledger_id", "gate"], "left")
    state = (
        F.when(F.col("applicable") == F.lit(False), "NOT_APPLICABLE")
        .when(~F.coalesce("available", F.lit(False)), "NOT_EVALUATED")
        .when(F.col("offences") > 0, "FAIL")
        .otherwise("PASS")
    )
    return joined.select("ledger_id", "gate", "offences", state.alias("state"))


def release_status(states: DataFrame, waivable: list[str] | None = None) -> DataFrame:
    """RELEASED when every applicable gate passes, QUALIFIED_RELEASE when only waivable gates stay unevaluated, else BLOCKED."""
    soft = F.col("gate").isin(waivable or [])
    fine = F.col("state").isin("PASS", "NOT_APPLICABLE")
    limited = fine | ((F.col("state") == "NOT_EVALUATED") & soft)
    rolled = states.groupBy("ledger_id").agg(F.bool_and(fine).alias("all_fine"), F.bool_and(limited).alias("all_limited"))
    status = F.when(F.col("all_fine"), "RELEASED").when(F.col("all_limited"), "QUALIFIED_RELEASE").otherwise("BLOCKED")
    return rolled.select("ledger_id", status.alias("release_status"))


def worst_of(states: DataFrame) -> DataFrame:
    """Worst gate per ledger: 0 pass, 1 fail, 2 could not run; a ledger with nothing evaluated could not run."""
    code = F.when(F.col("state") == "NOT_EVALUATED", 2).when(F.col("state") == "FAIL", 1).when(F.col("state") == "PASS", 0)
    worst = F.coalesce(F.max(code), F.lit(2))
    label = F.when(F.col("worst") == 0, "PASS").when(F.col("worst") == 1, "FAIL").otherwise("CANNOT RUN")
    return states.groupBy("ledger_id").agg(worst.alias("worst")).select("ledger_id", "worst", label.alias("verdict"), (F.col("worst") == 0).alias("releasable"))


def claim_tally(claims: DataFrame) -> DataFrame:
    """Claims by type, status and evidence status with all sub-totals (null marks a total)."""
    return claims.rollup("claim_type", "claim_status", "evidence_status").agg(F.count("*").alias("claims"))


def change_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims whose text or state changed, appeared or vanished, with the affected locations."""
    fields = ["normalised_claim", "claim_status", "evidence_status"]
    a = old.select("ledger_id", "claim_id", *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("in_old"))
    b = new.select("ledger_id", "claim_id", *[F.col(f).alias(f"new_{f}") for f in fields], "appears_in", F.lit(True).alias("in_new"))
    both = a.join(b, ["ledger_id", "claim_id"], "full_outer")
    differs = F.col("in_old").isNull() | F.col("in_new").isNull()
    for f in fields:
        differs = differs | ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return both.filter(differs).select(
        "ledger_id", "claim_id", change.alias("change"), *[f"old_{f}" for f in fields], *[f"new_{f}" for f in fields],
        F.array_join("appears_in", ",").alias("affected_locations"),
    )


def remediation_queue(reviews: DataFrame) -> DataFrame:
    """Actionable findings by remediation class; those without a class stand under ``<unclassified>``."""
    actionable = reviews.filter("resolution IN ('ACCEPTED', 'PARTIAL', 'ESCALATED')")
    return actionable.groupBy(F.coalesce("remediation_class", F.lit("<unclassified>")).alias("remediation_class")).agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("severity") == "BLOCKING").alias("blocking"),
        F.count_distinct("ledger_id").alias("ledgers"),
    )


def licensed_requests(claims: DataFrame, evidence: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (licensed source, claim waiting for it) plus how many claims wait for that source."""
    waiting = claims.filter("evidence_status = 'LICENSE_REQUIRED'").select("ledger_id", "claim_id").distinct()
    links = edges.filter("type = 'EVIDENCED_BY'").select("ledger_id", F.col("src").alias("claim_id"), F.col("dst").alias("evidence_id"))
    held = evidence.filter("source_id IS NOT NULL").select("ledger_id", "evidence_id", "source_id").distinct()
    closed = sources.filter("access IN ('LICENSED', 'PAYWALLED')").select("ledger_id", "source_id")
    pairs = (
        links.join(waiting, ["ledger_id", "claim_id"], "left_semi")
        .join(held, ["ledger_id", "evidence_id"])
        .join(closed, ["ledger_id", "source_id"], "left_semi")
        .select("ledger_id", "source_id", "claim_id")
        .distinct()
    )
    totals = pairs.groupBy("ledger_id", "source_id").agg(F.count("*").alias("claims_waiting"))
    return pairs.join(totals, ["ledger_id", "source_id"])
