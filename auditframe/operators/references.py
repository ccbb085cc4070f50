"""Key, reference and state checks on typed ledger tables.

Tables carry ``ledger_id`` and ``pos`` (received order).  Which copy of a duplicated identifier counts differs by rule
and is decided with ``min_by``/``max_by``/``bool_or`` on ``pos``.  Groups are only ever reduced by combinable
aggregates, and every join is on (ledger, identifier), so one large ledger spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.text import has_content, is_claim_id
from auditframe.operators import vocabulary as voc
from auditframe.operators.structure import BLOCKING, FINDING
from auditframe.session import cut_lineage


def finding_rows(df: DataFrame, rule: str, message: Column, claim_id: Column | None = None) -> DataFrame:
    location = F.lit(None).cast("string") if claim_id is None else claim_id
    return df.select(
        "ledger_id",
        F.lit(rule).alias("rule_id"),
        F.lit(BLOCKING).alias("severity"),
        message.alias("message"),
        location.alias("claim_id"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _shown(claims: DataFrame) -> Column:
    return F.col("claim_shown") if "claim_shown" in claims.columns else F.coalesce("claim_id", F.lit("None"))


def known_ids(claims: DataFrame) -> DataFrame:
    return claims.filter(is_claim_id(F.col("claim_id"))).select("ledger_id", "claim_id").distinct()


# --- duplicates --------------------------------------------------------------------------------------------------


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """Well-formed claim identifiers used more than once."""
    counts = claims.filter(is_claim_id(F.col("claim_id"))).groupBy("ledger_id", "claim_id").count()
    repeated = counts.filter("count > 1")
    return finding_rows(repeated, "V-001", _text("Duplicate Claim ID: ", F.col("claim_id"), "."), F.col("claim_id"))


def duplicate_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """Identifiers of sources or evidence used more than once."""
    repeated = df.filter(has_content(F.col(key))).groupBy("ledger_id", key).count().filter("count > 1")
    return finding_rows(repeated, "V-000", _text(f"Duplicate {label} ID: ", F.col(key), "."))


def duplicate_text(claims: DataFrame) -> DataFrame:
    """The same normalised text under different identifiers: one row per text, counted, smallest identifier named."""
    groups = claims.groupBy("ledger_id", "normalised_claim").agg(
        F.min("claim_id").alias("first_id"), F.max("claim_id").alias("last_id"), F.count_distinct("claim_id").alias("ids")
    )
    repeated = groups.filter("ids > 1")
    message = _text("Normalised claim shared by ", F.col("ids").cast("string"), " Claim IDs from ", F.col("first_id"), " to ", F.col("last_id"), ".")
    return finding_rows(repeated, "V-002", message, F.col("first_id"))


# --- references --------------------------------------------------------------------------------------------------


def dangling_refs(claims: DataFrame) -> DataFrame:
    """One row per (claim, dependency) whose target claim does not exist."""
    refs = claims.select("ledger_id", "claim_id", _shown(claims).alias("shown"), F.explode("depends_on").alias("dep"))
    ids = known_ids(claims).withColumnRenamed("claim_id", "dep")
    missing = refs.join(ids, ["ledger_id", "dep"], "left_anti")
    message = _text("Claim ", F.col("shown"), " depends on missing Claim ", F.col("dep"), ".")
    return finding_rows(missing, "V-003", message, F.col("claim_id"))


def _edges_of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("type") == kind)


def _filled(edges: DataFrame) -> DataFrame:
    return edges.filter(has_content(F.col("src")) & has_content(F.col("dst")))


def _blank_ends(edges: DataFrame, kind: str) -> DataFrame:
    blank = _edges_of(edges, kind).filter(~(has_content(F.col("src")) & has_content(F.col("dst"))))
    return finding_rows(blank, "V-000", F.lit(f"{kind} edges require non-empty 'from' and 'to' IDs."))


def _ids(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.filter(has_content(F.col(key))).select("ledger_id", F.col(key).alias(name)).distinct()


def evidenced_by_endpoints(edges: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """EVIDENCED_BY edges with blank ends or ends that name no claim / no evidence."""
    links = _filled(_edges_of(edges, "EVIDENCED_BY"))
    no_claim = links.join(_ids(claims, "claim_id", "src"), ["ledger_id", "src"], "left_anti")
    no_evidence = links.join(_ids(evidence, "evidence_id", "dst"), ["ledger_id", "dst"], "left_anti")
    return (
        _blank_ends(edges, "EVIDENCED_BY")
        .unionByName(finding_rows(no_claim, "V-003", _text("EVIDENCED_BY edge references missing Claim ", F.col("src"), "."), F.col("src")))
        .unionByName(finding_rows(no_evidence, "V-003", _text("EVIDENCED_BY edge references missing Evidence ", F.col("dst"), "."), F.col("src")))
    )


def retrieved_from_endpoints(edges: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """RETRIEVED_FROM edges with blank ends or ends that name no evidence / no source."""
    links = _filled(_edges_of(edges, "RETRIEVED_FROM"))
    no_evidence = links.join(_ids(evidence, "evidence_id", "src"), ["ledger_id", "src"], "left_anti")
    no_source = links.join(_ids(sources, "source_id", "dst"), ["ledger_id", "dst"], "left_anti")
    return (
        _blank_ends(edges, "RETRIEVED_FROM")
        .unionByName(finding_rows(no_evidence, "V-003", _text("RETRIEVED_FROM edge references missing Evidence ", F.col("src"), ".")))
        .unionByName(finding_rows(no_source, "V-003", _text("RETRIEVED_FROM edge references missing Source ", F.col("dst"), ".")))
    )


def _positive(evidence: DataFrame) -> DataFrame:
    methods = [m for m in voc.RETRIEVAL_METHODS if m != "none"]
    return evidence.filter(has_content(F.col("evidence_id")) & F.col("retrieval_method").isin(methods))


def _negative(evidence: DataFrame) -> DataFrame:
    return evidence.filter(has_content(F.col("evidence_id")) & (F.col("retrieval_method") == "none"))


def _retrieved(evidence: DataFrame) -> DataFrame:
    """Positive and negative evidence."""
    return evidence.filter(has_content(F.col("evidence_id")) & F.col("retrieval_method").isin(voc.RETRIEVAL_METHODS))


def _source_links(edges: DataFrame) -> DataFrame:
    """Per evidence identifier: how many RETRIEVED_FROM edges, and their target when there is just one."""
    links = _filled(_edges_of(edges, "RETRIEVED_FROM"))
    return links.groupBy("ledger_id", F.col("src").alias("evidence_id")).agg(
        F.count("*").alias("links"), F.min("dst").alias("linked_source")
    )


def _source_shown(evidence: DataFrame) -> Column:
    name = "source_shown" if "source_shown" in evidence.columns else "source_id"
    return F.coalesce(F.col(name), F.lit("None"))


def positive_evidence_source(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Positive evidence whose source does not exist."""
    missing = _positive(evidence).join(_ids(sources, "source_id", "source_id"), ["ledger_id", "source_id"], "left_anti")
    message = _text("Positive-retrieval Evidence ", F.col("evidence_id"), " references missing Source ", _source_shown(evidence), ".")
    return finding_rows(missing, "V-003", message)


def link_faults(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Positive evidence that lacks exactly one RETRIEVED_FROM edge to its own source; negative retrieval that names a source or has such an edge."""
    linked = evidence.join(_source_links(edges), ["ledger_id", "evidence_id"], "left")
    right = F.coalesce((F.col("links") == 1) & (F.col("linked_source") == F.col("source_id")), F.lit(False))
    # a source is named by its id, whatever its text, or by a value of another type, which only the shown text holds
    named = F.col("source_id").isNotNull() | (_source_shown(evidence) != "None")
    negative = F.col("retrieval_method") == "none"
    faulty = linked.filter(F.when(negative, named | F.col("links").isNotNull()).otherwise(~right))
    message = F.when(negative, _text("Negative-retrieval Evidence ", F.col("evidence_id"), " must have no Source or RETRIEVED_FROM edge.")).otherwise(
        _text("Evidence ", F.col("evidence_id"), " must have exactly one RETRIEVED_FROM edge to ", _source_shown(evidence), ".")
    )
    return finding_rows(faulty, "V-003", message)


def exactly_one_edge(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Positive evidence that lacks exactly one RETRIEVED_FROM edge to its own source."""
    return link_faults(_positive(evidence), edges)


def negative_retrieval_clean(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Negative retrieval that names a source or carries a RETRIEVED_FROM edge."""
    return link_faults(_negative(evidence), edges)


def silent_stance(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """EVIDENCED_BY edges to negative retrieval with a stance other than SILENT (any copy of the evidence counts)."""
    negative = _negative(evidence).select("ledger_id", F.col("evidence_id").alias("dst")).distinct()
    loud = _filled(_edges_of(edges, "EVIDENCED_BY")).filter(F.col("stance").isin(voc.STANCES) & (F.col("stance") != "SILENT"))
    hits = loud.join(negative, ["ledger_id", "dst"], "left_semi")
    message = _text("Negative-retrieval Evidence ", F.col("dst"), " requires stance=SILENT.")
    return finding_rows(hits, "V-025", message, F.col("src"))


def global_stance(evidence: DataFrame) -> DataFrame:
    """Evidence that stores a stance on itself."""
    hits = evidence.filter(has_content(F.col("evidence_id")) & F.col("has_stance"))
    message = _text("Evidence ", F.col("evidence_id"), " stores stance globally instead of on an EVIDENCED_BY edge.")
    return finding_rows(hits, "V-025", message)


def unsupported_claims(claims: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Supported source/interpretive/definition claims without affirming evidence (last copy of the evidence counts)."""
    last = (
        evidence.filter(has_content(F.col("evidence_id")) & F.col("retrieval_method").isNotNull())
        .groupBy("ledger_id", F.col("evidence_id").alias("dst"))
        .agg(F.max_by("retrieval_method", "pos").alias("method"))
        .filter(F.col("method").isin([m for m in voc.RETRIEVAL_METHODS if m != "none"]))
    )
    backing = (
        _filled(_edges_of(edges, "EVIDENCED_BY"))
        .filter(F.col("stance").isin("AFFIRMS", "QUALIFIES"))
        .join(last, ["ledger_id", "dst"], "left_semi")
        .select("ledger_id", F.col("src").alias("claim_id"))
        .distinct()
    )
    needy = claims.filter(
        F.col("claim_type").isin("SOURCE", "INTERPRETIVE", "DEFINITION")
        & F.col("claim_status").isin("SUPPORTED", "SUPPORTED_CONDITIONAL")
        & has_content(F.col("claim_id"))
    )
    bare = needy.join(backing, ["ledger_id", "claim_id"], "left_anti")
    message = _text("Supported Claim ", F.col("claim_id"), " requires Claim-specific AFFIRMS or QUALIFIES Evidence.")
    return finding_rows(bare, "V-006", message, F.col("claim_id"))


# --- states ------------------------------------------------------------------------------------------------------


def matrix_table(spark) -> DataFrame:
    """The 48 cells (claim status, evidence status, cell); a fixed size, so it may be broadcast."""
    cells = [(s, e, c) for s, row in voc.STATUS_MATRIX.items() for e, c in zip(voc.EVIDENCE_STATUSES, row)]
    return spark.createDataFrame(cells, "claim_status string, evidence_status string, cell string")


def status_matrix(claims: DataFrame) -> DataFrame:
    """Illegal status pairs (V-005) and FLAG pairs without a qualification (V-024)."""
    judged = claims.join(F.broadcast(matrix_table(claims.sparkSession)), ["claim_status", "evidence_status"])
    shown = _shown(claims)
    illegal = F.col("cell").isNull()
    unqualified = (F.col("cell") == "FLAG") & ~has_content(F.col("qualification"))
    message = F.when(
        illegal,
        _text("Illegal §3.5 combination for ", shown, ": claim_status=", F.col("claim_status"), ", evidence_status=", F.col("evidence_status"), "."),
    ).otherwise(_text("FLAG matrix cell for ", shown, " requires an explicit qualification."))
    hits = judged.filter(illegal | unqualified)
    return finding_rows(hits, "V-005", message, F.col("claim_id")).withColumn(
        "rule_id", F.when(F.col("message").startswith("Illegal"), "V-005").otherwise("V-024")
    )


def _derivation_gaps() -> Column:
    no_rule = F.when(~has_content(F.col("derivation_rule")), "derivation_rule")
    no_premise = F.when(F.coalesce(F.size("depends_on"), F.lit(0)) <= 0, "at least one dependency/premise")
    return F.concat_ws(" and ", no_rule, no_premise)


def derived_requirements(claims: DataFrame) -> DataFrame:
    """Derived claims without a rule or without a premise."""
    gaps = claims.filter(F.col("claim_type") == "DERIVED").withColumn("gaps", _derivation_gaps()).filter("gaps != ''")
    message = _text("Derived Claim ", _shown(claims), " requires ", F.col("gaps"), ".")
    return finding_rows(gaps, "V-008", message, F.col("claim_id"))


def premise_rank(claims: DataFrame) -> DataFrame:
    """Derived claims stated more firmly than a premise (first copy of the premise counts)."""
    firm = claims.filter((F.col("claim_type") == "DERIVED") & F.col("claim_status").isin("SUPPORTED", "SUPPORTED_CONDITIONAL"))
    firm = firm.withColumn("gaps", _derivation_gaps()).filter("gaps = ''")
    refs = firm.select(
        "ledger_id", "pos", "claim_id", _shown(claims).alias("shown"), "claim_status", F.posexplode("depends_on").alias("dep_pos", "dep")
    )
    premises = (
        claims.filter(is_claim_id(F.col("claim_id")))
        .groupBy("ledger_id", F.col("claim_id").alias("dep"))
        .agg(F.min_by(F.struct("claim_status"), "pos").alias("first"))
        .select("ledger_id", "dep", F.col("first.claim_status").alias("premise_status"))
        .filter(F.col("premise_status").isin(voc.CLAIM_STATUSES))
    )
    admissible = (F.col("premise_status") == "SUPPORTED") | (
        (F.col("claim_status") == "SUPPORTED_CONDITIONAL") & (F.col("premise_status") == "SUPPORTED_CONDITIONAL")
    )
    weak = refs.join(premises, ["ledger_id", "dep"]).filter(~admissible)
    # at most the length of one claim's own dependency list per group
    lists = weak.groupBy("ledger_id", "pos", "claim_id", "shown").agg(
        F.array_sort(F.collect_list(F.struct("dep_pos", _text(F.col("dep"), "=", F.col("premise_status")).alias("text")))).alias("weak")
    )
    message = _text("Derived Claim ", F.col("shown"), " outranks its premises: ", F.array_join("weak.text", ", "), ".")
    return finding_rows(lists, "V-006D", message, F.col("claim_id"))


# --- verdicts ----------------------------------------------------------------------------------------------------


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*FINDING) for p in parts])


def stored(*tables: DataFrame) -> list[DataFrame]:
    """Typed tables written once, so that fifteen rules do not derive them fifteen times; identifiers that follow each other take little room in zstd."""
    return [cut_lineage(t, {"compression": "zstd"}) for t in tables]


def reference_findings(claims: DataFrame, sources: DataFrame, evidence: DataFrame, edges: DataFrame) -> list[DataFrame]:
    return [
        duplicate_keys(sources, "source_id", "Source"),
        duplicate_keys(evidence, "evidence_id", "Evidence"),
        evidenced_by_endpoints(edges, claims, evidence),
        retrieved_from_endpoints(edges, evidence, sources),
        positive_evidence_source(evidence, sources),
        link_faults(_retrieved(evidence), edges),
        silent_stance(edges, evidence),
        global_stance(evidence),
        unsupported_claims(claims, edges, evidence),
        duplicate_claims(claims),
        dangling_refs(claims),
        status_matrix(claims),
        derived_requirements(claims),
        premise_rank(claims),
    ]


def finding_counts(findings: list[DataFrame]) -> DataFrame:
    """(ledger_id, rule_id, severity, n) of the findings, counted and written rule by rule, so that the shuffles of one rule stand on disk at a time."""
    parts = [cut_lineage(f.groupBy("ledger_id", "rule_id", "severity").agg(F.count("*").alias("n"))) for f in findings]
    return reduce(lambda a, b: a.unionByName(b), parts)


def rule_tally(counts: DataFrame) -> DataFrame:
    return counts.groupBy("rule_id", "severity").agg(F.sum("n").alias("findings"), F.count_distinct("ledger_id").alias("ledgers"))


def verdict(ledgers: DataFrame, counts: DataFrame) -> DataFrame:
    """Per ledger: ``ok`` unless a finding is an ERROR or blocks release."""
    stops = F.col("severity").isin("ERROR", BLOCKING)
    counts = counts.groupBy("ledger_id").agg(F.sum("n").alias("finding_count"), F.bool_or(stops).alias("stopped"))
    joined = ledgers.select("ledger_id").join(counts, "ledger_id", "left")
    return joined.select(
        "ledger_id",
        (~F.coalesce("stopped", F.lit(False))).alias("ok"),
        F.coalesce("finding_count", F.lit(0)).cast("bigint").alias("finding_count"),
    )
