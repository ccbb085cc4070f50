"""End-to-end ledger validation: JSON text in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditframe.operators import graph, references as refs
from auditframe.operators.structure import check_nonempty, structure_findings
from auditframe.session import cut_lineage
from auditframe.sources import ledger as src


def validate_ledgers(ledgers: DataFrame) -> DataFrame:
    """All findings of stored ledgers, as ``ledger_state`` returns them."""
    objects = src.explode_ledger(ledgers)
    objects["runs"] = cut_lineage(objects["runs"])
    claims, sources = src.typed_claims(objects["claims"]), src.typed_sources(objects["sources"])
    evidence, edges = src.typed_evidence(objects["evidence"]), src.typed_edges(objects["edges"])
    lists = ledgers.filter("state = 'ok' AND try_variant_get(v, '$.claims', 'array<variant>') IS NOT NULL").select("ledger_id")
    listed = objects["claims"].select("ledger_id").unionByName(objects["item_findings"].filter("message LIKE 'Claim at%'").select("ledger_id"))
    return refs.union_findings(
        [src.root_findings(ledgers), objects["item_findings"], check_nonempty(lists, listed)]
        + structure_findings(objects)
        + refs.reference_findings(*refs.stored(claims, sources, evidence, edges))
        + [graph.cycle_witnesses(graph.dependency_edges(claims))]
    )


def validate_path(spark: SparkSession, path: str) -> DataFrame:
    return validate_ledgers(src.stored(src.read_ledger(spark, path)))
