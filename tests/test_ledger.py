"""Ledger validation end to end: one small ledger per case, all validated in one job."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from auditframe.operators import graph
from auditframe.operators.contraction import longest_path
from auditframe.plans.validate import validate_ledgers
from auditframe.sources.ledger import ledger_state


def run():
    return {"run_id": "R", "as_of_date": "2026-08-21", "document_manifest": [], "requested_output_formats": ["json"],
            "strict_blind_audit_required": False, "prompt_version": "v2.2"}


def claim(cid, **over):
    base = {"claim_id": cid, "normalised_claim": f"About {cid}", "claim_type": "SOURCE", "claim_status": "SUPPORTED",
            "evidence_status": "PRIMARY_VERIFIED", "depends_on": []}
    return base | over


def ledger(*claims):
    out = {
        "run": run(), "claims": list(claims),
        "sources": [{"source_id": "S1", "kind": "internal", "identifier": "i", "title": "t", "version_label": None, "version_date": "2026-08-21",
                     "access": "INTERNAL", "locator": None, "sufficient_for": ["x"]}],
        "evidence": [{"evidence_id": "E1", "source_id": "S1", "retrieved_at": "2026-08-21", "retrieval_method": "internal_source", "fragment": None,
                      "extract": None, "supersession_checked": False, "superseded_by": [], "queries_attempted": [], "search_scope": None,
                      "agent": "A", "prompt_version": "v2.2"}],
        "edges": [{"from": "E1", "to": "S1", "type": "RETRIEVED_FROM"}],
    }
    out["edges"] += [{"from": c["claim_id"], "to": "E1", "type": "EVIDENCED_BY", "stance": "AFFIRMS"} for c in claims if isinstance(c.get("claim_id"), str)]
    return out


def changed(base, change):
    out = copy.deepcopy(base)
    change(out)
    return out


DERIVED = {"claim_type": "DERIVED", "derivation_rule": "follows"}
ONE = ledger(claim("C-1"))
CASES = {
    "valid": (ledger(claim("C-1"), claim("C-2", depends_on=["C-1"], **DERIVED)), set()),
    "duplicate_dangling": (ledger(claim("C-1", depends_on=["C-404"]), claim("C-1")), {"V-001", "V-003"}),
    "cycle_illegal": (ledger(claim("C-1", depends_on=["C-2"]), claim("C-2", evidence_status="NOT_RETRIEVED", depends_on=["C-1"])), {"V-004", "V-005"}),
    "flag": (ledger(claim("C-1", evidence_status="SECONDARY_ONLY")), {"V-024"}),
    "flag_qualified": (ledger(claim("C-1", evidence_status="SECONDARY_ONLY", qualification="only secondary")), set()),
    "derived_bare": (ledger(claim("C-1", **DERIVED)), {"V-008"}),
    "outranks": (ledger(claim("C-1", claim_status="UNESTABLISHED", evidence_status="NOT_RETRIEVED"), claim("C-2", depends_on=["C-1"], **DERIVED)), {"V-006D"}),
    "string_deps": (ledger(claim("C-1", depends_on="C-2"), claim("C-2")), {"V-000"}),
    "numeric_id": (ledger(claim(2)), {"V-000"}),
    "empty": ({"run": run(), "claims": []}, {"V-000"}),
    "no_run_fields": (changed(ONE, lambda x: x.update(run={"run_id": "R"})), {"V-000"}),
    "assumption_type": (ledger(claim("C-1", claim_type="ASSUMPTION")), {"V-000"}),
    "list_type": (ledger(claim("C-1", claim_type=["SOURCE"])), {"V-000"}),
    "missing_source": (changed(ONE, lambda x: x["evidence"][0].update(source_id="S9")), {"V-003"}),
    "no_evidence": (changed(ONE, lambda x: x["edges"].pop()), {"V-006"}),
    "silent": (changed(ONE, lambda x: x["edges"][1].update(stance="SILENT")), {"V-006"}),
    "negative_with_source": (changed(ONE, lambda x: x["evidence"][0].update(retrieval_method="none")), {"V-003", "V-006", "V-025"}),
    "blank_edge": (changed(ONE, lambda x: x["edges"].append({"from": " ", "to": "E1", "type": "EVIDENCED_BY"})), {"V-000"}),
    "odd_stance": (changed(ONE, lambda x: x["edges"].append({"from": "C-1", "to": "E1", "type": "EVIDENCED_BY", "stance": {"a": 1}})), {"V-000"}),
    "duplicate_source": (changed(ONE, lambda x: x["sources"].append(x["sources"][0])), {"V-000"}),
    "global_stance": (changed(ONE, lambda x: x["evidence"][0].update(stance="AFFIRMS")), {"V-000", "V-025"}),
    "compact_date": (changed(ONE, lambda x: x["sources"][0].update(version_date="20260821")), {"V-000"}),
    "blank_sufficiency": (changed(ONE, lambda x: x["sources"][0].update(sufficient_for=[""])), {"V-000"}),
    "claims_not_list": (changed(ONE, lambda x: x.update(claims="x")), {"V-000", "V-003"}),
    "not_object": ([], {"V-000"}),
}


def test_cases(spark):
    rows = [(name, json.dumps(body)) for name, (body, _) in CASES.items()] + [("broken", "{")]
    found = validate_ledgers(ledger_state(spark.createDataFrame(rows, "ledger_id string, raw string")))
    got = {}
    for r in found.select("ledger_id", "rule_id", "message").collect():
        got.setdefault(r["ledger_id"], {}).setdefault(r["rule_id"], []).append(r["message"])
    for name, (_, rules) in CASES.items():
        assert set(got.get(name, {})) == rules, (name, got.get(name))
    assert got["cycle_illegal"]["V-004"] == ["Dependency-cycle witness: C-1 -> C-2 -> C-1."]
    assert got["empty"]["V-000"] == ["Ledger field 'claims' must not be empty."]
    assert got["outranks"]["V-006D"] == ["Derived Claim C-2 outranks its premises: C-1=UNESTABLISHED."]
    assert set(got["broken"]) == {"V-000"}


def witnesses(edges):
    """Model: in every strongly connected set the shortest closed walk through its smallest node, by the smallest node before each."""
    closed, out = closure(edges), set()
    for home in {min(b for b, d in closed if d == a and (a, b) in closed) for a, x in closed if a == x}:
        inside = {n for n, d in closed if d == home and (home, n) in closed}
        length, now = {}, {home}
        while home not in length:
            step = {d for s, d in edges if s in now and d in inside and d not in length}
            length |= dict.fromkeys(step, len(set(length.values())) + 1)
            now = step
        node, walk = home, [home]
        while node != home or len(walk) == 1:
            node = min(s for s, d in edges if d == node and s in inside and (length[node] == 1 if s == home else length.get(s) == length[node] - 1))
            walk.append(node)
        out.add(" -> ".join(reversed(walk)))
    return out


def closure(edges):
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            return reach
        reach = more


def members(edges):
    return {a for a, b in closure(edges) if a == b}


EDGES = "ledger_id string, src string, dst string"


def test_cycles_against_models(spark):
    rng = random.Random(3)
    graphs = {f"L{g:02d}": {(f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(rng.randrange(4, 18))} for g in range(24)}
    ring = [f"r{i:02d}" for i in range(20)]
    graphs["chained"] = set(zip(ring, ring[1:] + ring[:1])) | {("r05", "t1"), ("t1", "t2"), ("t2", "r05"), ("a0", "r03"), ("r10", "z0"), ("z0", "z1"), ("r07", "s1"), ("s1", "s2"), ("s2", "r09"), ("r07", "q1"), ("q1", "r09")}
    graphs["loops"] = {("a", "a"), ("b", "c"), ("c", "b"), ("c", "c"), ("c", "d")}
    df = spark.createDataFrame([(g, s, d) for g, edges in graphs.items() for s, d in edges] + [("loops", "a", "a")], EDGES)
    assert {(r[0], r[1]) for r in graph.cycle_members(df).collect()} == {(g, m) for g, edges in graphs.items() for m in members(edges)}
    found = graph.cycle_witnesses(df).select("ledger_id", F.regexp_extract("message", "witness: (.*)\\.", 1)).collect()
    assert sorted((r[0], r[1]) for r in found) == sorted((g, w) for g, edges in graphs.items() for w in witnesses(edges))
    assert graph.cycle_witnesses(df.limit(0)).count() == 0


def test_deep_graphs_take_few_rounds(spark):
    n = 3000
    name = lambda i: f"n{i:04d}"
    deep = spark.createDataFrame([("chain", name(i), name(i + 1)) for i in range(n)] + [("ring", name(i), name((i + 1) % n)) for i in range(n)], EDGES)
    assert {r["ledger_id"] for r in graph.cycle_members(deep).collect()} == {"ring"}
    (row,) = graph.cycle_witnesses(deep).collect()
    assert row["message"] == "Dependency-cycle witness: " + " -> ".join(name(i % n) for i in range(n + 1)) + "."
    seeds = spark.createDataFrame([("chain", name(5)), ("ring", name(7))], "ledger_id string, node string")
    assert {r["ledger_id"]: r["count"] for r in graph.reach(deep, seeds).groupBy("ledger_id").count().collect()} == {"chain": n - 4, "ring": n}
    assert longest_path(deep.filter("ledger_id = 'chain'")) == n and longest_path(deep) is None


def test_reach_against_a_model(spark):
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)} | {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)} | {("c12", "n01"), ("n02", "c00"), ("c40", "c20")}
    df = spark.createDataFrame([("L", s, d) for s, d in edges], EDGES)
    for seeds in (["c00"], ["n05", "c33"], ["nowhere"]):
        want = set(seeds) | {d for s, d in closure(edges) if s in seeds}
        got = graph.reach(df, spark.createDataFrame([("L", x) for x in seeds], "ledger_id string, node string")).collect()
        assert sorted(r["node"] for r in got) == sorted(want)


def test_longest_path(spark):
    rows = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "c"), ("d", "e"), ("y", "x"), ("z", "y"), ("q", "z")]
    assert longest_path(spark.createDataFrame([("", *r) for r in rows], EDGES)) == 6
    assert longest_path(spark.createDataFrame([], EDGES)) == 0


def test_large_ledgers_are_stored_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    from auditframe.sources.ledger import explode_ledger

    claim = F.concat(F.lit('{"claim_id":"C-'), F.col("i").cast("string"), F.lit('","x":"'), F.sha2(F.concat_ws("-", "id", "i"), 256), F.lit('"}'))
    items = spark.range(0, 120, 1, 1).select("id", F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("i")).select("id", "i", claim.alias("raw"))
    raw = items.groupBy(F.concat(F.lit("R-"), "id").alias("ledger_id")).agg(F.concat(F.lit('{"run":{},"claims":[5,'), F.array_join(F.collect_list("raw"), ","), F.lit("]}")).alias("raw"))
    ledgers = ledger_state(raw.coalesce(1))
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in ledgers.inputFiles()]
    sizes = [g.row_group(i).total_byte_size for g in groups for i in range(g.num_row_groups)]
    assert sum(sizes) > 28 << 20 and max(sizes) < 20 << 20
    claims = explode_ledger(ledgers)["claims"]
    assert claims.agg(F.count("*"), F.min("pos"), F.max(F.abs(F.col("pos") - F.col("idx") - 1))).first()[:] == (360_000, 1, 0)


def test_longest_path_of_a_shallow_graph_needs_no_search_for_cycles(spark, monkeypatch):
    from auditframe.operators import contraction

    layers = spark.createDataFrame([("", f"n{k}-{i}", f"n{k + 1}-{j}") for k in range(5) for i in range(3) for j in range(3)], EDGES)
    turn = spark.createDataFrame([("", "n5-0", "n1-1")], EDGES)
    deep = spark.createDataFrame([("", *e) for k in range(6) for e in ((f"c{k}", f"c{k + 1}"), (f"c{k}", f"leaf{k}"))] + [("", "c6", "c5")], EDGES)
    with monkeypatch.context() as m:
        m.setattr(contraction, "without_dead_ends", None)
        assert longest_path(layers) == 5
        assert longest_path(layers.unionByName(turn)) is None
    monkeypatch.setattr(contraction, "PEELED", 1)
    assert longest_path(deep) is None and longest_path(layers) == 5


def test_reading_ledgers_stores_nothing(spark, tmp_path, monkeypatch):
    import gzip

    from auditframe.sources import ledger as src

    (tmp_path / "a.json").write_text('{"claims": [],\n "run": {}}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(b"{"))
    monkeypatch.setattr(src, "cut_lineage", None)
    assert sorted(r["state"] for r in src.read_ledger(spark, str(tmp_path)).collect()) == ["not_object", "ok", "unreadable"]
