"""Vocabulary and stance checks parse only the objects whose text is doubtful, and find the same as if they parsed all of them."""

import json

from pyspark.sql import functions as F

from auditframe.operators import structure

CLAIM = {"claim_id": "C-1", "claim_type": "SOURCE", "claim_status": "SUPPORTED", "evidence_status": "PRIMARY_VERIFIED"}
EDGE = {"from": "C-1", "to": "E-1", "type": "EVIDENCED_BY", "stance": "AFFIRMS"}
VALUES = ["SOURCE", "HIGH", "SILENT", "x", "", " SOURCE", "null", 7, 7.5, True, None, ["HIGH"], {"a": "HIGH"}, "EVIDENCED_BY", "RETRIEVED_FROM", "é\n\"\\"]
BROKEN = ["", "null", "[]", '"a"', "7", "{", '{"claim_type":"x"', '{"claim_type":"x","claim_type":"SOURCE"}', '{"claim_type":"SOURCE","claim_type":"x"}', '{"claim_typ\\u0065":"x"}',
          '{"claim_type":"SOURC\\u0045"}', '{"claim_type":"x"} y', '[{"claim_type":"x"}]', '{"Claim_Type":"x"}', '{"claim_type":NaN}',
          '{"from":"C-1","to":"E-1","type":"EVIDENCED_BY","type":"RETRIEVED_FROM"}', '{"from":"C-1","to":"E-1","typ\\u0065":"EVIDENCED\\u005fBY","stance":"x"}', '{"from":"C-1","to":"E-1","type":"EVIDENCED_BY"}']


def objects(spark, base):
    texts = [json.dumps(base | {f: v}) for f in [*base, "severity_if_wrong"] for v in VALUES] + [json.dumps({k: v for k, v in base.items() if k != f}) for f in base]
    return spark.createDataFrame([("L", i, i, t) for i, t in enumerate([json.dumps(base), *texts, *BROKEN, None])], "ledger_id string, pos int, idx int, raw string")


def test_same_findings_as_with_all_texts_parsed(spark, monkeypatch):
    tables = {"claims": objects(spark, CLAIM), "sources": objects(spark, {"source_id": "S", "kind": "data", "access": "PUBLIC"}),
              "evidence": objects(spark, {"evidence_id": "E", "retrieval_method": "none"})}
    found = lambda: [sorted(map(str, structure.check_vocab(t, k).collect())) for k, t in tables.items()] + [sorted(map(str, structure.check_stances(objects(spark, EDGE)).collect()))]
    quick = found()
    monkeypatch.setattr(structure, "_doubtful", lambda df, fields, fine: structure.parsed(df))
    whole = found()
    assert all(quick)
    for some, every in zip(quick, whole):
        assert set(every) == set(some), (sorted(set(every) - set(some)), sorted(set(some) - set(every)))
    assert quick == whole


def test_sound_objects_are_not_parsed(spark):
    fields = structure.VOCABULARY["claims"]
    texts = [CLAIM, CLAIM | {"severity_if_wrong": "HIGH"}, CLAIM | {"claim_type": "x"}]
    df = spark.createDataFrame([("L", i, i, json.dumps(t)) for i, t in enumerate(texts)], "ledger_id string, pos int, idx int, raw string")
    told = structure._doubtful(df, list(fields), structure._in_vocabulary(fields)).orderBy("pos")
    assert [r[0] for r in told.select(F.col("v").isNull()).collect()] == [True, True, False]
