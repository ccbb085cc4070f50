"""Findings of rows: fields are read once, and what finds them is compiled, not interpreted inside a generator."""

import json

from pyspark.sql import functions as F

from auditframe.operators import profile, structure

ODD = [
    json.dumps({"a": "x", "b": 1}), json.dumps({"a": "é\n\t\"\\  ", "b": "  "}), '{"a":"\\u00e9\\ud83d\\ude00","b":null}', '{"a":7.0,"b":true}', '{"a":["x"],"b":{"a":"y"}}',
    '{"a":"","b":"\\u0000"}', '{"a":"1","a":"2"}', '{"a":"x"', '{"a":"x"} y', '[{"a":"x"}]', '"a"', "null", "", "{}", '{"A":"x","a b":"y"}', '{"a":"NaN","b":NaN}',
]


def generated(df):
    """The lines of the optimized plan that explode."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Generate explode" in line]


def test_taken_fields_read_as_before(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "n int, raw string").withColumn("ledger_id", F.lit("L"))
    old, new = structure.Raw(F.col("v")), structure.Taken()
    read = lambda raw: [f(n) for n in ("a", "b") for f in (raw.string, raw.type, raw.present, raw.shown, raw.strings, raw.is_null)]
    before = structure.parsed(df).select("n", *[c.alias(f"c{i}") for i, c in enumerate(read(old))])
    after = structure.taken(df, ["a", "b"]).select("n", *[c.alias(f"c{i}") for i, c in enumerate(read(new))])
    assert before.orderBy("n").collect() == after.orderBy("n").collect()


def test_shapes_are_checked_outside_the_generator(spark):
    raw = spark.createDataFrame([("L", 0, 0, ODD[0])], "ledger_id string, pos int, idx int, raw string")
    lines = generated(structure.check_types(raw, "claims"))
    assert lines and not any("CASE WHEN" in line for line in lines)


def test_offenders_are_found_outside_the_generator(spark):
    cells = spark.createDataFrame([(1, "2013-13-45", "x"), (2, "20130101", None), (3, "", "2013/13/45")], "row_index bigint, a string, b string")
    found = profile.first_offenders(cells, ["a", "b"], limit=5)
    lines = generated(found)
    assert lines and not any("CASE WHEN" in line for line in lines)
    assert sorted(tuple(r) for r in found.select("field", "row_index", "value").collect()) == [("a", 1, "2013-13-45"), ("b", 1, "x"), ("b", 3, "2013/13/45")]
