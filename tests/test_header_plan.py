"""The records of a file do not all go to one task to meet its header candidates."""

from auditframe.sources.layout import detect_header
from auditframe.sources.records import assemble_records


def test_records_meet_header_candidates_where_they_are(spark):
    lines = spark.range(2_000).selectExpr("'a.csv' AS file", "id AS line_no", "CASE WHEN id = 0 THEN 'k,\"name, full\"' ELSE concat(id, ',\"x, ', id % 7, '\"') END AS line")
    lines = lines.unionByName(spark.createDataFrame([("one.csv", 1, "only,line")], "file string, line_no bigint, line string"))
    found = detect_header(assemble_records(lines), ",")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    rows = {r["file"]: (r["header_place"], r["names"]) for r in found.collect()}
    assert rows == {"a.csv": (1, "k|name, full"), "one.csv": (1, "only|line")}
