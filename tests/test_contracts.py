"""Contract lifecycle, preconditions and rendering on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from auditframe.operators import checks, lifecycle as lc
from auditframe.operators.ordering import exact_median
from auditframe.operators.profile import gaps, trend_breaks

HEADER = ["BSV", "abschlussdatum", "einloesungsdatum", "erstmalige_zuteilungsanwartschaft", "Tilgungsbeginn", "Vertragsende",
          "DaBetrag", "bausparsumme_teuro", "guthaben", "tariff_amount", "contract_type"]
DAY = "2026-03-31"

# Fixed fixtures: six sound rows and three broken ones.
GOOD = [
    ["700001", "2001-03-01", "2001-04-01", "20110401", "20110601", "20220601", "30000", "30", "12000", "0.4", "BS1"],
    ["700002", "2007-05-01", "2007-06-01", "20200101", "20200301", "20310301", "20000", "20", "11230", "0.4", "BS1"],
    ["700003", "2019-01-01", "2019-02-01", "20290201", "", "", "40000", "40", "4000", "0.4", "BS2"],
    ["700004", "2015-06-15", "2015-07-15", "20250715", "", "", "25000", "25", "18000", "0.35", "BSK"],
    ["700005", "2010-02-02", "2010-03-02", "20200302", "", "", "36.263,14", "36,263", "20.000,00", "0.5", "VL7"],
    ["700006", "2012-09-09", "2012-10-09", "20221009", "20230101", "20330101", "15000", "15", "9000", "0.3", "BS2"],
]
BAD = [
    ["700001", "2001-03-01", "2001-04-01", "20110401", "20110601", "20220601", "30000", "30000", "12000", "40", "BS1", "99"],
    ["700001", "2007-05-01", "2007-06-01", "2011/04/01", "", "", "20000", "20000", "-11230", "40", "BS1", "99"],
    ["700003", "2019-01-01", "2019-02-01", "20290201", "", "", "1,2,3", "40000", "4000", "40", "BS2", "99"],
]


def table(spark, rows, header=None):
    header = header or HEADER
    schema = "row_index bigint, " + ", ".join(f"{h} string" for h in header)
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], schema)


def test_good_and_bad_controls(spark):
    good = checks.preconditions(table(spark, GOOD), DAY)
    bad = checks.preconditions(table(spark, BAD, HEADER + ["guthaben_alt"]), DAY)
    rows = {r["id"]: r for r in checks.control_pair(good, bad).collect()}
    assert set(rows) == set(checks.IDS)
    assert not [r["id"] for r in rows.values() if r["cried_wolf"]]
    assert all(r["severity_kept"] for r in rows.values())
    for check in ("P-03", "P-05", "FND-02"):
        assert rows[check]["bad_status"] == "FAIL" and rows[check]["separates"]
    for check in ("P-06", "P-07", "P-10", "P-11", "P-13", "FND-04", "FND-06", "FND-12"):
        assert rows[check]["bad_status"] == "FLAGGED" and rows[check]["separates"]


def test_lifecycle_rows(spark):
    out = {r["id"]: r for r in lc.contract_lifecycle(table(spark, GOOD), DAY).collect()}
    assert out["700001"]["phase"] == "done" and out["700001"]["x_now"] == 1.0
    assert out["700002"]["phase"] == "loan" and out["700006"]["phase"] == "loan"
    assert out["700003"]["phase"] == "save" and out["700003"]["savings_ratio"] == 0.1
    assert out["700003"]["contract_end_date"].isoformat() == "2040-02-02"
    assert out["700004"]["phase"] == "oversave" and out["700004"]["saving_after_allocation"]
    assert out["700005"]["loan_notional"] == 36263.0 and out["700005"]["bauspar_sum"] == 36263.0
    assert list(out["700001"].asDict()) == ["row_index"] + lc.RECORD_COLUMNS


def test_fallbacks_and_missing_columns(spark):
    header = [h for h in HEADER if h not in ("contract_type", "tariff_amount")]
    rows = [["1", "", "NA", "0", "<NA>", "", "", "0", "5"]]
    r = lc.contract_lifecycle(table(spark, rows, header), DAY).first()
    assert r["contract_start_date"].isoformat() == "2019-03-31"  # valuation date minus 2557 days
    assert r["year_allocation"] == "~2029" and r["year_first_payment"] == "" and r["contract_type"] is None
    assert r["goal_source"] == "fallback_no_tariff" and r["goal_fraction"] == 0.4
    assert r["savings_ratio"] is None and r["loan_to_bauspar_ratio"] is None and r["phase"] == "save" and r["x_now"] == 0.06


def test_abort_record(spark):
    rows = [list(GOOD[0]) for _ in range(4)]
    rows[2][4] = "2013-13-45"
    rows[3][5] = "2013-13-45"
    assert lc.abort_record(table(spark, rows)).collect() == [("DATE_PARSE_ABORT", 3, "Tilgungsbeginn", "2013-13-45", 2)]
    assert lc.abort_record(table(spark, GOOD)).count() == 0
    # in a coerced column only the first non-missing value matters
    late = [list(GOOD[0]) for _ in range(3)]
    late[1][0 + 1] = "2013-13-45"
    assert lc.abort_record(table(spark, late)).count() == 0
    early = [list(GOOD[0]) for _ in range(3)]
    early[0][1], early[1][1] = "NA", "2013-13-45"
    assert lc.abort_record(table(spark, early)).collect() == [("DATE_PARSE_ABORT", 2, "abschlussdatum", "2013-13-45", 0)]


@pytest.mark.parametrize("first,outcome,expected", [
    ("2010-01-01", "coerced", ["2010-01-01", None, None]), ("2010/01/01", "coerced", ["2010-01-01", None, "2011-04-01"]),
    ("20100101", "all_missing", [None, None, None]), ("2010-99-01", "abort", [None, None, None]),
])
def test_column_coercion(spark, first, outcome, expected):
    df = spark.createDataFrame([(1, first), (2, "20110401"), (3, "2011/04/01")], "row_index bigint, d string")
    assert [r["outcome"] for r in lc.coercion_formats(df, ["d"]).collect()] == [outcome]
    got = [r["x"] for r in lc.coerce_date_column(df, "d", "x").orderBy("row_index").collect()]
    assert [None if g is None else g.isoformat() for g in got] == expected


def test_document(spark):
    rows = [list(GOOD[0]), list(GOOD[2])]
    rows[0][0] = 'a"\\'
    export = lc.export_rows(lc.contract_lifecycle(table(spark, rows), DAY))
    lines = [r["line_text"] for r in lc.render_document(export, DAY).orderBy("line_no").collect()]
    assert len(lines) == 6 and lines[1] == "// 2 contracts, valuation date 2026-03-31"
    assert lines[3].startswith('"a\\"\\":{"id":"a\\"\\\\","phase":"done","warn":0,"sr":0.4,') and lines[3].endswith("},")
    assert '"xl":null' in lines[4] and lines[4].endswith('"special":0}') and lines[5] == "};"


def test_exact_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [2.0] * 50 + [9.0] * 49, [float(i % 37) for i in range(1000)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
        ordered = sorted(values)
        n = len(ordered)
        want = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert exact_median(df, "v").collect() == [(want, n)]
    assert exact_median(spark.createDataFrame([], "v double"), "v").first()["values"] == 0


@pytest.mark.parametrize("chunk", [7, 1000])
def test_gaps_and_trends_do_not_depend_on_chunks(spark, chunk):
    keys = [(s, k) for s in ("a", "b") for k in range(60) if (k * 7 + len(s)) % 5]
    df = spark.createDataFrame(keys, "s string, k int")
    want = {(s, a, b) for s in ("a", "b") for a, b in zip([k for t, k in keys if t == s], [k for t, k in keys if t == s][1:]) if b - a > 1}
    assert {tuple(r) for r in gaps(df, "s", "k", chunk_rows=chunk).collect()} == want

    rows = [(s, i, float(i if i != 30 else 500)) for s in ("a", "b") for i in range(60)]
    got = trend_breaks(spark.createDataFrame(rows, "s string, i int, v double"), "s", ["i"], "v", chunk_rows=chunk).collect()
    assert sorted((r["s"], r["i"]) for r in got) == [("a", 30), ("a", 31), ("b", 30), ("b", 31)]


def test_a_lost_row_is_seen(spark):
    """P-09 compares the rows that the read observed with the records that were written."""
    df = table(spark, GOOD)
    cells = checks.stored_cells(df, DAY)
    status = lambda c: checks.evaluate(c, df.columns, ["P-09"]).first()
    whole, lost = status(cells), status(cells.filter("row_index <> 2"))
    assert (whole["status"], lost["status"]) == ("PASS", "FAIL")
    assert int(lost["evidence"]["rows_read"]) == int(lost["evidence"]["records_published"]) + 1
    assert status(checks.checked_cells(df, DAY))["status"] == "NOT_EXERCISED"


def test_a_few_checks_are_read_in_passing(spark, monkeypatch):
    """Only the columns of the chosen checks are computed: nothing is stored, and no date is parsed for the amounts."""
    df = table(spark, BAD, HEADER + ["surplus"])
    whole = {r["id"]: tuple(r) for r in checks.evidence_text(checks.preconditions(df, DAY)).collect()}
    monkeypatch.setattr(checks, "cut_lineage", lambda *a: pytest.fail("stored"))
    for only in (["P-06"], ["P-11"], ["P-13"], ["FND-11"]):
        cells = checks.cells_for(df, DAY, only=only)
        assert [tuple(r) for r in checks.evidence_text(checks.evaluate(cells, df.columns, only)).collect()] == [whole[i] for i in only]
    amounts = checks.evaluate(checks.cells_for(df, DAY, only=["P-06"]), df.columns, ["P-06"])
    assert "Tilgungsbeginn" not in amounts._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
