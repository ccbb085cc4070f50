"""Cell expressions against fixed vectors and an exact rational model."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from auditframe.functions.amounts import amount, amount_class, classify_cell
from auditframe.functions.canonical import canonical_number, canonical_string
from auditframe.functions.dates import date_class, mixed_date, year_label
from auditframe.functions.rendering import script_key, script_number, script_string
from auditframe.functions.rounding import round_columns, round_exact
from auditframe.functions.text import is_claim_id, is_exponent_id, is_iso_date


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)


def results(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


# Fixed vectors: (value, places, published value).
ROUNDING = [
    (0.1235, 3, 0.124), (0.0055, 3, 0.005), (0.0095, 3, 0.01), (0.0085, 3, 0.009), (0.0005, 3, 0.0),
    (0.0625, 3, 0.062), (0.1875, 3, 0.188), (0.4445, 3, 0.444), (-0.0055, 3, -0.005), (0.12345, 4, 0.1235),
    (0.5, 0, 0.0), (1.5, 0, 2.0), (2.5, 0, 2.0), (14500.5, 0, 14500.0), (14501.5, 0, 14502.0),
    (123456789.5, 0, 123456790.0),
]


@pytest.mark.parametrize("value,places,expected", ROUNDING)
def test_rounding_vectors(spark, value, places, expected):
    assert results(column(spark, [value], "double"), round_exact(F.col("x"), places)) == [expected]


def exact_round(x, places):
    if not math.isfinite(x) or x == 0:
        return x
    mag = Fraction(abs(x))
    k = math.floor(mag * 10**places)
    pair = [float(Fraction(k, 10**places)), float(Fraction(k + 1, 10**places))]
    d = [abs(Fraction(p) - mag) for p in pair]
    best = pair[0] if d[0] < d[1] or (d[0] == d[1] and k % 2 == 0) else pair[1]
    return math.copysign(best, x)


@pytest.mark.parametrize("places", [0, 3, 4])
def test_rounding_matches_exact_model(spark, places):
    rng = random.Random(places)
    values = [rng.uniform(-3, 3) for _ in range(300)]
    values += [round(rng.uniform(0, 5), 5) for _ in range(300)]
    values += [rng.randrange(10**6) / 2**rng.randrange(1, 14) for _ in range(300)]
    values += [math.ldexp(rng.random(), rng.randrange(-60, 80)) for _ in range(600)]
    values += [(2**51 + rng.randrange(2**20)) / 10**places for _ in range(300)]
    values += [(2**53 + rng.randrange(2**20)) / 10**places for _ in range(100)]
    values += [-0.0, 0.0, -0.0001, float("inf"), float("-inf")]
    df = column(spark, values, "double")
    got = results(df, round_exact(F.col("x"), places))
    staged = results(round_columns(df, {"x": places}), F.col("x"))
    want = [exact_round(v, places) for v in values]
    bits = lambda v: struct.pack(">d", v)
    assert [bits(v) for v in got] == [bits(v) for v in want]
    assert [bits(v) for v in staged] == [bits(v) for v in want]


def test_canonical_number_vectors(spark):
    # Fixed vectors.
    values = [1.0, -0.0, 2.0**-13, 1 / 3, 123456789.5, -2.5e-10, float("nan"), None, float("inf"), float("-inf")]
    want = ["1.00000000e+00", "0.00000000e+00", "1.22070312e-04", "3.33333333e-01", "1.23456790e+08",
            "-2.50000000e-10", "NA", "NA", "INF", "-INF"]
    assert results(column(spark, values, "double"), canonical_number(F.col("x"))) == want


def test_script_number_vectors_and_model(spark):
    # Fixed vectors.
    values = [0.4, 14500.0, 1e-7, -0.0, 1 / 3, 2.5e-7, 7.5e-7]
    want = ["0.4", "14500", "0", "-0", "0.333333", "0", "0.000001"]
    rng = random.Random(5)
    extra = [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.randrange(10**7) / 2**rng.randrange(20) for _ in range(500)]
    extra += [math.ldexp(rng.random(), rng.randrange(-30, 62)) for _ in range(500)] + [0.9999996, -0.9999999, -1e-9]

    def model(v):
        text = "%.6f" % v
        return text.rstrip("0").rstrip(".")

    df = column(spark, values + extra, "double")
    assert results(df, script_number(F.col("x"))) == want + [model(v) for v in extra]
    assert results(column(spark, [None, float("nan"), float("inf")], "double"), script_number(F.col("x"))) == [None] * 3


def test_text_escapes(spark):
    df = column(spark, ['a"b\\c', "x\ny\r", None], "string")
    assert results(df, script_string(F.col("x")))[0] == '"a\\"b\\\\c"'
    assert results(df, script_key(F.col("x"))) == ['a\\"b\\c', "x\ny\r", "NA"]
    assert results(df, canonical_string(F.col("x"))) == ['a"b\\\\c', "x\\ny\\r", "NA"]


def test_mixed_dates(spark):
    cases = {
        "20110401": "2011-04-01", "2013112": "2013-11-02", "20110401.0": "2011-04-01", "2011/04/01": None,
        "2011-04-01": "2011-04-01", " 2011-4-1 ": "2011-04-01", "2013-13-45": None, "00000000": None, "NA": None,
        "": None, "2011": None, "20110231": None, "2011/04/01-": "2011-04-01", "2011-04-01T00:00": "2011-04-01",
        "12-1-1": "0012-01-01", " 20110401﻿": "2011-04-01", "20200229": "2020-02-29", "201101011": "2011-01-01",
    }
    df = column(spark, list(cases), "string")
    got = [None if d is None else d.isoformat() for d in results(df, mixed_date(F.col("x")))]
    assert got == list(cases.values())
    kinds = results(df, date_class(F.col("x")))
    assert kinds[3] == "unreadable" and kinds[6] == "unreadable_hyphenated" and kinds[7] == "marker"
    assert kinds[4] == "hyphen_ok" and kinds[0] == "digits_ok"


def test_year_label(spark):
    df = spark.sql("select 1 i, date'2011-04-01' d union all select 2, date'0012-01-01' union all select 3, null")
    assert results(df, year_label(F.col("d"))) == ["2011", "0012", ""]
    assert results(df, year_label(F.col("d"), F.lit(True))) == ["~2011", "~0012", ""]


def test_amounts(spark):
    cases = {
        "36.263,14": 36263.14, "36.263": 36.263, "36,263": 36.263, "20.000,00": 20000.0, "1,2,3": None, "-11230": -11230.0,
        "": None, "NA": None, "n/a": None, "-": None, " 5 ": 5.0, "1d": None, "0x10": None, "1e3": 1000.0, ".5": 0.5,
        "Inf": math.inf, "-Infinity": -math.inf, "NaN": None, "+7": 7.0, "5.": 5.0,
    }
    df = column(spark, list(cases), "string")
    assert results(df, amount(F.col("x"))) == list(cases.values())
    assert results(df, amount_class(F.col("x")))[:2] == ["comma_decimal", "plain"]


def test_cell_kinds(spark):
    cases = {"": "empty_marker", "0": "empty_marker", "2011-04-01": "date_iso", "20110401": "date_yyyymmdd",
             "1.234,50": "number_de_comma", "1234,5": "number_de_comma", "-12.5": "number_plain", "BS1": "text"}
    assert results(column(spark, list(cases), "string"), classify_cell(F.col("x"))) == list(cases.values())


def test_predicates(spark):
    df = column(spark, ["C-001", "C--1", "C1\n", "X-1", "2026-08-21", "2026-02-30", "1.5e+10", "15"], "string")
    assert results(df, is_claim_id(F.col("x"))) == [True, False, False, False, False, False, False, False]
    assert results(df, is_iso_date(F.col("x"))) == [False] * 4 + [True, False, False, False]
    assert results(df, is_exponent_id(F.col("x"))) == [False] * 6 + [True, False]
