"""Canonical text of cells for digests, probes and comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The canonicalisation identifier and the text of missing and infinite values.
CANONICALISATION = "dec9-half-even-v1"
MISSING = "NA"
ZERO = "0.00000000e+00"


def _nine_digits(value: float) -> str:
    if value != value:
        return MISSING
    if value == 0:
        return ZERO
    if value in (float("inf"), float("-inf")):
        return "INF" if value > 0 else "-INF"
    return "%.8e" % value


@F.pandas_udf(T.StringType())
def _canonical_double(values: pd.Series) -> pd.Series:
    return pd.Series([_nine_digits(v) for v in values.to_numpy(dtype="float64", na_value=float("nan"))], dtype=object)


def canonical_number(col: Column) -> Column:
    """Nine significant digits, half-even on the exact binary value.

    The JVM formatter rounds the shortest decimal spelling half-up, so this one step runs as an Arrow function.
    """
    return _canonical_double(col.cast("double"))


def canonical_string(col: Column) -> Column:
    escaped = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.coalesce(escaped, F.lit(MISSING))


def canonical_date(col: Column) -> Column:
    return F.coalesce(F.unix_date(col.cast("date")).cast("string"), F.lit(MISSING))


def canonical_logical(col: Column) -> Column:
    return F.when(col.isNull(), MISSING).when(col, "true").otherwise("false")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.NumericType):
        return "num"
    return "str"


def canonical_cell(col: Column, kind: str) -> Column:
    """Text of one cell; ``kind`` is ``num``, ``date``, ``bool`` or ``str``."""
    if kind == "num":
        return canonical_number(col)
    if kind == "date":
        return canonical_date(col)
    if kind == "bool":
        return canonical_logical(col)
    return canonical_string(col.cast("string"))
