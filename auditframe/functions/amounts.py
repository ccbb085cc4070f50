"""Reading of amounts written with a decimal comma, and cell classification for profiling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from auditframe.functions.text import trim_cell

# Texts that make an amount missing.
AMOUNT_MARKERS = ["", "NA", "<NA>", "n/a", "-"]
# Fixed patterns: the accepted number grammar and the accepted spellings of the infinities.
NUMBER_PATTERN = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
INFINITY_PATTERN = r"\A[+-]?(Inf|inf|Infinity)\z"
NOT_A_NUMBER_PATTERN = r"\A[+-]?NaN\z"


def _body(trimmed: Column) -> Column:
    """With a comma present, dots are thousands separators and the comma is the decimal point."""
    swapped = F.translate(F.replace(trimmed, F.lit("."), F.lit("")), ",", ".")
    return F.when(trimmed.contains(","), swapped).otherwise(trimmed)


def amount(col: Column) -> Column:
    """Double held by one cell, null when missing or unreadable."""
    t = trim_cell(col)
    body = _body(t)
    infinite = F.when(body.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (
        F.when(t.isin(AMOUNT_MARKERS), None)
        .when(body.rlike(NUMBER_PATTERN), body.try_cast("double"))
        .when(body.rlike(INFINITY_PATTERN), infinite)
    )


def amount_class(col: Column) -> Column:
    """``marker``, ``comma_decimal``, ``plain`` or ``unparsed`` (null cell: null)."""
    t = trim_cell(col)
    body = _body(t)
    readable = body.rlike(NUMBER_PATTERN) | body.rlike(INFINITY_PATTERN) | body.rlike(NOT_A_NUMBER_PATTERN)
    return (
        F.when(t.isNull(), None)
        .when(t.isin(AMOUNT_MARKERS), "marker")
        .when(~readable, "unparsed")
        .when(t.contains(","), "comma_decimal")
        .otherwise("plain")
    )


def parse_de_number(col: Column) -> Column:
    """struct(value, how) for one cell."""
    return F.struct(amount(col).alias("value"), amount_class(col).alias("how"))


def is_finite(col: Column) -> Column:
    return F.coalesce(F.abs(col) < F.lit(float("inf")), F.lit(False))


# --- profiling kinds ---------------------------------------------------------------------------------------------

# Fixed values and patterns: cell kinds told apart by the profiler.
PROFILE_MARKERS = ["", "0", "00", "0000", "00000000", "NA", "<NA>"]
ISO_CELL = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
COMPACT_CELL = r"\A[0-9]{8}\z"
COMMA_NUMBER_CELL = r"\A(-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]+|-?[0-9]+,[0-9]+)\z"
PLAIN_NUMBER_CELL = r"\A-?[0-9]+(\.[0-9]+)?\z"


def classify_cell(col: Column) -> Column:
    return (
        F.when(col.isin(PROFILE_MARKERS), "empty_marker")
        .when(col.rlike(ISO_CELL), "date_iso")
        .when(col.rlike(COMPACT_CELL), "date_yyyymmdd")
        .when(col.rlike(COMMA_NUMBER_CELL), "number_de_comma")
        .when(col.rlike(PLAIN_NUMBER_CELL), "number_plain")
        .otherwise("text")
    )


def profile_number(col: Column) -> Column:
    """Number as the profiler sees it: compact dates and zero markers count as numbers too."""
    return F.when(col.rlike(COMMA_NUMBER_CELL), _body(col).try_cast("double")).when(
        col.rlike(PLAIN_NUMBER_CELL), col.try_cast("double")
    )


def profile_date(col: Column) -> Column:
    compact = F.concat_ws("-", F.substring(col, 1, 4), F.substring(col, 5, 2), F.substring(col, 7, 2))
    iso = F.when(col.rlike(ISO_CELL), col).when(col.rlike(COMPACT_CELL), compact)
    return F.when(~iso.startswith("0000"), iso.try_cast("date"))
