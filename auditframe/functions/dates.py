"""Reading of mixed-format date cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from auditframe.functions.text import trim_cell

# Texts that mean "this event has not happened".
DATE_MARKERS = ["", "0", "00", "0000", "00000000", "NA", "<NA>"]
# The window of believable dates.
PLAUSIBLE_FROM = "1950-01-01"
PLAUSIBLE_TO = "2100-01-01"

# Fixed patterns: year, month and day fields of at most 4/2/2 digits; what follows the day is ignored.
HYPHEN_FORM = r"(?s)\A([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2}).*\z"
SLASH_FORM = r"(?s)\A([0-9]{1,4})/([0-9]{1,2})/([0-9]{1,2}).*\z"
# With a greedy scan that never gives digits back, only a four-digit year followed by a two-digit month can succeed.
DIGIT_FORM = r"\A[0-9]{7}"


def _calendar(text: Column, pattern: str) -> Column:
    """Date from the three captured fields, null when the form or the calendar rejects the text."""
    fields = F.regexp_replace(text, pattern, "000$1-$2-$3")
    padded = F.regexp_replace(fields, r"\A0*([0-9]{4}-)", "$1")
    return F.when(text.rlike(pattern), padded.try_cast("date"))


def _hyphen_date(t: Column) -> Column:
    """``Y-m-d``; the full ten-character form needs no pattern."""
    full = (F.octet_length(t) == 10) & (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    return F.when(full, t.try_cast("date")).otherwise(_calendar(t, HYPHEN_FORM))


def is_marker(trimmed: Column) -> Column:
    return trimmed.isin(DATE_MARKERS)


def separated_date(trimmed: Column, form: str) -> Column:
    return _hyphen_date(trimmed) if form == "-" else _calendar(trimmed, SLASH_FORM)


def unambiguous_date(trimmed: Column) -> Column:
    """``Y-m-d`` first, then ``Y/m/d``."""
    return F.coalesce(separated_date(trimmed, "-"), separated_date(trimmed, "/"))


def digit_date(trimmed: Column) -> Column:
    two_digit_day = F.substring(trimmed, 8, 1).between("0", "9")
    day = F.when(two_digit_day, F.substring(trimmed, 7, 2)).otherwise(F.substring(trimmed, 7, 1))
    text = F.concat(F.substring(trimmed, 1, 4), F.lit("-"), F.substring(trimmed, 5, 2), F.lit("-"), day)
    return F.when(trimmed.rlike(DIGIT_FORM), text.try_cast("date"))


def mixed_date(col: Column) -> Column:
    """Date held by one mixed-format cell; null for markers and unreadable text."""
    t = trim_cell(col)
    return F.when(is_marker(t), None).when(t.contains("-"), unambiguous_date(t)).otherwise(digit_date(t))


def date_class(col: Column) -> Column:
    """``marker``, ``hyphen_ok``, ``digits_ok``, ``unreadable`` or ``unreadable_hyphenated`` (null cell: null)."""
    t = trim_cell(col)
    return (
        F.when(t.isNull(), None)
        .when(is_marker(t), "marker")
        .when(t.contains("-"), F.when(unambiguous_date(t).isNotNull(), "hyphen_ok").otherwise("unreadable_hyphenated"))
        .otherwise(F.when(digit_date(t).isNotNull(), "digits_ok").otherwise("unreadable"))
    )


def parse_mixed_date(col: Column) -> Column:
    """struct(date, how) for one cell."""
    return F.struct(mixed_date(col).alias("date"), date_class(col).alias("how"))


def standard_form(col: Column) -> Column:
    """Which separator form a text reads under: ``-``, ``/`` or null."""
    t = trim_cell(col)
    return F.when(separated_date(t, "-").isNotNull(), "-").when(separated_date(t, "/").isNotNull(), "/")


def year_label(date: Column, estimated: Column | None = None) -> Column:
    """Four-digit year, ``~`` in front when the date was estimated, empty when missing."""
    year = F.lpad(F.year(date).cast("string"), 4, "0")
    label = F.coalesce(year, F.lit(""))
    if estimated is None:
        return label
    return F.when(estimated & (label != ""), F.concat(F.lit("~"), label)).otherwise(label)


def implausible(date: Column) -> Column:
    return (date < F.lit(PLAUSIBLE_FROM).cast("date")) | (date > F.lit(PLAUSIBLE_TO).cast("date"))
