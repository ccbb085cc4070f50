"""Whitespace, identifier and escaping expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters the delimited-table readers treat as white space around a cell.
CELL_WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The characters that do not count as content in a ledger string.
LEDGER_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed pattern: well-formed claim identifiers.
CLAIM_ID_PATTERN = r"\A(?:C-?[A-Za-z0-9][A-Za-z0-9._-]*)\z"
# Fixed pattern: an identifier that a spreadsheet turned into exponent notation.
EXPONENT_ID_PATTERN = r"\A[+-]?[0-9]*\.?[0-9]+[eE][+-]?[0-9]+\z"


def trim_cell(col: Column) -> Column:
    """Cell without surrounding white space; text that begins and ends in visible ASCII is passed on as it is."""
    clean = F.ascii(col).between(33, 126) & F.ascii(F.substring(col, -1, 1)).between(33, 126)
    return F.when(clean, col).otherwise(F.trim(col, F.lit(CELL_WHITESPACE)))


def has_content(col: Column) -> Column:
    """True when a string holds something besides white space; false for null.  Text that begins in visible ASCII needs no trimming."""
    return F.coalesce(F.ascii(col).between(33, 126) | (F.length(F.trim(col, F.lit(LEDGER_WHITESPACE))) > 0), F.lit(False))


def is_claim_id(col: Column) -> Column:
    return F.coalesce(col.rlike(CLAIM_ID_PATTERN), F.lit(False))


def is_exponent_id(col: Column) -> Column:
    """Mantissa, ``e``, exponent: the shape of an identifier that went through a number."""
    return F.coalesce(col.rlike(EXPONENT_ID_PATTERN), F.lit(False))


def is_iso_date(col: Column) -> Column:
    """Exactly ``yyyy-mm-dd`` and a day that exists (year 1 or later)."""
    shape = col.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~col.startswith("0000")
    return F.coalesce(F.when(shape, col.try_cast("date").isNotNull()), F.lit(False))


def is_id_list(col: Column) -> Column:
    """A list of distinct, well-formed claim identifiers (null list: false)."""
    well_formed = F.forall(col, lambda x: F.coalesce(x.rlike(CLAIM_ID_PATTERN), F.lit(False)))
    distinct = F.size(F.array_distinct(col)) == F.size(col)
    return F.coalesce(well_formed & distinct, F.lit(False))
