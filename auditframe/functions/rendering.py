"""Script text of exported values (numbers with six decimals, quoted strings, entry keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.amounts import is_finite
from auditframe.functions.rounding import product_error

_MICRO = 1e6


def _micro(fraction: Column, product: Column) -> Column:
    """Millionths of an exact fraction, half-even on its exact value.

    Only a product that looks like a tie can be off; the sign of its exact error then decides.
    """
    error = product_error(fraction, _MICRO, product)
    tie = product - F.floor(product).cast("double") == F.lit(0.5)
    broken = F.when(error > 0, F.ceil(product)).when(error < 0, F.floor(product)).otherwise(F.rint(product).cast("bigint"))
    return F.when(tie, broken).otherwise(F.rint(product).cast("bigint"))


def _text(x: Column, whole: Column, micro: Column) -> Column:
    """Sign, whole part (one more when the fraction rounded up to 1) and the digits of the fraction."""
    digits = F.rtrim(F.lpad((micro % 1000000).cast("string"), 6, "0"), F.lit("0"))
    units = F.when(micro >= 1000000, whole + 1).otherwise(whole).cast("string")
    negative = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))
    body = F.concat(F.when(negative, "-").otherwise(""), units, F.when(micro % 1000000 == 0, "").otherwise(F.concat(F.lit("."), digits)))
    return F.when(is_finite(x), body)


def script_number(col: Column) -> Column:
    """Six decimals half-even on the exact binary value, trailing zeros and point dropped, ``-0`` kept.

    Whole part and fraction are rounded apart; both are exact.  Valid for magnitudes below 2^63; null when not finite.
    """
    x = col.cast("double")
    whole = F.floor(F.abs(x))
    fraction = F.abs(x) - whole.cast("double")
    return _text(x, whole, _micro(fraction, fraction * F.lit(_MICRO)))


def script_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``script_number`` on many columns, step by step so that the generated code stays small."""
    kept = df.columns
    df = df.withColumns({f"__w_{c}": F.floor(F.abs(F.col(c))) for c in columns})
    df = df.withColumns({f"__f_{c}": F.abs(F.col(c)) - F.col(f"__w_{c}").cast("double") for c in columns})
    df = df.withColumns({f"__m_{c}": _micro(F.col(f"__f_{c}"), F.col(f"__f_{c}") * F.lit(_MICRO)) for c in columns})
    return df.select(*[_text(F.col(c), F.col(f"__w_{c}"), F.col(f"__m_{c}")).alias(c) if c in columns else F.col(c) for c in kept])


def script_string(col: Column) -> Column:
    """Double-quoted text with backslashes doubled and quotes escaped; null stays null."""
    escaped = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def script_key(col: Column) -> Column:
    """Entry key: only quotes are escaped, a backslash stays single; a missing identifier reads ``NA``."""
    return F.replace(F.coalesce(col, F.lit("NA")), F.lit('"'), F.lit('\\"'))
