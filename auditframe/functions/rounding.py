"""Exact decimal rounding of doubles inside whole-stage code generation.

``round``/``bround`` work on the shortest decimal spelling of a double and go wrong at ties.  Here the two
neighbouring candidates k/10^d and (k+1)/10^d are compared by their exact distance from the value.  Double arithmetic
decides this exactly: one correctly rounded division gives each candidate, and the differences to the value are exact
because the candidates lie within a factor of two of it (for k = 0 the comparison still comes out right).  Away from
the middle between two candidates the comparison is not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SPLIT = 134217729.0  # 2^27 + 1, splits a double into two halves
_EXACT_LIMIT = 9007199254740992.0  # 2^53: from here on the neighbours are no closer than the value itself
_COARSE = 1099511627776.0  # 2^40: from here on the scaled value has too few fraction bits to trust its fraction


def product_error(a: Column, factor: float, product: Column) -> Column:
    """Exact error of the rounded product ``a * factor`` (both factors split into halves)."""
    c = a * F.lit(_SPLIT)
    a_hi = c - (c - a)
    a_lo = a - a_hi
    f = factor * _SPLIT
    f_hi = f - (f - factor)
    f_lo = factor - f_hi
    return ((a_hi * F.lit(f_hi) - product) + a_hi * F.lit(f_lo) + a_lo * F.lit(f_hi)) + a_lo * F.lit(f_lo)


def _choose(x: Column, factor: float, scaled: Column) -> Column:
    mag, k = F.abs(x), F.floor(scaled).cast("double")
    below, above = k / F.lit(factor), (k + 1) / F.lit(factor)
    middle = (F.abs(scaled - k - F.lit(0.5)) < F.lit(1e-3)) | (scaled > F.lit(_COARSE))
    to_below, to_above = F.abs(mag - below), F.abs(above - mag)
    take_below = (to_below < to_above) | ((to_below == to_above) & (k % 2 == 0))
    nearest = F.when(~middle, F.rint(scaled) / F.lit(factor)).when(take_below, below).otherwise(above)
    untouched = x.isNull() | (mag == 0) | ~(scaled < F.lit(_EXACT_LIMIT))
    return F.when(untouched, x).when(x < 0, -nearest).otherwise(nearest)


def round_exact(col: Column, places: int) -> Column:
    """Nearest of the two neighbouring ``places``-digit decimals by exact distance, ties to the even numerator.

    The sign is kept (a negative value that rounds to zero gives -0.0); missing and infinite values pass through.
    """
    x = col.cast("double")
    return _choose(x, float(10**places), F.abs(x) * F.lit(float(10**places)))


def round_columns(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """``round_exact`` on many columns; the scaled values are computed once in a step of their own."""
    columns = df.columns
    df = df.withColumns({f"__scaled_{c}": F.abs(F.col(c)) * F.lit(float(10**p)) for c, p in places.items()})
    rounded = {c: _choose(F.col(c), float(10**p), F.col(f"__scaled_{c}")) for c, p in places.items()}
    return df.select(*[rounded[c].alias(c) if c in rounded else F.col(c) for c in columns])
