"""Scalar Column helpers: casts, NULL-preserving clamps, row-wise statistics.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c, strict: bool = False) -> Column:
    """Text -> double. Lenient: unparsable or empty text gives NULL (and NaN
    text is normalised to NULL). Strict: unparsable text fails the job."""
    c = col(c)
    parsed = c.cast("double") if strict else c.try_cast("double")
    return nan_to_null(parsed)


def nan_to_null(c) -> Column:
    """NaN -> NULL, so that comparisons behave as NaN does in pandas (false)."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def truncate_int(c, dtype: str = "int") -> Column:
    """Truncate toward zero (Python ``int(x)``); out of range gives NULL."""
    return col(c).try_cast(dtype)


def clamp_low(c, low) -> Column:
    """Values at or below ``low`` become ``low``; NULL stays NULL."""
    c = col(c)
    return F.when(c <= low, F.lit(low)).otherwise(c)


def clamp_high(c, high) -> Column:
    """Values at or above ``high`` become ``high``; NULL stays NULL."""
    c = col(c)
    return F.when(c >= high, F.lit(high)).otherwise(c)


def clamp(c, low, high) -> Column:
    """Clamp into [low, high] keeping NULL (``greatest``/``least`` would turn
    NULL into a bound)."""
    return clamp_high(clamp_low(c, low), high)


def row_max(*cs) -> Column:
    """Row-wise maximum, NULLs skipped (NULL only when all are NULL)."""
    return F.greatest(*[col(c) for c in cs])


def row_min(*cs) -> Column:
    """Row-wise minimum, NULLs skipped."""
    return F.least(*[col(c) for c in cs])


def row_median3(a, b, c) -> Column:
    """Median of three values that are NULL together (NULLs sort last)."""
    return F.element_at(F.array_sort(F.array(col(a), col(b), col(c))), 2)


def round_half_even(c, scale: int) -> Column:
    return F.bround(col(c), scale)


def safe_divide(num, den) -> Column:
    """Division that yields NULL (not an error, not infinity) on a zero
    denominator, also under ANSI mode."""
    return F.try_divide(col(num), col(den))


def equal_flag(a, b) -> Column:
    """1 when both sides are equal, 0 otherwise (NULL compares unequal)."""
    return F.coalesce(col(a) == col(b), F.lit(False)).cast("int")
