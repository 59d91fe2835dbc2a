"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def null_unless_finite(c: str | Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    c = col(c)
    return F.when(finite(c), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def floored(c: str | Column, low: float) -> Column:
    """max(c, low), null where c is null (``greatest`` alone would skip the null)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip(c: str | Column, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    """ln(a / b), null unless both are positive."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def guarded(window_count: Column, least: int, value: Column) -> Column:
    """``value`` once the window holds at least ``least`` non-null rows, else null."""
    return F.when(window_count >= F.lit(least), value)


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null where a side is constant (plain ``corr`` raises there)."""
    vx = sxx - sx * sx / n
    vy = syy - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), (sxy - sx * sy / n) / F.sqrt(vx * vy))
