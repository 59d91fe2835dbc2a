"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine similarity; null if a side is missing or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1.0 - dot(a, b) / F.nullif(norms, F.lit(0.0))
