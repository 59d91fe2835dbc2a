"""Text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headline polarity words.
POSITIVE = ["upgrade", "beat", "surge", "rally", "record", "outperform", "raise", "strong", "gain", "soar", "boost", "grow"]
NEGATIVE = ["downgrade", "miss", "fall", "drop", "plunge", "underperform", "cut", "weak", "loss", "slump", "decline", "sink"]

# Accepted date formats, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy"]


def text_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_words(text: str | Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.trim(text_column(text))), r"\s+"))


def hits(text: str | Column, words: Sequence[str]) -> Column:
    """How many of the words occur as whole lower-case tokens."""
    return F.size(F.array_intersect(distinct_words(text), F.array(*[F.lit(w) for w in words])))


def polarity(text: str | Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(pos - neg) / (pos + neg) over distinct tokens, 0 without any."""
    p, n = hits(text, positive), hits(text, negative)
    return F.when(p + n > 0, (p - n) / (p + n).cast("double")).otherwise(0.0)


def parse_date(text: str | Column) -> Column:
    """Date in any accepted format, else null."""
    t = F.trim(text_column(text))
    return F.coalesce(*[F.expr(f"cast(null as date)")] + [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMATS])
