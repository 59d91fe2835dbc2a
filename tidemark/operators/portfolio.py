"""Long/short weights per date from scores.

Input (pred_date, ticker, score [, valid, volatility]), extra keys by ``by``; output
(by, ticker, weight). A constructor is any ``DataFrame -> DataFrame`` of that shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.operators.ranking import BY, legs
from tidemark.operators.spread import row_position

Constructor = Callable[[DataFrame], DataFrame]


def usable(df: DataFrame) -> DataFrame:
    if "valid" in df.columns:
        df = df.where("valid")
    return df.where(finite("score"))


def _pick(df: DataFrame, by: Sequence[str], top_n: int) -> DataFrame:
    size = F.least(F.lit(top_n), F.floor(F.col("n") / F.lit(2))).cast("int")
    return legs(usable(df), by, top_n, size)


def _capped(weight: Column, cap: float | None) -> Column:
    return weight if cap is None else F.signum(weight) * F.least(F.abs(weight), F.lit(float(cap)))


def equal_weight(df: DataFrame, by: Sequence[str] = BY, top_n: int = 50, leg_weight: float = 1.0, cap: float | None = None) -> DataFrame:
    """Top and bottom min(top_n, n // 2) names, each leg split evenly."""
    raw = F.col("leg") * F.lit(float(leg_weight)) / F.col("leg_size")
    return _pick(df, by, top_n).select(*by, "ticker", _capped(raw, cap).alias("weight"))


def risk_parity(
    df: DataFrame, by: Sequence[str] = BY, top_n: int = 50, leg_weight: float = 1.0, cap: float | None = None,
    least_vol: float = 0.005,
) -> DataFrame:
    """The same names, each leg split by inverse volatility; without volatilities evenly."""
    if "volatility" not in df.columns:
        return equal_weight(df, by, top_n, leg_weight, cap)
    by = list(by)
    picked = _pick(df, by, top_n).withColumn("_inv", 1.0 / F.greatest("volatility", F.lit(least_vol)))
    sums = picked.groupBy(*by, "leg").agg(F.sum("_inv").alias("_total"))
    raw = F.col("leg") * F.lit(float(leg_weight)) * F.col("_inv") / F.col("_total")
    return picked.join(sums, [*by, "leg"]).select(*by, "ticker", _capped(raw, cap).alias("weight"))


def sector_neutral(
    df: DataFrame, sectors: DataFrame | None, by: Sequence[str] = BY, quantile: float = 0.2, leg_weight: float = 1.0,
    cap: float | None = None,
) -> DataFrame:
    """Best and worst share of every sector with two or more names, sectors weighted evenly.

    The share is rounded half to even. A name in both legs of a tiny sector nets out. The legs
    grow with the sector, so positions come from range-cut running totals.
    """
    if sectors is None:
        return equal_weight(df, by, 50, leg_weight, cap)
    by = list(by)
    group = [*by, "sector"]
    rows = usable(df).select(*by, "ticker", "score").join(
        sectors.where(F.col("sector").isNotNull()).select("ticker", "sector"), "ticker")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    count = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("_sectors"))
    k = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(quantile))).cast("int"))
    placed = row_position(rows, group, ["score", "ticker"], "_place").join(sizes, group).join(count, by).withColumn("_k", k)
    each = F.lit(float(leg_weight)) / F.col("_sectors") / F.col("_k")
    each = each if cap is None else F.least(each, F.lit(float(cap)))
    long = F.when(F.col("_place") > F.col("n") - F.col("_k"), each).otherwise(0.0)
    short = F.when(F.col("_place") <= F.col("_k"), each).otherwise(0.0)
    chosen = (F.col("_place") > F.col("n") - F.col("_k")) | (F.col("_place") <= F.col("_k"))
    return placed.where(chosen).select(*by, "ticker", (long - short).alias("weight"))


def exposures(weights: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, gross, net, dollar_neutral, n_long, n_short)."""
    w = F.col("weight")
    return weights.groupBy(*by).agg(
        F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), (F.abs(F.sum(w)) < 1e-6).alias("dollar_neutral"),
        F.count_if(w > 0).alias("n_long"), F.count_if(w < 0).alias("n_short"))


# Accepted constructor names.
NAMES = {
    "equal_weight": "equal", "equal": "equal", "long_short": "equal",
    "risk_parity": "risk", "risk": "risk",
    "sector_neutral": "sector", "sector": "sector",
}


def constructor(name: str, sectors: DataFrame | None = None, **settings) -> Constructor:
    """A constructor by name; unknown names raise."""
    kind = NAMES.get(name.lower().strip())
    if kind == "equal":
        return lambda df: equal_weight(df, **settings)
    if kind == "risk":
        return lambda df: risk_parity(df, **settings)
    if kind == "sector":
        return lambda df: sector_neutral(df, sectors, **settings)
    raise ValueError(f"unknown constructor {name!r}")
