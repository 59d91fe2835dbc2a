"""Market regimes of a daily return series and statistics per regime."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import guarded

YEAR = 252
REGIMES = ["bull", "bear", "high_vol", "low_vol", "all"]


def label_regimes(
    returns: DataFrame, by: str = "strategy", trend_window: int = 60, vol_window: int = 20,
    high: float = 0.20, low: float = 0.10,
) -> DataFrame:
    """Add ``trend`` (bull, bear) by the sign of the summed returns and ``vol_regime`` (high_vol,
    low_vol) by annualised volatility; unknown during warm-up or in between."""
    w = Window.partitionBy(by).orderBy("date")
    wt, wv = w.rowsBetween(-(trend_window - 1), 0), w.rowsBetween(-(vol_window - 1), 0)
    trend = guarded(F.count("ret").over(wt), trend_window, F.sum("ret").over(wt))
    vol = guarded(F.count("ret").over(wv), vol_window, F.stddev_samp("ret").over(wv)) * math.sqrt(YEAR)
    return returns.withColumns({
        "trend": F.when(trend > 0, "bull").when(trend < 0, "bear").otherwise("unknown"),
        "vol_regime": F.when(vol > high, "high_vol").when(vol < low, "low_vol").otherwise("unknown"),
    })


def regime_stats(returns: DataFrame, labels: DataFrame | None = None, by: str = "strategy") -> DataFrame:
    """(by, regime, n_days, annual_return, annual_vol, sharpe, max_drawdown, hit_rate).

    A day counts in every regime it belongs to and in ``all``; drawdown runs over the regime's
    days strung together. Regimes without days have nulls. ``labels`` (date, trend, vol_regime)
    may come from a benchmark, else the series labels itself.
    """
    if labels is None:
        rows = label_regimes(returns, by)
    else:
        rows = returns.join(labels.select("date", "trend", "vol_regime"), "date", "left")
    rows = rows.select(by, "date", "ret", F.explode(F.array_compact(F.array("trend", "vol_regime", F.lit("all")))).alias("regime"))
    rows = rows.where(F.col("regime") != "unknown")
    w = Window.partitionBy(by, "regime").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_equity", F.product(1.0 + F.col("ret")).over(w))
    rows = rows.withColumn("_dd", F.col("_equity") / F.max("_equity").over(w) - 1.0)
    mean, std = F.avg("ret"), F.stddev_pop("ret")
    n = F.count(F.lit(1))
    stats = rows.groupBy(by, "regime").agg(
        n.alias("n_days"), (F.pow(1.0 + mean, YEAR) - 1.0).alias("annual_return"),
        (std * math.sqrt(YEAR)).alias("annual_vol"), F.when(std > 1e-12, mean / std * math.sqrt(YEAR)).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"), (F.count_if(F.col("ret") > 0) / n).alias("hit_rate"))
    slots = returns.select(by).distinct().withColumn("regime", F.explode(F.array(*[F.lit(r) for r in REGIMES])))
    return slots.join(stats, [by, "regime"], "left").na.fill(0, ["n_days"])
