"""Significance of one series against another on common dates.

Series hold one row per (pair of) strategy and date, so a window over a series is bounded by
the calendar. ``by`` names the columns that tell comparisons apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import finite
from tidemark.functions.pvalues import normal_pvalue, student_pvalue

YEAR = 252


def _pairs(df: DataFrame) -> DataFrame:
    return df.where(finite("a") & finite("b"))


def paired_t(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, statistic, pvalue, effect, n) of a - b; infinite t where the difference is constant."""
    d = F.col("a") - F.col("b")
    agg = _pairs(df).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    n = F.col("n").cast("double")
    flat = F.col("sd") < 1e-12
    t = F.col("m") / F.nullif(F.col("sd") / F.sqrt(n), F.lit(0.0))
    enough = F.col("n") >= 2
    return agg.select(
        *by,
        F.when(enough, F.when(flat, F.lit(float("inf"))).otherwise(t)).alias("statistic"),
        F.when(enough, F.when(flat, 0.0).otherwise(student_pvalue(t, n - 1))).alias("pvalue"),
        F.when(enough, F.col("m")).alias("effect"), "n")


def newey_west_variance(df: DataFrame, value: str, order: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, variance, mean, n): Bartlett-weighted long-run variance, floored at zero. The k-th
    autocovariance averages its n - k products."""
    by = list(by)
    keys = by or [F.lit(1)]
    mean = F.avg(value).over(Window.partitionBy(*keys))
    rows = df.withColumn("_x", F.col(value) - mean).withColumn("_m", mean)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumns({f"_p{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, lags + 1)})
    var = F.avg(F.col("_x") * F.col("_x"))
    for k in range(1, lags + 1):
        var = var + F.lit(2.0 * (1.0 - k / (lags + 1.0))) * F.coalesce(F.avg(f"_p{k}"), F.lit(0.0))
    return rows.groupBy(*by).agg(F.greatest(var, F.lit(0.0)).alias("variance"), F.first("_m").alias("mean"),
                                 F.count(F.lit(1)).alias("n"))


def diebold_mariano(df: DataFrame, order: str = "date", h: int = 1, power: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by, statistic, pvalue, effect, n) for forecast errors a and b with loss |e|^power."""
    by = list(by)
    loss = _pairs(df).withColumn("_d", F.pow(F.abs("a"), power) - F.pow(F.abs("b"), power))
    nw = newey_west_variance(loss, "_d", order, max(h - 1, 0), by)
    enough = F.col("n") >= max(2, h)
    positive = F.col("variance") > 0
    stat = F.col("mean") / F.sqrt(F.when(positive, F.col("variance")) / F.col("n"))
    return nw.select(
        *by, F.when(enough & positive, stat).alias("statistic"),
        F.when(enough & positive, normal_pvalue(stat)).alias("pvalue"),
        F.when(enough, F.col("mean")).alias("effect"), "n")


def sharpe(value: Column) -> Column:
    """Aggregate: annualised mean over population deviation, null when flat or n < 2."""
    std = F.stddev_pop(value)
    return F.when((F.count(value) >= 2) & (std >= 1e-12), F.avg(value) / std * math.sqrt(YEAR))


# Multiplicative congruential generator (modulus 2^31 - 1) for bootstrap starts.
MODULUS, MULTIPLIER = 2147483647, 48271


def block_start(draw: Column, block: Column, choices: Column, seed: int = 0) -> Column:
    """Deterministic start in [0, choices) for a (draw, block)."""
    x = (draw * 1000003 + block * 7368787 + (seed + 1)) % MODULUS
    for _ in range(3):
        x = (x * MULTIPLIER + 1) % MODULUS
    return x % choices


def bootstrap_sharpe_difference(
    df: DataFrame, order: str = "date", draws: int = 1000, block: int = 5, alpha: float = 0.05,
    seed: int = 0, by: Sequence[str] = (),
) -> DataFrame:
    """(by, statistic, ci_low, ci_high, n): paired block bootstrap of Sharpe(a) - Sharpe(b).

    A resample is a list of blocks, and mean and deviation need only sums. Block sums are
    computed once per start by a window; each draw then adds ceil(n / block) of them.
    """
    by = list(by)
    keys = by or [F.lit(1)]
    rows = _pairs(df)
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    # centring keeps the sums of squares accurate; neither statistic changes but for the mean
    rows = rows.withColumns({"_ma": F.avg("a").over(whole), "_mb": F.avg("b").over(whole)})
    rows = rows.withColumns({"_a": F.col("a") - F.col("_ma"), "_b": F.col("b") - F.col("_mb")})
    last_length = F.col("_n") - (F.ceil(F.col("_n") / F.lit(block)) - 1) * block
    stats = {"sa": F.col("_a"), "sb": F.col("_b"), "qa": F.col("_a") * F.col("_a"), "qb": F.col("_b") * F.col("_b")}
    sums = rows.withColumns({f"_{k}": F.array(*[c, *[F.lead(c, j).over(w) for j in range(1, block)]]) for k, c in stats.items()})
    zero, add = F.lit(0.0), (lambda s, x: s + x)
    sums = sums.select(
        *by, F.col("_i").cast("bigint").alias("_start"), "_n",
        *[F.aggregate(f"_{k}", zero, add).alias(k) for k in stats],
        *[F.aggregate(F.slice(f"_{k}", F.lit(1), last_length.cast("int")), zero, add).alias(f"{k}_last") for k in stats],
    ).where(F.col("_start") <= F.col("_n") - block)
    sizes = rows.groupBy(*by).agg(
        F.first("_n").alias("_n"), F.first("_ma").alias("_ma"), F.first("_mb").alias("_mb"),
        sharpe(F.col("a")).alias("_oa"), sharpe(F.col("b")).alias("_ob"))
    plan = (
        sizes.where(F.col("_n") > block)
        .withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))))
        .withColumn("_blocks", F.ceil(F.col("_n") / F.lit(block)))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumn("_start", block_start(F.col("_draw"), F.col("_block"), F.col("_n") - block + 1, seed))
        .select(*by, "_draw", "_start", "_ma", "_mb", (F.col("_block") == F.col("_blocks") - 1).alias("_is_last"))
    )
    taken = plan.join(sums, [*by, "_start"])
    parts = {k: F.sum(F.when(F.col("_is_last"), F.col(f"{k}_last")).otherwise(F.col(k))) for k in stats}
    per_draw = taken.groupBy(*by, "_draw").agg(
        F.first("_n").cast("double").alias("n"), F.first("_ma").alias("ma"), F.first("_mb").alias("mb"),
        *[c.alias(k) for k, c in parts.items()])

    def resampled(s: str, q: str, m: str) -> Column:
        centre = F.col(s) / F.col("n")
        std = F.sqrt(F.greatest(F.col(q) / F.col("n") - centre * centre, F.lit(0.0)))
        return F.when(std >= 1e-12, (centre + F.col(m)) / std * math.sqrt(YEAR))

    diffs = per_draw.select(*by, (resampled("sa", "qa", "ma") - resampled("sb", "qb", "mb")).alias("_diff"))
    ends = diffs.groupBy(*by).agg(
        F.percentile("_diff", F.lit(alpha / 2)).alias("ci_low"), F.percentile("_diff", F.lit(1 - alpha / 2)).alias("ci_high"))
    observed = sizes.select(*by, (F.col("_oa") - F.col("_ob")).alias("statistic"), F.col("_n").alias("n"))
    if by:
        return observed.join(ends, by, "left").select(*by, "statistic", "ci_low", "ci_high", "n")
    return observed.withColumn("_one", F.lit(1)).join(ends.withColumn("_one", F.lit(1)), "_one", "left").select(
        "statistic", "ci_low", "ci_high", "n")


def compare_consecutive(returns: DataFrame, draws: int = 1000, block: int = 5) -> DataFrame:
    """Each variant against the one before it by name, on common dates: t-test and bootstrap.
    Input (variant, date, ret). The t-test is on daily returns and named so."""
    variants = returns.select("variant").distinct()    # a handful of names
    order = Window.partitionBy(F.lit(1)).orderBy("variant")
    pairs = variants.withColumn("baseline", F.lag("variant").over(order)).where(F.col("baseline").isNotNull())
    a = returns.join(pairs, "variant").select("variant", "baseline", "date", F.col("ret").alias("a"))
    b = returns.select(F.col("variant").alias("baseline"), "date", F.col("ret").alias("b"))
    both = a.join(b, ["baseline", "date"])
    keys = ["variant", "baseline"]
    t = paired_t(both, keys).select(*keys, F.col("statistic").alias("t_stat_returns"), F.col("pvalue").alias("p_value_returns"), "n")
    boot = bootstrap_sharpe_difference(both, draws=draws, block=block, by=keys).select(
        *keys, F.col("statistic").alias("sharpe_diff"), "ci_low", "ci_high")
    return t.join(boot, keys)
