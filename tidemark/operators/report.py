"""Report tables over per-variant summaries and series (a row per variant or per day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import guarded

COMPARISON = ["sharpe", "annual_return", "annual_vol", "max_drawdown", "avg_turnover", "total_cost", "final_equity", "n_days"]


def comparison_table(summaries: DataFrame) -> DataFrame:
    """One row per variant with the summary columns in fixed order."""
    return summaries.select(F.col("strategy").alias("variant"), *COMPARISON)


def executive_summary(comparison: DataFrame) -> DataFrame:
    """Best variant by Sharpe and its lift over the first variant by name."""
    known = comparison.where(F.col("sharpe").isNotNull())
    best = known.agg(F.max_by(F.struct("variant", "sharpe", "annual_return", "max_drawdown"), "sharpe").alias("b"))
    first = comparison.agg(F.min_by(F.struct("variant", "sharpe"), "variant").alias("f"))
    one = F.lit(1).alias("_one")
    rows = best.select("b", one).join(first.select("f", one), "_one")
    return rows.select(
        F.col("b.variant").alias("best_variant"), F.col("b.sharpe").alias("best_sharpe"),
        F.col("b.annual_return").alias("best_annual_return"), F.col("b.max_drawdown").alias("best_max_drawdown"),
        F.col("f.variant").alias("baseline_variant"), (F.col("b.sharpe") - F.col("f.sharpe")).alias("sharpe_lift"))


def regime_breakdown(runs: DataFrame) -> DataFrame:
    """Flatten a map column ``regimes`` of statistics structs: (variant, regime, fields)."""
    return runs.select("variant", F.explode("regimes").alias("regime", "_s")).select("variant", "regime", "_s.*")


def monthly_returns(daily: DataFrame, by: str = "strategy") -> DataFrame:
    """(by, year, month, ret): compounded return of each month."""
    return daily.groupBy(by, F.year("date").alias("year"), F.month("date").alias("month")).agg(
        (F.product(1.0 + F.col("ret")) - 1.0).alias("ret"))


def monthly_grid(daily: DataFrame, by: str = "strategy") -> DataFrame:
    """Years by months 1..12; a month without days stays null in its own column."""
    grid = monthly_returns(daily, by).groupBy(by, "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return grid.select(by, "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])


def rolling_ic(daily: DataFrame, by: str = "variant", window: int = 20, least: int = 10) -> DataFrame:
    w = Window.partitionBy(by).orderBy("pred_date").rowsBetween(-(window - 1), 0)
    return daily.withColumn("rolling_ic", guarded(F.count("ic").over(w), least, F.avg("ic").over(w)))


def rank_variants(comparison: DataFrame, metric: str = "sharpe") -> DataFrame:
    """Variants with their place by a metric, best first, nulls last."""
    one = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(metric), "variant")   # a row per variant
    return comparison.select("variant", metric, F.row_number().over(one).alias("place"))
