"""Cross-sectional ranking metrics per date.

Inputs are (pred_date, ticker, score, target [, valid]). Extra leading keys (``variant``) may
be named in ``by``. Large dates are ranked in ranges (``spread.py``) and legs use partial top-n, so
one date may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import finite, pearson
from tidemark.operators.spread import PER_RANGE, average_ranks, exact_quantiles, top_rows

BY = ("pred_date",)


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows that are not masked and have a finite score and target."""
    if "valid" in df.columns:
        df = df.where("valid")
    return df.where(finite("score") & finite("target"))


def correlation_of(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, null for constant sides."""
    x, y = x.cast("double"), y.cast("double")
    n = F.count(F.lit(1)).cast("double")
    return pearson(n, F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y))


def rank_ic(df: DataFrame, by: Sequence[str] = BY, least: int = 2, per_range: int = PER_RANGE) -> DataFrame:
    """(by, ic, n): Spearman correlation of score and target, null below ``least`` rows or for
    a constant side."""
    by = list(by)
    rows = valid_rows(df).select(*by, "score", "target")
    ranked = average_ranks(rows, by, {"score": "_rs", "target": "_rt"}, per_range)
    n = F.count(F.lit(1))
    return ranked.groupBy(*by).agg(
        F.when(n >= least, correlation_of(F.col("_rs"), F.col("_rt"))).alias("ic"), n.alias("n"))


def legs(df: DataFrame, by: Sequence[str], top_n: int, size: Column) -> DataFrame:
    """The k best (``leg`` 1) and k worst (-1) rows by score, ties by ticker, with ``leg_size``.

    ``size`` gives k from the group size ``n``; it must never exceed ``top_n``.
    """
    by = list(by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    best = top_rows(df, by, [F.desc("score"), F.desc("ticker")], top_n).withColumn("leg", F.lit(1))
    worst = top_rows(df, by, [F.asc("score"), F.asc("ticker")], top_n).withColumn("leg", F.lit(-1))
    both = best.unionByName(worst).join(counts, by).withColumn("leg_size", size)
    return both.where(F.col("position") <= F.col("leg_size")).drop("position")


def _metric_size(top_n: int) -> Column:
    n = F.col("n")
    return F.when(n < 2 * top_n, F.greatest(F.floor(n / F.lit(4)), F.lit(1))).otherwise(F.lit(top_n)).cast("int")


def leg_spread(df: DataFrame, by: Sequence[str] = BY, top_n: int = 50) -> DataFrame:
    """(by, hit_rate, spread): mean target of the best against the worst ``top_n`` rows, a
    quarter of the date each where it is too small."""
    by = list(by)
    chosen = legs(valid_rows(df), by, top_n, _metric_size(top_n)).where("n >= 2")
    top = F.avg(F.when(F.col("leg") == 1, F.col("target")))
    bottom = F.avg(F.when(F.col("leg") == -1, F.col("target")))
    return chosen.groupBy(*by).agg(
        F.when(top > bottom, 1.0).otherwise(0.0).alias("hit_rate"), (top - bottom).alias("spread"))


def daily_metrics(df: DataFrame, by: Sequence[str] = BY, top_n: int = 50, per_range: int = PER_RANGE) -> DataFrame:
    """(by, ic, hit_rate, spread, n_valid) for every date, null metrics below two valid rows."""
    by = list(by)
    dates = df.select(*by).distinct()
    ic = rank_ic(df, by, per_range=per_range)
    return dates.join(ic, by, "left").join(leg_spread(df, by, top_n), by, "left").select(
        *by, "ic", "hit_rate", "spread", F.coalesce("n", F.lit(0)).alias("n_valid"))


def aggregate_metrics(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    std = F.stddev_pop("ic")
    return daily.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"), std.alias("ic_std"),
        F.when(std > 1e-12, F.avg("ic") / std).alias("ic_ir"),
        F.avg("hit_rate").alias("hit_rate"), F.avg("spread").alias("mean_spread"),
        F.count("ic").alias("n_days"))


def sector_ic(df: DataFrame, sectors: DataFrame, least: int = 3) -> DataFrame:
    """(sector, mean_ic, n_days): rank IC inside each (date, sector) with enough rows, averaged."""
    rows = df.join(sectors.select("ticker", "sector"), "ticker").where(F.col("sector").isNotNull())
    return rank_ic(rows, ["pred_date", "sector"], least).where(F.col("ic").isNotNull()).groupBy("sector").agg(
        F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_days"))


# -- diagnostics over a series of daily ICs (one row per date) ------------------------------


def ic_diagnostics(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n, mean, std = F.count("ic"), F.avg("ic"), F.stddev_pop("ic")
    se = std / F.sqrt(n.cast("double"))
    shares = [F.percentile("ic", F.lit(p)).alias(name) for name, p in
              (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))]
    total = F.nullif(n, F.lit(0)).cast("double")
    return daily.where(F.col("ic").isNotNull()).groupBy(*by).agg(
        n.alias("n"), mean.alias("mean_ic"), std.alias("ic_std"), se.alias("se"),
        (mean / F.greatest(se, F.lit(1e-12))).alias("t_stat"),
        (F.count_if(F.col("ic") > 0) / total).alias("frac_pos"),
        (F.count_if(F.col("ic") < 0) / total).alias("frac_neg"), *shares)


def half_year_ic(daily: DataFrame) -> DataFrame:
    half = F.concat(F.year("pred_date"), F.lit("-H"), F.when(F.month("pred_date") <= 6, "1").otherwise("2"))
    return daily.where(F.col("ic").isNotNull()).groupBy(half.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"))


def score_snapshots(df: DataFrame) -> DataFrame:
    """Score distribution on the first, middle and last date."""
    from pyspark.sql import Window

    one = Window.partitionBy(F.lit(1))
    days = df.select("pred_date").distinct()    # at most one row per calendar day
    days = days.withColumn("_i", F.row_number().over(one.orderBy("pred_date")) - 1).withColumn("_n", F.count(F.lit(1)).over(one))
    chosen = days.where(F.col("_i").isin(0) | (F.col("_i") == F.floor(F.col("_n") / F.lit(2))) | (F.col("_i") == F.col("_n") - 1))
    rows = df.where(finite("score")).join(chosen.select("pred_date"), "pred_date")
    quantiles = exact_quantiles(rows, ["pred_date"], "score", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    moments = rows.groupBy("pred_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return moments.join(quantiles, "pred_date").select(
        "pred_date", "n", "min", "p10", "p25", "p50", "p75", "p90", "max", "mean", "std",
        (F.col("p75") - F.col("p25")).alias("iqr"),
        ((F.col("max") - F.col("min")) / (F.col("std") + 1e-12)).alias("range_over_std"))


def verdict(diagnostics: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: mean IC, t-statistic, mean range/std and the class they fall into."""
    spread = snapshots.agg(F.avg("range_over_std").alias("avg_range_over_std"))
    t, ic = F.col("t_stat"), F.col("mean_ic")
    label = (
        F.when(ic.isNull(), "NO DATA")
        .when(F.abs(t) < 2, "OVERFITTING")
        .when(t <= -2, "REGIME INVERSION")
        .when((t >= 3) & (ic >= 0.05), "WORKING MODEL")
        .when((t >= 2) & (ic >= 0.02), "WEAK SIGNAL")
        .otherwise("AMBIGUOUS"))
    # both sides are single rows
    rows = diagnostics.select("mean_ic", "t_stat", F.lit(1).alias("_one")).join(
        spread.withColumn("_one", F.lit(1)), "_one")
    return rows.select(
        "mean_ic", "t_stat", "avg_range_over_std", label.alias("verdict"),
        (F.col("avg_range_over_std") < 3.0).alias("collapse_warning"))


def best_epochs(epochs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run",)) -> DataFrame:
    """(by, metric, best_epoch, best_value): maximum per metric, the earliest epoch on ties."""
    by = list(by)
    long = epochs.unpivot([*by, "epoch"], list(metrics), "metric", "value")
    best = F.max_by("epoch", F.struct("value", -F.col("epoch")))
    return long.where(F.col("value").isNotNull()).groupBy(*by, "metric").agg(
        best.alias("best_epoch"), F.max("value").alias("best_value"))


def best_runs(epochs: DataFrame, metric: str = "val_ic", group: str = "variant", run: str = "run") -> DataFrame:
    """The run with the highest peak of ``metric`` per group, its peak epoch and epoch count."""
    peaks = epochs.groupBy(group, run).agg(
        F.max(metric).alias("peak"), F.max_by("epoch", F.struct(metric, -F.col("epoch"))).alias("peak_epoch"),
        F.count(F.lit(1)).alias("n_epochs"))
    first = F.max_by(F.struct(run, "peak", "peak_epoch", "n_epochs"), F.struct("peak", F.col("peak_epoch") * -1, run))
    return peaks.groupBy(group).agg(first.alias("_b")).select(group, "_b.*")
