"""Backtest of rebalanced weights without a day loop.

Between rebalances a position is its starting weight times its price relative, so every day
follows from the rebalance alone. Windows run over a strategy's calendar or over one holding
period, both bounded by the number of trading days.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import finite, log_ratio
from tidemark.operators.portfolio import Constructor
from tidemark.session import cut_lineage

YEAR = 252


def _scheduled(frequency: str, date: Column, keys: list) -> Column:
    """True on the first date of each ISO week (W), each month (M), or on all (D)."""
    if frequency == "D":
        return F.lit(True)
    if frequency == "W":
        period = [F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date)]
    elif frequency == "M":
        period = [F.year(date), F.month(date)]
    else:
        raise ValueError(f"unknown frequency {frequency!r}")
    return F.row_number().over(Window.partitionBy(*keys, *period).orderBy(date)) == 1


def rebalance_days(calendar: DataFrame, frequency: str = "W", by: tuple[str, ...] = ()) -> DataFrame:
    """The calendar with a ``scheduled`` flag."""
    return calendar.withColumn("scheduled", _scheduled(frequency, F.col("date"), list(by)))


@dataclass
class Backtest:
    """Result tables of a run; schedule, weights and holdings are written once, the rest is lazy."""

    daily: DataFrame        # strategy, date, ret, turnover, cost
    positions: DataFrame    # strategy, date, ticker, weight

    def equity(self, capital: float = 1_000_000.0) -> DataFrame:
        return equity_curve(self.daily, capital)

    def summary(self, capital: float = 1_000_000.0, risk_free: float = 0.0) -> DataFrame:
        return summarise(self.daily, capital, risk_free)


def run_backtest(
    predictions: DataFrame, prices: DataFrame, construct: Constructor, frequency: str = "W",
    cost_bps: float = 10.0, roster: DataFrame | None = None, strategy: str = "strategy",
) -> Backtest:
    """Hold the constructed weights from rebalance to rebalance.

    A rebalance happens on a scheduled day with a prediction; names need a positive price that
    day and, with ``roster``, membership. On a day without price a position keeps its weight
    and earns nothing; from the day after it is gone until the next rebalance. Turnover is
    measured against drifted weights and costs are taken from that day's return.
    """
    from tidemark.operators.asof import keep_members

    valid_prices = prices.where(finite("adj_close") & (F.col("adj_close") > 0)).select("ticker", "date", "adj_close")
    span = predictions.agg(F.min("pred_date").alias("_from"), F.max("pred_date").alias("_to"))
    one = Window.partitionBy(F.lit(1))
    days = (
        prices.select("date").distinct().join(F.broadcast(span), F.col("date").between(F.col("_from"), F.col("_to")))
        .select("date", F.row_number().over(one.orderBy("date")).alias("day"))
    )   # one row per calendar day; span is a single row
    dated = predictions.select(F.col("pred_date").alias("date")).distinct().withColumn("_has", F.lit(True))
    flagged = rebalance_days(days, frequency).join(dated, "date", "left").withColumn(
        "rebalance", F.col("scheduled") & F.col("_has").isNotNull())
    upto = one.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    schedule = cut_lineage(flagged.select(
        "date", "day", "rebalance",
        F.last(F.when(F.col("rebalance"), F.col("day")), ignorenulls=True).over(upto).alias("held_from")))

    rebalances = schedule.where("rebalance").select("date", F.col("day").alias("held_from"))
    universe = predictions.withColumn("date", F.col("pred_date")).join(rebalances, "date", "left_semi")
    # prices of the rebalance days alone are shuffled for the universe and the starts
    first_prices = valid_prices.join(rebalances, "date").select("ticker", "date", "held_from", F.col("adj_close").alias("p0"))
    universe = universe.join(first_prices.select("ticker", "date"), ["ticker", "date"], "left_semi")
    if roster is not None:
        universe = keep_members(universe, roster)
    targets = construct(universe.drop("date")).select(
        F.col("pred_date").alias("date"), "ticker", F.col("weight").alias("w0"))
    targets = targets.join(rebalances, "date").drop("date")
    targets = cut_lineage(targets)      # read for holdings, turnover and positions

    priced = valid_prices.join(schedule.select("date", "day"), "date").select("ticker", "day", F.col("adj_close").alias("px"))
    start = targets.join(first_prices.drop("date"), ["ticker", "held_from"])
    held = (
        start.join(schedule.where(F.col("held_from").isNotNull()).select("held_from", "day"), "held_from")
        .join(priced, ["ticker", "day"], "left")
    )
    w = Window.partitionBy("held_from", "ticker").orderBy("day")
    missing_so_far = F.count_if(F.col("px").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_missing", missing_so_far).withColumn("_prev", F.coalesce(F.lag("px").over(w), F.col("p0")))
    alive = held.where((F.col("_missing") == 0) | ((F.col("_missing") == 1) & F.col("px").isNull()))
    moved = cut_lineage(alive.select(        # read for gains, turnover and positions
        "held_from", "day", "ticker",
        (F.col("w0") * F.coalesce("px", "_prev") / F.col("p0")).alias("weight"),
        F.coalesce(F.col("w0") * (F.col("px") - F.col("_prev")) / F.col("p0"), F.lit(0.0)).alias("gain")))

    earned = moved.groupBy("day").agg(F.sum("gain").alias("gain"))
    new = targets.select(F.col("held_from").alias("day"), "ticker", "w0")
    old = moved.join(schedule.where("rebalance").select("day"), "day", "left_semi").select("day", "ticker", "weight")
    traded = new.join(old, ["day", "ticker"], "full").groupBy("day").agg(
        F.sum(F.abs(F.coalesce("w0", F.lit(0.0)) - F.coalesce("weight", F.lit(0.0)))).alias("turnover"))
    daily = schedule.join(earned, "day", "left").join(traded, "day", "left")
    turnover = F.when(F.col("rebalance"), F.coalesce("turnover", F.lit(0.0)))
    cost = turnover * F.lit(cost_bps / 1e4)
    daily = daily.select(
        F.lit(strategy).alias("strategy"), "date",
        (F.coalesce("gain", F.lit(0.0)) - F.coalesce(cost, F.lit(0.0))).alias("ret"),
        turnover.alias("turnover"), cost.alias("cost"))
    # on a rebalance day the book after trading is the new one
    kept = moved.join(schedule.where(~F.col("rebalance")).select("day"), "day", "left_semi").select("day", "ticker", "weight")
    book = kept.unionByName(new.select("day", "ticker", F.col("w0").alias("weight")))
    positions = book.join(schedule.select("day", "date"), "day").select(
        F.lit(strategy).alias("strategy"), "date", "ticker", "weight")
    return Backtest(daily, positions)


def equity_curve(daily: DataFrame, capital: float = 1_000_000.0) -> DataFrame:
    """(strategy, date, equity, peak, drawdown)."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.withColumn("equity", F.lit(capital) * F.product(1.0 + F.col("ret")).over(w))
    grown = grown.withColumn("peak", F.max("equity").over(w))
    return grown.select("strategy", "date", "equity", "peak", ((F.col("equity") - F.col("peak")) / F.col("peak")).alias("drawdown"))


def summarise(daily: DataFrame, capital: float = 1_000_000.0, risk_free: float = 0.0) -> DataFrame:
    curve = equity_curve(daily, capital)
    ends = curve.groupBy("strategy").agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("equity", "date").alias("final_equity"))
    mean, std = F.avg("ret"), F.stddev_pop("ret")
    stats = daily.groupBy("strategy").agg(
        F.when(std > 1e-12, (mean - risk_free / YEAR) / std * math.sqrt(YEAR)).alias("sharpe"),
        (F.pow(1.0 + mean, YEAR) - 1.0).alias("annual_return"), (std * math.sqrt(YEAR)).alias("annual_vol"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"), F.count(F.lit(1)).alias("n_days"))
    return stats.join(ends, "strategy")


def position_matrix(positions: DataFrame, tickers: list[str]) -> DataFrame:
    """Dates by the named tickers, absent positions 0. Pivoting suits a chosen few; use the long
    table for whole universes."""
    return positions.groupBy("strategy", "date").pivot("ticker", tickers).agg(F.sum("weight")).na.fill(0.0)


def buy_and_hold(prices: DataFrame, by: str = "ticker", price: str = "adj_close") -> DataFrame:
    """Per series: days, Sharpe on log returns (sample), annual and total return, drawdown, hits."""
    w = Window.partitionBy(by).orderBy("date")
    rows = prices.withColumn("_r", log_ratio(F.col(price), F.lag(price).over(w)))
    rows = rows.withColumn("_peak", F.max(price).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mean, std = F.avg("_r"), F.stddev_samp("_r")
    n = F.count("_r")
    return rows.groupBy(by).agg(
        n.alias("n_days"), F.when(std > 0, mean / std * math.sqrt(YEAR)).alias("sharpe"),
        (F.exp(mean * YEAR) - 1).alias("annual_return"), (F.exp(F.sum("_r")) - 1).alias("cumulative_return"),
        F.min(F.col(price) / F.col("_peak") - 1).alias("max_drawdown"),
        (F.count_if(F.col("_r") > 0) / F.nullif(n, F.lit(0))).alias("hit_rate"), std.alias("daily_vol"))
