"""Quarterly fundamentals: long to wide, effective dates, daily as-of values and ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import finite, ratio
from tidemark.operators.asof import as_of

METRICS = [
    "total_revenue", "net_income", "total_debt", "stockholders_equity",
    "shares_outstanding", "operating_cashflow", "capex", "dividends_paid",
]
RATIOS = ["log_market_cap", "pe", "pb", "de", "roe", "fcf_yield", "div_yield", "rev_growth_yoy"]


def wide_fundamentals(long: DataFrame, metrics: Sequence[str] = METRICS, order: str | None = None) -> DataFrame:
    """(ticker, date, one column per metric); of duplicates the last by ``order`` stays."""
    pick = F.max_by("value", order) if order else F.last("value", ignorenulls=True)
    return long.groupBy("ticker", "date").pivot("metric", list(metrics)).agg(pick)


def daily_fundamentals(
    long: DataFrame, prices: DataFrame, metrics: Sequence[str] = METRICS, report_lag_days: int = 45,
    order: str | None = None,
) -> DataFrame:
    """Each metric's latest value on every price date, usable ``report_lag_days`` calendar days
    after period end. Also carries the revenue of four report periods before."""
    wide = wide_fundamentals(long, metrics, order)
    periods = Window.partitionBy("ticker").orderBy("date")
    if "total_revenue" in metrics:
        wide = wide.withColumn("_revenue_back4", F.lag("total_revenue", 4).over(periods))
    wide = wide.withColumn("effective", F.date_add("date", report_lag_days)).drop("date")
    payload = [c for c in wide.columns if c not in ("ticker", "effective")]
    daily = prices.select("ticker", "date", F.col("adj_close").alias("price"))
    return as_of(daily, wide, ["ticker"], "date", "effective", payload, column_wise=True)


def fundamental_ratios(
    daily: DataFrame, sectors: DataFrame | None = None, skip: Mapping[str, Sequence[str]] | None = None,
    compat_growth: bool = False,
) -> DataFrame:
    """Valuation and quality ratios per (ticker, date).

    A ticker without any capex row counts capex as zero. Growth compares report periods;
    ``compat_growth`` compares daily rows instead. ``skip`` maps a sector to columns left null.
    """
    whole = Window.partitionBy("ticker")
    w = whole.orderBy("date")
    price, shares = F.col("price"), F.col("shares_outstanding")
    income, equity = F.col("net_income"), F.col("stockholders_equity")
    capex = F.when(F.count("capex").over(whole) == 0, F.lit(0.0)).otherwise(F.col("capex"))
    cash = F.col("operating_cashflow") - capex
    cap = price * shares
    then = F.lag("total_revenue", 4).over(w) if compat_growth else F.col("_revenue_back4")
    out = {
        "log_market_cap": F.when(cap > 0, F.ln(cap)),
        "pe": ratio(price, ratio(income, shares)),
        "pb": ratio(price, ratio(equity, shares)),
        "de": ratio("total_debt", equity),
        "roe": ratio(income, equity),
        "fcf_yield": ratio(ratio(cash, shares), price),
        "div_yield": ratio(ratio(F.abs("dividends_paid"), shares), price),
        "rev_growth_yoy": ratio("total_revenue", then) - 1.0,
    }
    rows = daily.select("ticker", "date", *[c.alias(n) for n, c in out.items()])
    if not skip or sectors is None:
        return rows
    rows = rows.join(sectors.select("ticker", "sector"), "ticker", "left")
    for name in RATIOS:
        hidden = [s for s, cols in skip.items() if name in cols]
        if hidden:
            rows = rows.withColumn(name, F.when(~F.coalesce(F.col("sector").isin(hidden), F.lit(False)), F.col(name)))
    return rows.drop("sector")


def cross_section_zscore(df: DataFrame, columns: Sequence[str], by: str = "date") -> DataFrame:
    """(x - mean) / sample deviation per date; null where the deviation is zero.

    The moments are a partial aggregate joined back, so a wide date never meets one task.
    """
    stats = df.groupBy(by).agg(
        *[F.avg(F.when(finite(c), F.col(c))).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(F.when(finite(c), F.col(c))).alias(f"_s_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}
    return df.join(stats, by).withColumns(scaled).select(*df.columns)
