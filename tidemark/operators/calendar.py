"""Trading calendars, business-day spines, prediction dates and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_calendar(prices: DataFrame) -> DataFrame:
    """Union of all dates with ordinal ``dn`` from 1 and the size ``n_dates``.

    One row per calendar day at most, so the un-partitioned windows below see at most a
    few ten thousand rows however large ``prices`` is.
    """
    dates = prices.select("date").distinct()
    everything = Window.partitionBy(F.lit(1))
    return dates.select(
        "date",
        F.row_number().over(everything.orderBy("date")).alias("dn"),
        F.count(F.lit(1)).over(everything).cast("int").alias("n_dates"),
    )


def is_business_day(date: str | Column) -> Column:
    return F.weekday(date) < 5


def business_days(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per Monday-to-Friday date between two date columns; other columns are kept."""
    keep = [c for c in bounds.columns if c not in (start, end)]
    spine = F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day")))
    return bounds.select(*keep, spine.alias("date")).where(is_business_day("date"))


def keep_calendar_dates(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows whose date is in the calendar."""
    return prices.join(calendar.select("date"), "date", "left_semi")


def prediction_dates(
    calendar: DataFrame, start: str, end: str, lookback: int, horizon: int,
    stride: int = 1, offset: int = 0, purge: int = 0, compat_last_date: bool = False,
) -> DataFrame:
    """Dates with a full lookback before and a target after, thinned by stride, tail purged.

    ``compat_last_date`` keeps one date more at the end, whose target does not exist.
    ``purge`` counts thinned dates. Runs on the calendar only, at most one row per day.
    """
    last = F.col("n_dates") - horizon + (1 if compat_last_date else 0)
    valid = calendar.where(
        F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        & (F.col("dn") >= lookback) & (F.col("dn") <= last)
    )
    one = Window.partitionBy(F.lit(1))
    thinned = (
        valid.withColumn("k", F.row_number().over(one.orderBy("date")) - 1)
        .where((F.col("k") >= offset) & (F.pmod(F.col("k") - offset, F.lit(stride)) == 0))
    )
    ranked = thinned.withColumn("_back", F.row_number().over(one.orderBy(F.desc("date")))).withColumn(
        "_all", F.count(F.lit(1)).over(one)
    )
    # as in the rule being matched, a purge of everything leaves the dates untouched
    return ranked.where((F.col("_back") > purge) | (F.col("_all") <= purge)).select(
        F.col("date").alias("pred_date"), "dn", "k"
    )


def rotation_folds(calendar: DataFrame, start: str, end: str, lookback: int, horizon: int,
                   stride: int) -> DataFrame:
    """Every valid prediction date with the fold (0..stride-1) whose rotation visits it."""
    every = prediction_dates(calendar, start, end, lookback, horizon)
    return every.withColumn("fold", F.pmod("k", F.lit(stride)).cast("int"))


def assign_split(date: str | Column, splits: dict[str, tuple[str, str]]) -> Column:
    """Name of the first split whose inclusive range holds the date, else null."""
    date = F.col(date) if isinstance(date, str) else date
    out = None
    for name, (lo, hi) in splits.items():
        hit = date.between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi)))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def date_filter(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.where(F.col(date) >= F.to_date(F.lit(start)))
    if end:
        df = df.where(F.col(date) <= F.to_date(F.lit(end)))
    return df
