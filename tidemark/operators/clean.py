"""Cleaning of daily bars. Windows per ticker hold at most one row per calendar date
once duplicates are gone, whatever share of the raw rows a ticker has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close", "adj_close"]
FLOW_COLUMNS = ["volume", "dividends", "stock_splits"]


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def drop_duplicates(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("ticker", "date"), count: str | None = None) -> DataFrame:
    """Keep the first row per key by ``order``, with the number of its rows as ``count``; an aggregate, so it combines before the shuffle.

    With one column to order by, numbers and dates are kept each by its own minimum of that column, a
    hash aggregate; strings and several columns need a sort. Rows equal in ``order`` should be equal.
    """
    rest = [c for c in df.columns if c not in keys]
    counted = [] if count is None else [F.count(F.lit(1)).alias(count)]
    if len(order) == 1 and not any(isinstance(df.schema[c].dataType, T.StringType | T.ArrayType | T.StructType | T.MapType | T.BinaryType) for c in (*rest, *order)):
        return df.groupBy(*keys).agg(*[F.min_by(c, order[0]).alias(c) for c in rest], *counted)
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r"), *counted).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], *([count] if count else []))


def drop_missing_prices(df: DataFrame) -> DataFrame:
    bad = F.isnan("close") | F.isnan("adj_close")
    return df.na.drop(subset=["close", "adj_close"]).where(~bad)


def revert_spike(threshold: float = 0.5) -> Column:
    """A jump beyond ``threshold`` in log price answered the next day by an opposite move of
    more than half of it. False for tickers with fewer than three rows and at both ends."""
    w = by_ticker()
    change = F.ln("adj_close") - F.ln(F.lag("adj_close").over(w))
    following = F.ln(F.lead("adj_close").over(w)) - F.ln("adj_close")
    flag = (
        (F.abs(change) > threshold)
        & (F.abs(following) > threshold / 2)
        & (F.signum(change) * F.signum(following) < 0)
    )
    return F.coalesce(flag, F.lit(False))


def flag_revert_spikes(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("spike", revert_spike(threshold))


def remove_revert_spikes(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return flag_revert_spikes(df, threshold).where(~F.col("spike")).drop("spike")


def fill_small_gaps(
    df: DataFrame, calendar: DataFrame | None = None, max_gap: int = 2,
    compat_zero_volume: bool = False,
) -> DataFrame:
    """Carry prices over runs of at most ``max_gap`` missing dates; longer runs stay absent.

    With a calendar (``date, dn, n_dates``) its dates are the grid, up to its end; without
    one the grid is Monday to Friday between a ticker's first and last row. Only the rows
    added are generated, never a full ticker x date grid. Adds a ``filled`` flag.
    ``compat_zero_volume`` zeroes volume, dividends and splits on present rows too.
    """
    w = by_ticker()
    if calendar is not None:
        rows = df.join(calendar, "date")
        upcoming = F.coalesce(F.lead("dn").over(w), F.col("n_dates") + 1)
        rows = rows.withColumn("_gap", upcoming - F.col("dn") - 1)
        steps = F.when(F.col("_gap") <= max_gap, F.col("_gap")).otherwise(0)
        rows = (
            rows.withColumn("_step", F.explode(F.sequence(F.lit(0), steps)))
            .withColumn("dn", F.col("dn") + F.col("_step"))
            .drop("date", "n_dates", "_gap")
            .join(calendar.select("date", "dn"), "dn")
            .withColumn("filled", F.col("_step") > 0)
            .drop("dn", "_step")
        )
    else:
        business = df.where(F.weekday("date") < 5).withColumn("_next", F.lead("date").over(w))
        near = F.datediff("_next", "date").between(2, 2 * max_gap + 10)
        between = F.when(
            near,
            F.filter(
                F.sequence(F.date_add("date", 1), F.date_sub("_next", 1), F.expr("interval 1 day")),
                lambda d: F.weekday(d) < 5,
            ),
        )
        own = F.array("date")
        dates = F.when(F.size(between).between(1, max_gap), F.concat(own, between)).otherwise(own)
        rows = (
            business.withColumn("_own", F.col("date"))
            .withColumn("_dates", dates)
            .withColumn("date", F.explode("_dates"))
            .withColumn("filled", F.col("date") != F.col("_own"))
            .drop("_next", "_own", "_dates")
        )
    zero = F.lit(True) if compat_zero_volume else F.col("filled")
    flows = {c: F.when(zero, F.lit(0.0)).otherwise(F.col(c)) for c in FLOW_COLUMNS if c in df.columns}
    return rows.withColumns(flows).select(*df.columns, "filled")


def apply_ticker_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename tickers by a fixed map, looked up in upper case; others are left as they are."""
    if not aliases:
        return df
    pairs = [F.lit(x) for kv in aliases.items() for x in (kv[0].upper(), kv[1])]
    return df.withColumn(
        "ticker", F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper("ticker")), F.col("ticker"))
    )


def clean_bars(
    df: DataFrame, order: Sequence[str], calendar: DataFrame | None = None,
    threshold: float = 0.5, max_gap: int = 2, aliases: dict[str, str] | None = None,
) -> DataFrame:
    """Duplicates, missing prices, spikes, gaps, then aliases merged (one row per date stays,
    the one of the alphabetically first former name)."""
    rows = drop_missing_prices(drop_duplicates(df, order))
    rows = fill_small_gaps(remove_revert_spikes(rows, threshold), calendar, max_gap)
    if not aliases:
        return rows
    renamed = apply_ticker_aliases(rows.withColumn("_was", F.col("ticker")), aliases)
    return drop_duplicates(renamed, ["_was"]).drop("_was")


def cleaning_report(
    df: DataFrame, order: Sequence[str], calendar: DataFrame | None = None,
    threshold: float = 0.5, max_gap: int = 2,
) -> DataFrame:
    """Per ticker: input rows, rows dropped by each step, rows added, output rows.

    The raw rows are read once; what is left of a (ticker, date) carries what happened to it as flags,
    and one aggregate by ticker adds them up.
    """
    rows = drop_duplicates(df, order, count="_rows").withColumn(
        "_priced", F.col("close").isNotNull() & F.col("adj_close").isNotNull() & ~F.isnan("close") & ~F.isnan("adj_close"))
    rows = rows.withColumn("_x", F.when(F.col("_priced"), F.ln("adj_close")))
    w = "OVER (PARTITION BY ticker ORDER BY date)"
    change, following = F.expr(f"_x - lag(_x) IGNORE NULLS {w}"), F.expr(f"lead(_x) IGNORE NULLS {w} - _x")
    spike = (F.abs(change) > threshold) & (F.abs(following) > threshold / 2) & (F.signum(change) * F.signum(following) < 0)
    rows = rows.withColumn("_spike", F.coalesce(spike, F.lit(False)))
    if calendar is not None:
        rows = rows.join(calendar.select("date", "dn", "n_dates"), "date", "left")
        rows = rows.withColumn("_kept", F.col("_priced") & ~F.col("_spike") & F.col("dn").isNotNull())
        rows = rows.withColumn("_dn", F.when(F.col("_kept"), F.col("dn")))
        gap = F.coalesce(F.expr(f"lead(_dn) IGNORE NULLS {w}"), F.col("n_dates") + 1) - F.col("_dn") - 1
    else:
        rows = rows.withColumn("_kept", F.col("_priced") & ~F.col("_spike") & (F.weekday("date") < 5))
        rows = rows.withColumn("_day", F.when(F.col("_kept"), F.col("date"))).withColumn("_next", F.expr(f"lead(_day) IGNORE NULLS {w}"))
        # Mondays to Fridays up to a date: five for each whole week since a Monday, and those of the last
        upto = lambda d: F.floor(F.datediff(d, F.lit("1900-01-01")) / F.lit(7)) * 5 + F.least(F.weekday(d), F.lit(4)) + 1
        gap = F.coalesce(upto("_next") - upto("_day") - 1, F.lit(0))
    added = F.when(F.col("_kept"), F.when(gap.between(0, max_gap), gap).otherwise(0)).otherwise(0)
    return rows.withColumn("_added", added).groupBy("ticker").agg(
        F.sum("_rows").alias("rows_in"), F.sum(F.col("_rows") - 1).alias("duplicates"), F.count_if(~F.col("_priced")).alias("missing_prices"),
        F.count_if("_spike").alias("spikes"), F.sum("_added").cast("long").alias("gap_rows_added"),
        (F.count_if("_kept") + F.sum("_added")).cast("long").alias("rows_out"))
