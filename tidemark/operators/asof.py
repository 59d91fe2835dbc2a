"""As-of joins and index membership in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
    payload: Sequence[str], tie: str | None = None, column_wise: bool = False,
) -> DataFrame:
    """Each left row with the latest right row at or before it (left join semantics).

    One union and one window per ``by`` key, no range join. ``column_wise`` carries every
    payload column's latest non-null value instead of the latest row. Of right rows on the
    same date the one with the greatest ``tie`` counts. Both sides hold at most one row per
    key and date (or per filing), so a key's window is bounded by its calendar.
    """
    by = list(by)
    keep = [c for c in left.columns if c not in by]
    tie_type = right.schema[tie].dataType if tie else "int"
    a = left.select(
        *by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"),
        F.struct(*keep).alias("_l"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_r"),
    )
    b = right.select(
        *by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"),
        (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"),
        F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*payload).alias("_r"),
    )
    w = (
        Window.partitionBy(*(by or [F.lit(1)])).orderBy("_t", "_side", F.asc_nulls_first("_tie"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = a.unionByName(b)
    if column_wise:
        carried = [F.last(F.col(f"_r.{c}"), ignorenulls=True).over(w).alias(c) for c in payload]
        rows = rows.select("*", *carried)
    else:
        rows = rows.select("*", F.last("_r", ignorenulls=True).over(w).alias("_c"))
        rows = rows.select("*", *[F.col(f"_c.{c}").alias(c) for c in payload])
    return rows.where("_side = 1").select(*by, *[F.col(f"_l.{c}").alias(c) for c in keep], *payload)


# -- membership -------------------------------------------------------------------------
# A roster is a table (snapshot_date, ticker). Distinct snapshot dates are at most one per
# calendar day, which bounds every window below that is not keyed by ticker.


def snapshot_dates(roster: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy("snapshot_date")
    return roster.select("snapshot_date").distinct().select(
        "snapshot_date", F.row_number().over(w).alias("sn"),
        F.lag("snapshot_date").over(w).alias("previous"),
        F.lead("snapshot_date").over(w).alias("valid_to"),
    )


def membership_intervals(roster: DataFrame) -> DataFrame:
    """(ticker, valid_from, valid_to): half-open, open end null."""
    return roster.join(snapshot_dates(roster), "snapshot_date").select(
        "ticker", F.col("snapshot_date").alias("valid_from"), "valid_to"
    )


def snapshot_for(dates: DataFrame, roster: DataFrame, on: str = "date") -> DataFrame:
    """Latest snapshot at or before each distinct date; null before the first."""
    days = dates.select(on).distinct()
    return as_of(days, roster.select("snapshot_date").distinct(), [], on, "snapshot_date", ["snapshot_date"])


def members_on(dates: DataFrame, roster: DataFrame, on: str = "date", strict: bool = False) -> DataFrame:
    """(date, snapshot_date, ticker). ``strict`` raises for a date before the first snapshot."""
    pairs = snapshot_for(dates, roster, on)
    if strict:
        pairs = pairs.withColumn(
            "snapshot_date",
            F.coalesce("snapshot_date", F.raise_error(F.concat(F.lit("no roster at or before "), on)).cast("date")),
        )
    return pairs.join(roster, "snapshot_date").select(on, "snapshot_date", "ticker")


def ever_members(roster: DataFrame) -> DataFrame:
    return roster.select("ticker").distinct()


def member_counts(dates: DataFrame, roster: DataFrame, on: str = "date") -> DataFrame:
    """Members per date: counted per snapshot first, then looked up."""
    sizes = roster.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n_members"))
    return snapshot_for(dates, roster, on).join(sizes, "snapshot_date").select(on, "n_members")


def roster_changes(roster: DataFrame) -> DataFrame:
    """(snapshot_date, ticker, action) against the previous snapshot, action added or removed."""
    dates = snapshot_dates(roster)
    now = roster.join(dates.where(F.col("previous").isNotNull()), "snapshot_date").select(
        "snapshot_date", "ticker", F.lit(True).alias("_now"))
    before = roster.join(dates, "snapshot_date").where(F.col("valid_to").isNotNull()).select(
        F.col("valid_to").alias("snapshot_date"), "ticker", F.lit(True).alias("_before"))
    both = now.join(before, ["snapshot_date", "ticker"], "full")
    return both.where(F.col("_now").isNull() | F.col("_before").isNull()).select(
        "snapshot_date", "ticker",
        F.when(F.col("_now").isNotNull(), "added").otherwise("removed").alias("action"),
    )


def roster_from_changes(current: DataFrame, changes: DataFrame, today: str, compat: bool = False) -> DataFrame:
    """Rebuild snapshots backwards from today's members and a list of dated changes.

    Snapshot dates are the change dates and ``today``. By default a snapshot holds the state
    from its date on; ``compat`` stores the state before the day's changes under that date.
    A ticker's changes cut its history into intervals, and only member intervals are expanded.
    """
    changes = changes.groupBy("ticker", "date").agg(F.max("action").alias("action"))
    one = Window.partitionBy(F.lit(1)).orderBy("date")
    dates = changes.select("date").distinct().withColumn("sn", F.row_number().over(one) - 1)
    end = dates.agg((F.coalesce(F.max("sn"), F.lit(-1)) + 1).alias("sn"))
    days = dates.unionByName(end.select(F.to_date(F.lit(today)).alias("date"), "sn"))
    last_state = (
        current.select("ticker", F.lit(True).alias("member"))
        .unionByName(changes.select("ticker", F.lit(False).alias("member")))
        .groupBy("ticker").agg(F.max("member").alias("member"))
        .withColumn("date", F.to_date(F.lit(today)))
    )
    states = changes.select("ticker", "date", (F.col("action") == "removed").alias("member"))
    states = states.unionByName(last_state.select(*states.columns)).join(days, "date")
    w = Window.partitionBy("ticker").orderBy("sn")
    previous = F.lag("sn").over(w)
    is_end = F.col("date") == F.to_date(F.lit(today))
    if compat:
        low, high = F.coalesce(previous + 1, F.lit(0)), F.col("sn")
    else:
        low = F.coalesce(previous, F.lit(0))
        high = F.when(is_end, F.col("sn")).otherwise(F.col("sn") - 1)
    spans = states.select("ticker", "member", low.alias("_lo"), high.alias("_hi"))
    return (
        spans.where(F.col("member") & (F.col("_lo") <= F.col("_hi")))
        .select("ticker", F.explode(F.sequence("_lo", "_hi")).alias("sn"))
        .join(days, "sn")
        .select(F.col("date").alias("snapshot_date"), "ticker")
    )


# Well-known index events, by which a roster is checked unless others are given.
KNOWN_EVENTS = [("TSLA", "2020-12-21", "added"), ("META", "2013-12-23", "added"), ("GOOG", "2006-04-03", "added")]


def validate_roster(
    roster: DataFrame, known_events: DataFrame | None = None, low: int = 490, high: int = 520,
    tolerance_days: int = 3, count_from_year: int = 2001,
) -> DataFrame:
    """Error rows: a known addition absent on every date within the tolerance, and snapshots
    whose size is implausible. ``known_events`` is (ticker, date, action), ``KNOWN_EVENTS`` if not given."""
    if known_events is None:
        known_events = roster.sparkSession.createDataFrame(KNOWN_EVENTS, "ticker string, date string, action string").withColumn("date", F.to_date("date"))
    added = known_events.where(F.col("action") == "added").select("ticker", F.col("date").alias("event_date"))
    probes = added.select(
        "ticker", "event_date",
        F.explode(F.sequence(F.date_sub("event_date", tolerance_days),
                             F.date_add("event_date", tolerance_days),
                             F.expr("interval 1 day"))).alias("date"),
    )
    seen = probes.join(snapshot_for(probes, roster), "date").join(roster, ["snapshot_date", "ticker"], "left_semi")
    absent = added.join(seen.select("ticker", "event_date").distinct(), ["ticker", "event_date"], "left_anti").select(
        F.lit("missing_event").alias("error"), "ticker", F.col("event_date").alias("date"),
        F.lit(None).cast("bigint").alias("n_members"))
    odd = (
        roster.where(F.year("snapshot_date") >= count_from_year)
        .groupBy(F.col("snapshot_date").alias("date")).agg(F.count(F.lit(1)).alias("n_members"))
        .where(~F.col("n_members").between(low, high))
        .select(F.lit("implausible_count").alias("error"), F.lit(None).cast("string").alias("ticker"), "date", "n_members")
    )
    return absent.unionByName(odd)


def keep_members(df: DataFrame, roster: DataFrame, on: str = "date") -> DataFrame:
    """Rows whose ticker is a member on the row's date."""
    pairs = snapshot_for(df, roster, on).where(F.col("snapshot_date").isNotNull())
    return df.join(pairs, on).join(roster, ["snapshot_date", "ticker"], "left_semi").select(*df.columns)


def ticker_universe(prices: DataFrame, roster: DataFrame | None = None, given: DataFrame | None = None) -> DataFrame:
    """Given tickers trimmed and upper-cased, or every past member that has prices."""
    if given is not None:
        return given.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return ever_members(roster).join(prices.select("ticker").distinct(), "ticker", "left_semi")


def sample_anchor(dates: DataFrame, rows: DataFrame, roster: DataFrame) -> DataFrame:
    """For each prediction date and member: the ticker's last own row at or before it.

    ``rows`` is (ticker, date, rn). Output (pred_date, ticker, anchor_date, anchor_rn).
    """
    members = members_on(dates, roster, "pred_date").select("pred_date", "ticker")
    right = rows.select("ticker", "date", F.col("date").alias("anchor_date"), F.col("rn").alias("anchor_rn"))
    found = as_of(members, right, ["ticker"], "pred_date", "date", ["anchor_date", "anchor_rn"])
    return found.where(F.col("anchor_date").isNotNull()).select("pred_date", "ticker", "anchor_date", "anchor_rn")


def merge_groups(groups: Sequence[DataFrame], keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Full outer join of feature groups; of columns with one name the first group's stays."""
    merged = groups[0]
    for g in groups[1:]:
        new = [c for c in g.columns if c in keys or c not in merged.columns]
        merged = merged.join(g.select(*new), list(keys), "full")
    return merged
