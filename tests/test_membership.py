"""Membership in time and as-of joins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import day
from tidemark.operators import asof


@pytest.fixture(scope="module")
def roster(spark):
    rows = [("2010-01-04", t) for t in ("A", "B")] + [("2013-12-23", t) for t in ("A", "B", "M")] + [("2020-12-21", t) for t in ("A", "M", "T")]
    return spark.createDataFrame([(day(d), t) for d, t in rows], "snapshot_date date, ticker string")


def _dates(spark, *texts, name="date"):
    return spark.createDataFrame([(day(t),) for t in texts], f"{name} date")


def _set(df):
    return {(str(r[0]), r[-1]) for r in df.collect()}


def test_members_follow_the_latest_snapshot(spark, roster):
    out = asof.members_on(_dates(spark, "2010-01-04", "2013-12-22", "2013-12-23", "2024-01-01"), roster)
    assert _set(out) == {("2010-01-04", "A"), ("2010-01-04", "B"), ("2013-12-22", "A"), ("2013-12-22", "B"),
                         ("2013-12-23", "A"), ("2013-12-23", "B"), ("2013-12-23", "M"), ("2024-01-01", "A"), ("2024-01-01", "M"), ("2024-01-01", "T")}


def test_before_the_first_snapshot(spark, roster):
    early = _dates(spark, "2001-01-01")
    assert asof.members_on(early, roster).count() == 0
    with pytest.raises(Exception, match="no roster"):
        asof.members_on(early, roster, strict=True).collect()


def test_changes_and_rebuild(spark, roster):
    changes = asof.roster_changes(roster)
    assert {tuple(map(str, r)) for r in changes.collect()} == {
        ("2013-12-23", "M", "added"), ("2020-12-21", "T", "added"), ("2020-12-21", "B", "removed")}
    dated = changes.select("ticker", F.col("snapshot_date").alias("date"), "action")
    current = roster.where("snapshot_date = '2020-12-21'").select("ticker")
    right = asof.roster_from_changes(current, dated, "2025-01-01")
    assert _set(right) == {("2013-12-23", t) for t in "ABM"} | {("2020-12-21", t) for t in "AMT"} | {("2025-01-01", t) for t in "AMT"}
    lagging = asof.roster_from_changes(current, dated, "2025-01-01", compat=True)
    assert _set(lagging) == {("2013-12-23", t) for t in "AB"} | {("2020-12-21", t) for t in "ABM"} | {("2025-01-01", t) for t in "AMT"}


def test_validation(spark, roster):
    events = spark.createDataFrame([("M", day("2013-12-21"), "added"), ("T", day("2020-12-10"), "added")], "ticker string, date date, action string")
    out = asof.validate_roster(roster, events, low=3, high=3).collect()
    assert {(r.error, r.ticker) for r in out} == {("missing_event", "T"), ("implausible_count", None)}
    assert [r.n_members for r in out if r.ticker is None] == [2]


def test_keep_members(spark, roster):
    rows = spark.createDataFrame([("B", day("2015-01-01")), ("B", day("2021-01-01")), ("Z", day("2015-01-01")), ("A", day("2000-01-01"))], "ticker string, date date")
    assert [tuple(r) for r in asof.keep_members(rows, roster).collect()] == [("B", day("2015-01-01"))]


def test_as_of_rows_and_columns(spark):
    left = spark.createDataFrame(pd.DataFrame({"k": "A", "t": [1, 3, 5, 9], "v": list("wxyz")}))
    right = spark.createDataFrame([("A", 2, 1.0, 10.0, 1), ("A", 5, None, 20.0, 1), ("A", 5, None, 30.0, 2), ("B", 1, 7.0, 7.0, 1)], "k string, s bigint, p double, q double, seq int")
    rowwise = {r.t: (r.p, r.q) for r in asof.as_of(left, right, ["k"], "t", "s", ["p", "q"], tie="seq").collect()}
    assert rowwise == {1: (None, None), 3: (1.0, 10.0), 5: (None, 30.0), 9: (None, 30.0)}
    columnwise = {r.t: (r.p, r.q) for r in asof.as_of(left, right, ["k"], "t", "s", ["p", "q"], tie="seq", column_wise=True).collect()}
    assert columnwise == {1: (None, None), 3: (1.0, 10.0), 5: (1.0, 30.0), 9: (1.0, 30.0)}


def test_universe(spark, roster):
    given = spark.createDataFrame([(" a ",), ("A",), ("b",)], "ticker string")
    assert {r.ticker for r in asof.ticker_universe(None, given=given).collect()} == {"A", "B"}
    prices = spark.createDataFrame([("A",), ("Q",)], "ticker string")
    assert {r.ticker for r in asof.ticker_universe(prices, roster).collect()} == {"A"}


def test_known_events_are_checked_by_default(spark):
    roster = spark.createDataFrame([(day("2013-12-23"), "META"), (day("2006-04-03"), "GOOG"), (day("2020-12-21"), "AAPL")], "snapshot_date date, ticker string")
    out = asof.validate_roster(roster, low=1, high=1).collect()
    assert [(r.error, r.ticker) for r in out] == [("missing_event", "TSLA")]
