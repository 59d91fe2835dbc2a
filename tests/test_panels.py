"""The bars that most queries start from."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.plans.base import bars


def test_bars_sum_exactly_from_small_buffers(spark):
    day = dt.date(1995, 3, 1)
    rows = [(k, 1, 7, float(k % 50), round(901.01 + 1234.57 * k, 2), round(0.01 * (k % 11), 2), day) for k in range(1, 400)]
    rows += [(500, 1, None, 1.0, 1000.0, 0.05, day), (501, 1, 8, 1.0, None, None, day)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date")
    out = bars(df, F.col("l_shipdate"))
    got = {r.ticker: r for r in out.collect()}
    n = len(rows) - 2
    money, discount = (float(sum(Decimal(str(r[c])) for r in rows[:n])) for c in (4, 5))
    assert got["S7"].adj_close == 100 + money / n / 10000 + 100 * discount / n
    assert got[None].volume == 1.0 and got["S8"].adj_close is None
    # wide decimals and strings as keys made a partial aggregate of many groups spill
    assert "Aggregate [l_suppkey" in out._jdf.queryExecution().optimizedPlan().toString()


def test_bars_travel_as_rows_unless_a_supplier_has_very_many(spark, monkeypatch):
    from tidemark.plans import base

    day = dt.date(1995, 3, 1)
    rows = [(k, 1, 7 if k < 50 else 8, 1.0, 1000.0 + k, 0.05, day + dt.timedelta(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate date")
    whole = bars(df, F.col("l_shipdate"))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    # an aggregate before the shuffle held nearly every line item of a task in memory
    assert "HashAggregate" not in plan[plan.index("Exchange"):]
    monkeypatch.setattr(base, "PER_RANGE", 20)
    cut = bars(df, F.col("l_shipdate"))
    assert sorted(cut.collect()) == sorted(whole.collect()) and whole.count() == 6


def test_calendars_and_keys_need_no_bars(spark):
    from __spark_entry__ import queries
    from tidemark.plans.base import Inputs

    folder = "/root/testdata/sf0.001"
    fresh = Inputs(spark, folder)
    assert fresh.daily_calendar.count() and fresh.calendar.count() and fresh.traded.count() and fresh.weekly.count()
    assert "daily" not in fresh._stored and "weekly_raw" not in fresh._stored
    assert fresh.traded.select("ticker").distinct().count() == fresh.weekly.select("ticker").distinct().count()
    keys = sorted(fresh.daily_keys.collect())
    assert keys == sorted(fresh.daily.select("ticker", "date").collect())
    assert queries()["prj1_ticker_universe"](spark, folder).count() == fresh.roster.select("ticker").distinct().count()
