"""Memory of a task follows from what a partition holds, not from how many the session makes."""

import pytest

from tests.panels import day, random_walk


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sample_windows_lie_in_bounded_partitions(spark, one_partition):
    from tidemark.operators.samples import build_samples

    prices = spark.createDataFrame(random_walk(["A", "B"], 60))
    dates = prices.where("date >= '2020-03-01'").select("date").distinct().limit(3).withColumnRenamed("date", "pred_date")
    roster = spark.createDataFrame([(day("2020-01-01"), "A"), (day("2020-01-01"), "B")], "snapshot_date date, ticker string")
    windows, labels = build_samples(prices, roster, dates, 12, 2)
    assert windows.count() == 12 * labels.count() > 0
    assert "RepartitionByExpression [ticker" in optimized(windows)


def test_scores_of_line_items_are_not_combined_before_the_shuffle(spark):
    from __spark_entry__ import queries

    panel = queries()["fen1_feature_panel"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression [l_suppkey" in optimized(panel)


def test_a_backtest_shuffles_prices_of_rebalance_days_for_its_universe(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.backtest import run_backtest
    from tidemark.operators.portfolio import constructor

    prices = spark.createDataFrame(random_walk(["A", "B", "C", "D"], 60))
    scores = prices.select(F.col("date").alias("pred_date"), "ticker", F.col("adj_close").alias("score"))
    seen = []

    def construct(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return constructor("equal", top_n=1)(df)

    result = run_backtest(scores, prices, construct, "M")
    # scores and prices are both cut to the rebalance days before they meet
    assert seen[0].count("rebalance#") >= 2 and seen[0].count("Relation [date#") == 2
    assert result.daily.count() == 60 and result.positions.count() > 0
