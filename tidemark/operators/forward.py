"""Forward test: an append-only prediction log that is scored once returns have matured.

Log rows are (pred_date, ticker, score, horizon); result rows (pred_date, ic, hit_rate,
spread, n_valid, horizon).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import finite, log_ratio
from tidemark.operators.calendar import trading_calendar
from tidemark.operators.ranking import daily_metrics
from tidemark.session import cut_lineage
from tidemark.sources.commits import CommittedTable

LOG_SCHEMA = T.StructType([
    T.StructField("pred_date", T.DateType()), T.StructField("ticker", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("horizon", T.IntegerType())])
RESULT_SCHEMA = T.StructType([
    T.StructField("pred_date", T.DateType()), T.StructField("ic", T.DoubleType()),
    T.StructField("hit_rate", T.DoubleType()), T.StructField("spread", T.DoubleType()),
    T.StructField("n_valid", T.LongType()), T.StructField("horizon", T.IntegerType())])


class PredictionLog:
    """Predictions and results as committed tables below one folder: a date is there with all rows of a
    change or with none, several writers may append at once, and a change that stops leaves nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.prediction_table = CommittedTable(spark, os.path.join(folder, "predictions"), LOG_SCHEMA, "pred_date")
        self.result_table = CommittedTable(spark, os.path.join(folder, "results"), RESULT_SCHEMA, "pred_date")

    def predictions(self) -> DataFrame:
        return self.prediction_table.read()

    def results(self) -> DataFrame:
        return self.result_table.read()

    def append(self, predictions: DataFrame, writer: str | None = None, batch: int = 0) -> bool:
        """Add predictions of a ticker and date that are not logged yet; what is logged stays.

        So a date may come in pieces, and a piece that comes again changes nothing. Of several
        predictions of one ticker and date the one of the shortest horizon, then of the lowest
        score, is taken, whatever the order of the rows. A ``writer`` that numbers its batches is
        not asked twice for the same one.
        """
        new = predictions.select([F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA])
        new = new.groupBy("pred_date", "ticker").agg(F.min(F.struct("horizon", "score")).alias("_first")).select(
            "pred_date", "ticker", "_first.score", "_first.horizon")

        def missing(logged: DataFrame) -> DataFrame:
            # only dates of this piece are read
            known = logged.join(new.select("pred_date").distinct(), "pred_date", "left_semi").select("pred_date", "ticker")
            return new.join(known, ["pred_date", "ticker"], "left_anti").select(*LOG_SCHEMA.names)

        return self.prediction_table.change(missing, writer=writer, batch=batch)

    def upsert_results(self, results: DataFrame) -> None:
        """Write results, replacing whole dates that exist already; there is about a row per date."""
        rows = results.select([F.col(f.name).cast(f.dataType) for f in RESULT_SCHEMA])
        self.result_table.change(
            lambda old: old.join(rows.select("pred_date").distinct(), "pred_date", "left_anti").select(*RESULT_SCHEMA.names).unionByName(rows), replace=True)

    def predictions_on(self, date: str) -> DataFrame:
        return self.predictions().where(F.col("pred_date") == F.to_date(F.lit(date)))

    def overview(self) -> DataFrame:
        """(pred_date, n_tickers, horizon) per logged date."""
        return log_overview(self.predictions())

    def recent(self, n: int = 10) -> DataFrame:
        return recent_results(self.results(), n)

    def rescore(self, prices: DataFrame, top_n: int = 50) -> DataFrame:
        """Score every matured date that has no result yet and store it."""
        fresh = back_score(self.predictions(), prices, self.results(), top_n)
        self.upsert_results(cut_lineage(fresh))
        return self.results()


def log_overview(log: DataFrame) -> DataFrame:
    return log.groupBy("pred_date").agg(F.count(F.lit(1)).alias("n_tickers"), F.max("horizon").alias("horizon"))


def recent_results(results: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` result rows by date."""
    return results.orderBy(F.desc("pred_date")).limit(n)


def explode_records(records: DataFrame) -> DataFrame:
    """Array records (date, tickers, scores, horizon) to log rows; arrays of unequal length raise."""
    checked = records.withColumn("tickers", F.when(F.size("tickers") == F.size("scores"), F.col("tickers")).otherwise(
        F.raise_error(F.lit("scores and tickers differ in length")).cast("array<string>")))
    zipped = F.explode(F.arrays_zip("tickers", "scores")).alias("_z")
    return checked.select(F.to_date("date").alias("pred_date"), zipped, "horizon").select(
        "pred_date", F.col("_z.tickers").alias("ticker"), F.col("_z.scores").alias("score"), "horizon")


def matured(log: DataFrame, prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """(pred_date, ticker, score, target, horizon) of dates in the calendar whose target date,
    ``horizon`` rows later on the union calendar, exists."""
    calendar = (calendar if calendar is not None else trading_calendar(prices)).select("date", "dn")
    ends = calendar.select(F.col("dn").alias("_dn_end"), F.col("date").alias("_end"))
    dates = (
        log.select("pred_date", "horizon").distinct()
        .join(calendar.withColumnRenamed("date", "pred_date"), "pred_date")
        .withColumn("_dn_end", F.col("dn") + F.col("horizon")).join(ends, "_dn_end")
        .select("pred_date", "horizon", "_end")
    )
    px = prices.select("ticker", "date", "adj_close")
    now = px.select("ticker", F.col("date").alias("pred_date"), F.col("adj_close").alias("_p0"))
    then = px.select("ticker", F.col("date").alias("_end"), F.col("adj_close").alias("_p1"))
    rows = log.join(dates, ["pred_date", "horizon"]).join(now, ["ticker", "pred_date"], "left").join(then, ["ticker", "_end"], "left")
    return rows.select("pred_date", "ticker", "score", log_ratio("_p1", "_p0").alias("target"), "horizon")


def back_score(
    log: DataFrame, prices: DataFrame, results: DataFrame | None = None, top_n: int = 50, least: int = 5,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Metrics of matured dates without a result, given at least ``least`` valid names."""
    if results is not None:
        log = log.join(results.select("pred_date"), "pred_date", "left_anti")
    # ranks, legs and counts all read these rows, so they are joined once and kept
    rows = cut_lineage(matured(log, prices, calendar).where(finite("target") & finite("score")))
    return daily_metrics(rows, ["pred_date", "horizon"], top_n).where(F.col("n_valid") >= least).select(
        "pred_date", "ic", "hit_rate", "spread", F.col("n_valid").cast("bigint").alias("n_valid"), "horizon")


def live_summary(results: DataFrame) -> DataFrame:
    """One row over the scored dates (at most one per day): counts, mean IC overall and of the
    last 30 and 90 rows, IC over its deviation, hit rate and the date range."""
    one = Window.partitionBy(F.lit(1)).orderBy(F.desc("pred_date"))
    rows = results.withColumn("_back", F.row_number().over(one))

    def tail(n: int):
        return F.avg(F.when(F.col("_back") <= n, F.col("ic")))

    std = F.stddev_pop("ic")
    return rows.agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg("ic").alias("mean_ic"), tail(30).alias("ic_30"), tail(90).alias("ic_90"),
        F.when(std > 1e-12, F.avg("ic") / std).alias("ic_ir"), F.avg("hit_rate").alias("hit_rate"),
        F.min("pred_date").alias("first_date"), F.max("pred_date").alias("last_date"))


def latest_date(prices: DataFrame) -> DataFrame:
    """One row: the greatest date; reads the date column only."""
    return prices.agg(F.max("date").alias("as_of"))
