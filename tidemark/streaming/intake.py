"""Structured Streaming counterparts of the forward test and the message counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.forward import PredictionLog


def distinct_predictions(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop repeated (pred_date, ticker) rows of a stream with event time ``ts`` within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["pred_date", "ticker"])


def log_predictions(stream: DataFrame, log: PredictionLog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch to the log in one commit, under its number: a replayed batch is
    skipped, also after a stop between commit and checkpoint, and a date may arrive in several batches."""

    def land(batch: DataFrame, number: int) -> None:
        log.append(batch, writer=checkpoint, batch=number)

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def landed(session: SparkSession, path: str) -> bool:
    """Whether a table has been written at the path."""
    jvm = session.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(place)


def score_on_arrival(stream: DataFrame, log: PredictionLog, prices_path: str, checkpoint: str) -> StreamingQuery:
    """Land each batch of bars, then back-score whatever has matured."""

    def land(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        bars = batch.withColumn("day", F.col("date")).groupBy("ticker", "date").agg(
            F.min(F.struct(*[c for c in (*batch.columns, "day") if c not in ("ticker", "date")])).alias("_bar")).select("ticker", "date", "_bar.*")
        if landed(session, prices_path):
            # a replayed batch does not duplicate bars, and a day may come in pieces
            bars = bars.join(session.read.parquet(prices_path).select("ticker", "date"), ["ticker", "date"], "left_anti")
        bars.write.mode("append").partitionBy("day").parquet(prices_path)
        log.rescore(session.read.parquet(prices_path))

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling day windows of (ts, ticker, source, score): message count and score sum."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "ticker", "source").agg(
        F.count(F.lit(1)).alias("volume"), F.sum("score").alias("score_sum")
    ).select(F.col("window.start").cast("date").alias("date"), "ticker", "source", "volume", "score_sum")


def sliding_baseline(stream: DataFrame, days: int = 20, delay: str = "1 hour") -> DataFrame:
    """Mean messages per day over sliding windows of ``days``, moved by one day.

    Messages are counted by day first; only these panes are copied into the windows they are part of.
    """
    panes = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("pane"), "ticker").agg(F.count(F.lit(1)).alias("_n"))
    return panes.groupBy(F.window("pane", f"{days} days", "1 day"), "ticker").agg(
        (F.sum("_n") / F.lit(float(days))).alias("daily_mean")
    ).select(F.col("window.end").cast("date").alias("date"), "ticker", "daily_mean")


def run_available(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> None:
    """Process everything available into parquet files and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(output_mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
