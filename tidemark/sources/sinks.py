"""Writers and resumable work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Snappy parquet, partitioned by low-cardinality columns only."""
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_by_ticker(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Bars clustered by ticker: hash buckets as folders and rows sorted, so that a ticker filter
    skips row groups without a folder per ticker. A bucket too large for a file is split."""
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int"))
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "ticker", "date").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_report(summary: DataFrame, series: dict[str, DataFrame], folder: str) -> None:
    """Summary as JSON and each daily series as CSV with header, all per run folder."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    for name, df in series.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def append_summary(row: DataFrame, path: str) -> None:
    """Append summary rows to a shared CSV table."""
    row.write.mode("append").option("header", True).csv(path)


def roster_to_json(roster: DataFrame, longest: int = 10_000) -> DataFrame:
    """JSON maps of a snapshot date to sorted tickers, one per row. A snapshot of more than about
    ``longest`` members continues in further rows; reading merges them."""
    sizes = roster.groupBy("snapshot_date").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(longest))).alias("_parts"))
    cut = roster.join(sizes, "snapshot_date").withColumn("part", F.pmod(F.xxhash64("ticker"), F.col("_parts")))
    return cut.groupBy("snapshot_date", "part").agg(F.sort_array(F.collect_set("ticker")).alias("_t")).select(
        "snapshot_date", F.to_json(F.create_map(F.col("snapshot_date").cast("string"), F.col("_t"))).alias("json"))


def pending(work: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items whose key has not landed yet."""
    return work.join(landed.select(*keys).distinct(), list(keys), "left_anti")


def work_status(work: DataFrame, landed_before: DataFrame, landed_now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(status, n): skipped (there before), succeeded (landed now), failed (neither)."""
    keys = list(keys)
    rows = (
        work.select(*keys).distinct()
        .join(landed_before.select(*keys).distinct().withColumn("_b", F.lit(True)), keys, "left")
        .join(landed_now.select(*keys).distinct().withColumn("_n", F.lit(True)), keys, "left"))
    status = F.when(F.col("_b"), "skipped").when(F.col("_n"), "succeeded").otherwise("failed")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
