"""Session defaults and the shared work folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "tidemark") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; on a cluster, where executors
    would each see a folder of their own, it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="spark-")
    return _fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(work_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back.

    Later reads prune columns, know the size of the table (so Spark decides itself
    whether it may be broadcast) and have no lineage to recompute.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    Like a reliable checkpoint it survives the loss of executors; unlike one it is computed
    once and stays columnar.
    """
    spark = df.sparkSession
    path = new_path(spark, "step")
    if spark.sparkContext.applicationId in _kept:
        _kept[spark.sparkContext.applicationId].append(path)
    return store(df, path)


#: Steps written since ``keep_steps``, by application.
_kept: dict[str, list[str]] = {}


def keep_steps(spark: SparkSession) -> None:
    """From here on ``drop_steps`` knows which steps were written."""
    _kept[spark.sparkContext.applicationId] = []


def drop_steps(spark: SparkSession) -> None:
    """Delete the steps written since ``keep_steps``, once nothing that reads them is to be computed
    any more, and let go of shuffle files of plans that are out of use."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _kept.pop(spark.sparkContext.applicationId, []):
        place = hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are out of use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
