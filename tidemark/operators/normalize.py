"""Leak-safe normalisation of feature panels."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, finite
from tidemark.operators.spread import column_quantiles
from tidemark.session import cut_lineage

KEYS = ("ticker", "date")


def feature_columns(df: DataFrame, keys: Sequence[str] = KEYS) -> list[str]:
    return [c for c in df.columns if c not in keys]


def past_zscore(df: DataFrame, columns: Sequence[str], window: int = 252) -> DataFrame:
    """z against the previous ``window`` rows of the ticker, today excluded; needs a quarter of them."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-window, -1)
    scaled = {}
    for c in columns:
        z = (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
        scaled[c] = F.when(F.count(c).over(w) >= window // 4, z)
    return df.withColumns(scaled)


def fill_with_date_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls take the median of the column on that date, zero where the whole date is null.

    The medians of all columns are one wide aggregate per date. The rows are written first, as what
    made them would else be computed for the medians and for the fill.
    """
    df = cut_lineage(df)
    wide = column_quantiles(df, ["date"], columns, {"_med": 0.5}).withColumnsRenamed({f"{c}__med": f"_med_{c}" for c in columns})
    filled = {c: F.coalesce(F.col(c), F.col(f"_med_{c}"), F.lit(0.0)) for c in columns}
    return df.join(wide, "date", "left").withColumns(filled).select(*df.columns)


def winsorise(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(clip(c, -limit, limit), F.lit(0.0)) for c in columns})


@dataclass
class PanelNormalizer:
    """Fit on training dates, then z against the past, median fill and winsorise.

    The fitted moments are diagnostics; ``transform`` uses past rows only.
    """

    window: int = 252
    limit: float = 3.0
    columns: list[str] = field(default_factory=list)
    train_end: str | None = None
    moments: dict[str, list[float | None]] = field(default_factory=dict)

    def training_moments(self, df: DataFrame, train_end: str, columns: Sequence[str] | None = None) -> DataFrame:
        """One row: mean and sample deviation of each column up to ``train_end``."""
        columns = list(columns or feature_columns(df))
        rows = df.where(F.col("date") <= F.to_date(F.lit(train_end)))
        return rows.agg(
            *[F.avg(F.when(finite(c), F.col(c))).alias(f"mean_{c}") for c in columns],
            *[F.stddev_samp(F.when(finite(c), F.col(c))).alias(f"std_{c}") for c in columns])

    def fit(self, df: DataFrame, train_end: str) -> PanelNormalizer:
        self.columns, self.train_end = feature_columns(df), train_end
        row = self.training_moments(df, train_end).first()  # one row by construction
        self.moments = {c: [row[f"mean_{c}"], row[f"std_{c}"]] for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            raise RuntimeError("fit the normalizer before transform")
        rows = df.select(*KEYS, *[
            (F.when(finite(c), F.col(c)) if c in df.columns else F.lit(None)).cast("double").alias(c)
            for c in self.columns])
        rows = past_zscore(rows, self.columns, self.window)
        return winsorise(fill_with_date_median(rows, self.columns), self.columns, self.limit)

    def fit_transform(self, df: DataFrame, train_end: str) -> DataFrame:
        return self.fit(df, train_end).transform(df)

    def save(self, path: str) -> None:
        """Write the state to a folder that Spark's executors share."""
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> PanelNormalizer:
        return cls(**json.loads(SparkSession.active().read.text(path).first()[0]))


def cross_section_standardise(
    samples: DataFrame, columns: Sequence[str], by: Sequence[str] = ("pred_date", "lag"), least: int = 5,
) -> DataFrame:
    """Null and infinite to zero, then (x - mean) / population deviation per (date, lag); a
    deviation under 1e-6 counts as 1; dates with fewer than ``least`` tickers stay raw.
    The moments are a partial aggregate joined back."""
    by = list(by)
    clean = samples.withColumns({c: F.when(finite(c), F.col(c)).otherwise(0.0) for c in columns})
    stats = clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {
        c: F.when(
            F.col("_n") >= least,
            (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}")),
        ).otherwise(F.col(c))
        for c in columns
    }
    return clean.join(stats, by).withColumns(scaled).select(*samples.columns)
