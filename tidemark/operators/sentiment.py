"""Daily sentiment features from (ticker, date, source, score, volume)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio

# Default source weights and the two source families.
SOURCE_WEIGHTS = {"finviz": 0.4, "stocktwits": 0.3, "reddit": 0.3}
NEWS = ["finviz"]
SOCIAL = ["stocktwits", "reddit"]


def concat_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def daily_sentiment(
    long: DataFrame, weights: Mapping[str, float] = SOURCE_WEIGHTS,
    news: Sequence[str] = NEWS, social: Sequence[str] = SOCIAL,
) -> DataFrame:
    """Weighted composite, news/social divergence and total volume per (ticker, date)."""
    pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0))
    return long.withColumn("_w", weight).groupBy("ticker", "date").agg(
        ratio(F.sum(F.col("score") * F.col("_w")), F.sum("_w")).alias("sent_composite"),
        F.abs(
            F.avg(F.when(F.col("source").isin(list(news)), F.col("score")))
            - F.avg(F.when(F.col("source").isin(list(social)), F.col("score")))
        ).alias("sent_divergence"),
        F.sum("volume").cast("double").alias("sent_volume"),
    )


def on_spine(daily: DataFrame, spine: DataFrame, missing_fill: float = 0.0) -> DataFrame:
    """One row per spine (ticker, date), days without messages filled."""
    return spine.select("ticker", "date").join(daily, ["ticker", "date"], "left").na.fill(
        {"sent_composite": missing_fill, "sent_divergence": missing_fill, "sent_volume": 0.0})


def sentiment_features(
    long: DataFrame, spine: DataFrame | None = None, weights: Mapping[str, float] = SOURCE_WEIGHTS,
    missing_fill: float = 0.0, momentum: int = 5, baseline: int = 20,
) -> DataFrame:
    """Composite, its change over ``momentum`` rows, divergence and volume against its mean of
    the last ``baseline`` rows. Spine tickers without any message get (0, 0, 0, 1)."""
    daily = daily_sentiment(long, weights)
    if spine is not None:
        daily = on_spine(daily, spine, missing_fill)
    w = Window.partitionBy("ticker").orderBy("date")
    usual = F.avg("sent_volume").over(w.rowsBetween(-(baseline - 1), 0))
    change = F.col("sent_composite") - F.lag("sent_composite", momentum).over(w)
    return daily.select(
        "ticker", "date", "sent_composite",
        F.coalesce(change, F.lit(0.0)).alias("sent_momentum_5d"),
        "sent_divergence",
        F.coalesce(ratio("sent_volume", usual), F.lit(1.0)).alias("sent_mention_spike"),
    )
