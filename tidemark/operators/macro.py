"""Market-wide series as features of a prediction date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, finite, log_ratio
from tidemark.operators.asof import as_of

# Feature name -> series.
MACRO_FEATURES = {
    "vix_change_5d": "vix", "tnx_change_5d": "tnx", "dxy_return_5d": "dxy", "spy_return_5d": "spy",
}


def macro_features(series: DataFrame, dates: DataFrame, window: int = 5) -> DataFrame:
    """(pred_date, four features): log change over ``window`` rows of the last row at or before
    the date, clipped to +-1, zero where unknown. Series and dates hold one row per day."""
    w = Window.partitionBy("series").orderBy("date")
    now, then = F.col("close"), F.lag("close", window).over(w)
    ok = finite(now) & finite(then)
    change = series.select("series", "date", F.when(ok, log_ratio(now, then)).alias("change"))
    days = dates.select("pred_date").distinct()
    wide = days
    for name, code in MACRO_FEATURES.items():
        one = change.where(F.col("series") == code).select(
            "date", F.struct(F.col("change").alias("v")).alias(name))
        wide = as_of(wide, one, [], "pred_date", "date", [name])
    return wide.select("pred_date", *[
        F.coalesce(clip(F.col(f"{n}.v"), -1.0, 1.0), F.lit(0.0)).alias(n) for n in MACRO_FEATURES])


def attach_macro(samples: DataFrame, macro: DataFrame) -> DataFrame:
    """The date's macro features on every ticker of that date. The macro side has one row per
    day; Spark broadcasts it when its size allows."""
    return samples.join(macro, "pred_date", "left").na.fill(0.0, list(MACRO_FEATURES))
