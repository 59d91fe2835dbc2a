"""Lookback windows and forward targets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import finite, log_ratio
from tidemark.operators.asof import sample_anchor
from tidemark.operators.spread import in_parts
from tidemark.operators.technical import feature_names, technical_features

def own_rows() -> Window:
    return Window.partitionBy("ticker").orderBy("date")
RAW_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]


def with_row_number(prices: DataFrame) -> DataFrame:
    return prices.withColumn("rn", F.row_number().over(own_rows()))


def forward_return(price: str, horizon: int):
    """ln(p[t+h] / p[t]) over own rows; null without a positive finite price at both ends."""
    now, then = F.col(price), F.lead(price, horizon).over(own_rows())
    return F.when(finite(now) & finite(then), log_ratio(then, now))


def forward_volatility(price: str, horizon: int):
    """Population deviation of the daily log returns in (t, t+h]; null when one is unknown or
    fewer than two exist. One-row returns are looked up per offset, which keeps one window."""
    ahead = [
        log_ratio(F.lead(price, k).over(own_rows()), F.lead(price, k - 1).over(own_rows()) if k > 1 else F.col(price))
        for k in range(1, horizon + 1)
    ]
    if horizon < 2:
        return F.lit(None).cast("double")
    n = F.lit(float(horizon))
    mean = sum(ahead[1:], ahead[0]) / n
    squares = [(r - mean) * (r - mean) for r in ahead]
    return F.sqrt(sum(squares[1:], squares[0]) / n)


def targets(prices: DataFrame, horizon: int, price: str = "adj_close") -> DataFrame:
    """(ticker, date, rn, target, vol_target)."""
    return prices.select(
        "ticker", "date", F.row_number().over(own_rows()).alias("rn"),
        forward_return(price, horizon).alias("target"),
        F.coalesce(forward_volatility(price, horizon), F.lit(0.0)).alias("vol_target"),
    )


def lookback_windows(anchors: DataFrame, features: DataFrame, columns: Sequence[str], lookback: int) -> DataFrame:
    """(pred_date, ticker, lag, columns): the ``lookback`` own rows ending at the anchor.

    Equi-join on (ticker, rn) of anchors exploded by lag; anchors without a full window drop.
    ``features`` carries ``rn``.
    """
    wanted = anchors.where(F.col("anchor_rn") >= lookback).select(
        "pred_date", "ticker", F.explode(F.sequence(F.lit(0), F.lit(lookback - 1))).alias("lag"), "anchor_rn",
    ).withColumn("rn", F.col("anchor_rn") - F.col("lag"))
    return wanted.join(features.select("ticker", "rn", *columns), ["ticker", "rn"]).select(
        "pred_date", "ticker", "lag", *columns)


def build_samples(
    prices: DataFrame, roster: DataFrame, dates: DataFrame, lookback: int, horizon: int,
    mode: str = "technical", feature_fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    fn_columns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Windows and labels of every member with a full window and an existing target.

    ``mode``: ``technical`` (dataset variant), ``ohlcv`` (raw columns) or ``custom``
    (``feature_fn`` on a ticker's whole history, see ``apply_feature_fn``).
    """
    prices = in_parts(prices, ["ticker"])      # all windows below are by ticker
    numbered = with_row_number(prices)
    if mode == "technical":
        feats, columns = technical_features(prices, "dataset"), feature_names("dataset")
        feats = with_row_number(feats)
    elif mode == "ohlcv":
        feats, columns = numbered, RAW_COLUMNS
    elif mode == "custom":
        feats = with_row_number(apply_feature_fn(prices, feature_fn, fn_columns))
        columns = list(fn_columns)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    labels = targets(prices, horizon)
    anchors = sample_anchor(dates, numbered, roster)
    labelled = anchors.join(
        labels.select("ticker", F.col("rn").alias("anchor_rn"), "target", "vol_target"), ["ticker", "anchor_rn"]
    ).where((F.col("anchor_rn") >= lookback) & F.col("target").isNotNull())
    windows = lookback_windows(labelled, feats, columns, lookback)
    return windows, labelled.select("pred_date", "ticker", "target", "vol_target")


def padded_universe(labels: DataFrame, dates: DataFrame, roster: DataFrame) -> DataFrame:
    """Every member of every prediction date with ``valid`` telling whether a sample exists."""
    from tidemark.operators.asof import members_on

    members = members_on(dates, roster, "pred_date").select("pred_date", "ticker")
    return members.join(labels, ["pred_date", "ticker"], "left").select(
        "pred_date", "ticker", F.col("target").isNotNull().alias("valid"),
        F.coalesce("target", F.lit(0.0)).alias("target"))


def short_window(samples: DataFrame, length: int = 20) -> DataFrame:
    """The most recent ``length`` lags of the same windows."""
    return samples.where(F.col("lag") < length)


def apply_feature_fn(prices: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str]) -> DataFrame:
    """User feature function on each ticker's rows in date order (one calendar at most per
    call). It returns one row per input row with the named columns; other shapes raise."""
    schema = T.StructType(
        [prices.schema["ticker"], prices.schema["date"]] + [T.StructField(c, T.DoubleType()) for c in columns])
    wanted = list(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out = fn(pdf)
        if len(out) != len(pdf) or [c for c in wanted if c not in out.columns]:
            raise ValueError(f"feature function returned {out.shape}, expected {len(pdf)} rows of {wanted}")
        keys = pdf[["ticker", "date"]].reset_index(drop=True)
        return pd.concat([keys, out[wanted].astype("float64").reset_index(drop=True)], axis=1)

    return prices.groupBy("ticker").applyInPandas(run, schema)


def apply_scorer(frame: DataFrame, fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """User scorer on Arrow batches of candidate rows: one score per row, other lengths raise.

    Batches cut a date's tickers anywhere, so a date of any size is scored in pieces; columns
    that describe the whole date are joined on before.
    """
    schema = T.StructType([frame.schema["pred_date"], frame.schema["ticker"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            scores = fn(pdf)
            if len(scores) != len(pdf):
                raise ValueError(f"scorer returned {len(scores)} scores for {len(pdf)} rows")
            yield pdf[["pred_date", "ticker"]].assign(score=pd.Series(scores).astype("float64").to_numpy())

    return frame.mapInPandas(run, schema)
