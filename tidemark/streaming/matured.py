"""One score per prediction, from a stream of prices, by event-time timers.

A prediction matures ``horizon`` after it was made and takes the first price of its ticker from then on,
within ``tolerance``. Predictions are keyed by (bucket of tickers, slice of time in which they mature); a price goes to
the slices whose predictions it can end, and a slice keeps each ticker's prices inside it and the first one after it.
A key holds what arrived for one slice and its share of the tickers, matched at once as arrays; ``buckets`` sets that share.

A prediction is decided when the watermark has passed its price, since no earlier one can still come, or
the end of its tolerance: then it is a dead letter, without a price. Until then a timer is set for the next moment
at which one of the slice can be decided. What arrives in which order, late but not behind the watermark, or
after a restart, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ``who`` is the place of the ticker among the names of the key
WAITING = np.dtype([("who", "<i8"), ("due", "<i8"), ("made", "<i8"), ("score", "<f8"), ("p0", "<f8")])
PRICES = np.dtype([("who", "<i8"), ("at", "<i8"), ("price", "<f8")])
HOUR = 3_600_000_000
SETTLED = "ticker string, made long, hit long, score double, target double, scored boolean, known boolean"


def _rows(frame: pd.DataFrame, names: dict[str, str], kind: np.dtype) -> np.ndarray:
    out = np.empty(len(frame), dtype=kind)
    for field, column in names.items():
        out[field] = frame[column].to_numpy()
    return out


def first_prices(waiting: np.ndarray, prices: np.ndarray, tolerance: int, start: int, width: int) -> np.ndarray:
    """Per waiting prediction the place of its price in the sorted prices, -1 without one; all times lie in ``width`` from ``start``."""
    at = np.searchsorted(prices["who"] * width + (prices["at"] - start), waiting["who"] * width + (waiting["due"] - start), side="left")
    inside = at < len(prices)
    hit, own = prices[at[inside]], waiting[inside]
    inside[inside] = (hit["who"] == own["who"]) & (hit["at"] < own["due"] + tolerance)
    return np.where(inside, at, -1)


def kept_prices(prices: np.ndarray, end: int) -> np.ndarray:
    """Sorted prices of each ticker up to the first one at or after ``end``; of equal times the lowest."""
    if not len(prices):
        return prices
    prices = prices[np.lexsort((prices["price"], prices["at"], prices["who"]))]
    same = prices["who"][1:] == prices["who"][:-1]
    prices = prices[np.r_[True, ~same | (prices["at"][1:] != prices["at"][:-1])]]
    same = prices["who"][1:] == prices["who"][:-1]
    return prices[(prices["at"] < end) | np.r_[True, ~same | (prices["at"][:-1] < end)]]


def score_matured(
    predictions: DataFrame, prices: DataFrame, horizon_days: int, delay: str = "2 days", tolerance_hours: int = 24, slice_hours: int = 24,
    buckets: int = 64,
) -> DataFrame:
    """(ticker, pred_ts, price_ts, score, target, status): one row per decided prediction.

    ``predictions``: ts, ticker, score, p0. ``prices``: ts, ticker, price. ``status`` is ``scored`` or
    ``no_price``. Rows without a time are left out; a prediction that comes when its tolerance
    has passed behind the watermark is late and dropped. ``target`` is as floating point has it where a price is zero;
    a ticker that is null meets no price.
    """
    horizon, tolerance, span = 24 * horizon_days * HOUR, tolerance_hours * HOUR, slice_hours * HOUR

    def slice_of(t) -> F.Column:
        return F.call_function("div", t, F.lit(span)) - F.when(F.pmod(t, F.lit(span)) > t % span, F.lit(1)).otherwise(F.lit(0))

    p = predictions.where("ts is not null").withColumn("_t", F.unix_micros("ts") + horizon).select(
        # late is a prediction whose tolerance has passed
        F.timestamp_micros(F.col("_t") + tolerance).alias("at"), "ticker", slice_of(F.col("_t")).alias("slice"), F.lit(False).alias("is_price"),
        F.col("_t").alias("t"), F.unix_micros("ts").alias("made"), F.col("score").cast("double").alias("score"), F.col("p0").cast("double").alias("p0"))
    q = prices.where("ts is not null").withColumn("_t", F.unix_micros("ts")).select(
        F.col("ts").alias("at"), "ticker", F.explode(F.sequence(slice_of(F.col("_t") - tolerance), slice_of(F.col("_t")))).alias("slice"), F.lit(True).alias("is_price"),
        F.col("_t").alias("t"), F.lit(0).cast("long").alias("made"), F.lit(None).cast("double").alias("score"), F.col("price").cast("double").alias("p0"))
    # prices alone set the time, also while no prediction arrives
    rows = q.withWatermark("at", delay).unionByName(p).withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.lit(buckets)))

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        _, part = key
        end = (part + 1) * span
        waiting, known, names = np.empty(0, WAITING), np.empty(0, PRICES), []
        if state.exists:
            *held, names = state.get
            waiting, known = (np.frombuffer(b, kind) for b, kind in zip(held, (WAITING, PRICES), strict=True))
            names = list(names)
        if not state.hasTimedOut:
            place = {n: k for k, n in enumerate(names)}
            for frame in frames:
                frame = frame.assign(who=[place.setdefault(None if pd.isna(n) else n, len(place)) for n in frame["ticker"]])
                priced = frame["is_price"] & frame["ticker"].notna()
                waiting = np.r_[waiting, _rows(frame[~frame["is_price"]], {"who": "who", "due": "t", "made": "made", "score": "score", "p0": "p0"}, WAITING)]
                known = np.r_[known, _rows(frame[priced], {"who": "who", "at": "t", "price": "p0"}, PRICES)]
            names, known = list(place), kept_prices(known, end)
        clock = state.getCurrentWatermarkMs() * 1000
        at = first_prices(waiting, known, tolerance, end - span, span + tolerance)
        found = at >= 0
        hit = np.where(found, known["at"][at] if len(known) else 0, waiting["due"] + tolerance)
        done = np.where(found, hit < clock, hit <= clock)
        if done.any():
            made, yes = waiting[done], found[done]
            price = np.where(yes, known["price"][at[done]] if len(known) else np.nan, np.nan)
            with np.errstate(invalid="ignore", divide="ignore"):
                target = np.log(price / made["p0"])
            yield pd.DataFrame({
                "ticker": [names[k] for k in made["who"]], "made": made["made"], "hit": hit[done], "score": made["score"], "target": target,
                "scored": yes, "known": yes & ~np.isnan(price) & ~np.isnan(made["p0"])})
        # a slice can be asked for as long as the last of its predictions is not late
        expires = end + tolerance
        if clock >= expires and done.all():
            if state.exists:
                state.remove()
            return
        waiting, hit, found = waiting[~done], hit[~done], found[~done]
        state.update((waiting.tobytes(), known.tobytes(), names))
        # timers go off once the watermark is beyond them
        marks = np.where(found, hit // 1000, -(-hit // 1000) - 1)
        state.setTimeoutTimestamp(max(int(min([*marks.tolist(), -(-expires // 1000)])), clock // 1000 + 1 if clock >= expires else clock // 1000))

    out = rows.groupBy("bucket", "slice").applyInPandasWithState(
        settle, SETTLED, "waiting binary, prices binary, names array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    # on its way from pandas a number that is none becomes null
    target = F.when(F.col("known") & F.col("target").isNull(), F.lit(float("nan"))).otherwise(F.col("target"))
    return out.select(
        "ticker", F.timestamp_micros("made").alias("pred_ts"), F.when(F.col("scored"), F.timestamp_micros("hit")).alias("price_ts"),
        "score", target.alias("target"), F.when(F.col("scored"), "scored").otherwise("no_price").alias("status"))
