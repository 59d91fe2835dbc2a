"""Small deterministic panels."""

import datetime as dt

import numpy as np
import pandas as pd


def business_days(start, n):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def random_walk(tickers, n, start="2020-01-02", seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    frames = []
    for t in tickers:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, n)))
        frame = pd.DataFrame({
            "ticker": t, "date": business_days(start, n), "open": close * (1 + rng.uniform(-0.005, 0.005, n)),
            "high": close * 1.01, "low": close * 0.99, "close": close, "adj_close": close,
            "volume": rng.integers(1_000_000, 10_000_000, n).astype(float), "dividends": 0.0, "stock_splits": 0.0})
        frames.append(frame[rng.uniform(size=n) >= missing] if missing else frame)
    return pd.concat(frames, ignore_index=True)


def day(text):
    return dt.date.fromisoformat(text)
