"""Scores of matured predictions and sliding baselines, against brute force, in any order of arrival."""

import datetime as dt
import json
import math
import os
import random

import numpy as np
import pytest

from tidemark.plans.registry import grid
from tidemark.streaming import intake, matured

PREDICTION = "ts timestamp, ticker string, score double, p0 double"
PRICE = "ts timestamp, ticker string, price double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return START + dt.timedelta(hours=hours)


def land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{name}.json"), "w") as f:
        f.writelines(json.dumps({**r, "ts": r["ts"].isoformat()}) + "\n" for r in rows)


def run(spark, base, slice_hours=24):
    p = spark.readStream.schema(PREDICTION).json(str(base / "p"))
    q = spark.readStream.schema(PRICE).json(str(base / "q"))
    intake.run_available(matured.score_matured(p, q, 2, "12 hours", 24, slice_hours), str(base / "out"), str(base / "state"))
    return spark.read.parquet(str(base / "out")).collect()


def expected(predictions, prices, clock):
    out = []
    for p in predictions:
        due = p["ts"] + dt.timedelta(days=2)
        hits = sorted((q["ts"], q["price"]) for q in prices if q["ticker"] == p["ticker"] and due <= q["ts"] < due + dt.timedelta(days=1))
        if hits and hits[0][0] < clock:
            out.append((p["ticker"], p["ts"], hits[0][0], p["score"], round(math.log(hits[0][1] / p["p0"]), 9), "scored"))
        elif not hits and due + dt.timedelta(days=1) <= clock:
            out.append((p["ticker"], p["ts"], None, p["score"], None, "no_price"))
    return sorted(out, key=str)


def plain(rows):
    def utc(t):
        return None if t is None else t.astimezone(dt.timezone.utc)

    return sorted(((r.ticker, utc(r.pred_ts), utc(r.price_ts), r.score, None if r.target is None else round(r.target, 9), r.status) for r in rows), key=str)


@pytest.mark.parametrize("slice_hours", [24, 5])
def test_each_prediction_is_scored_once_over_restarts(spark, tmp_path, slice_hours):
    r = random.Random(slice_hours)
    predictions = [{"ts": at(r.uniform(0, 200)), "ticker": r.choice("ABC"), "score": round(r.uniform(-1, 1), 3), "p0": round(r.uniform(5, 9), 2)} for _ in range(60)]
    # B has prices on few days, so some of its predictions find none
    prices = [{"ts": at(h), "ticker": t, "price": round(r.uniform(5, 9), 2)} for t in "ABC" for h in (r.uniform(0, 400) for _ in range(90)) if t != "B" or (h // 24) % 3 == 0]
    prices += [{"ts": prices[0]["ts"], "ticker": prices[0]["ticker"], "price": 1.0}]     # two prices at one moment
    predictions.sort(key=lambda p: p["ts"])
    prices.sort(key=lambda q: q["ts"])
    # arrival is up to 10 hours out of order, within the delay of 12
    pieces = 4
    order = sorted(range(len(prices)), key=lambda k: prices[k]["ts"] + dt.timedelta(hours=r.uniform(0, 10)))
    done = []
    for n in range(pieces):
        land(tmp_path / "p", n, predictions[n::pieces] if n == 0 else [])
        if n == 0:
            land(tmp_path / "p", "rest", [p for k, p in enumerate(predictions) if k % pieces])
        done += order[n * len(order) // pieces: (n + 1) * len(order) // pieces]
        land(tmp_path / "q", n, [prices[k] for k in order[n * len(order) // pieces: (n + 1) * len(order) // pieces]])
        got = run(spark, tmp_path, slice_hours)         # each run goes on from the checkpoint
        clock = max(prices[k]["ts"] for k in done) - dt.timedelta(hours=12)
        clock = clock.replace(microsecond=clock.microsecond // 1000 * 1000)
        assert plain(got) == expected(predictions, prices, clock)
    assert {g.status for g in got} == {"scored", "no_price"}


def test_late_and_early_prices(spark, tmp_path):
    predictions = [{"ts": at(0), "ticker": "A", "score": 1.0, "p0": 2.0}, {"ts": at(1), "ticker": None, "score": 1.0, "p0": 2.0}]
    land(tmp_path / "p", 0, predictions + [{"ts": at(300), "ticker": "Z", "score": 0.0, "p0": 1.0}])
    # a price before maturity never counts; one after it waits for those that may still come before it
    land(tmp_path / "q", 0, [{"ts": at(47), "ticker": "A", "price": 9.0}, {"ts": at(55), "ticker": "A", "price": 4.0}])
    assert run(spark, tmp_path) == []
    land(tmp_path / "q", 1, [{"ts": at(50), "ticker": "A", "price": 8.0}])
    assert run(spark, tmp_path) == []
    land(tmp_path / "q", 2, [{"ts": at(70), "ticker": "A", "price": 1.0}])
    (row,) = run(spark, tmp_path)
    assert (row.ticker, row.target, row.status) == ("A", pytest.approx(math.log(4)), "scored")
    # behind the watermark: too late to change anything; the nameless one ends without a price
    land(tmp_path / "q", 3, [{"ts": at(49), "ticker": "A", "price": 7.0}, {"ts": at(110), "ticker": "B", "price": 1.0}])
    rows = run(spark, tmp_path)
    assert sorted(str((r.ticker, r.status)) for r in rows) == ["('A', 'scored')", "(None, 'no_price')"]


def test_baseline_from_panes(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [{"ts": at(float(h)), "ticker": str(r.choice(["A", "B"])), "source": "s", "score": 0.0} for h in sorted(r.uniform(0, 24 * 12, 80))]
    for n in range(2):
        land(tmp_path / "in", n, rows[40 * n: 40 * n + 40])
        stream = spark.readStream.schema("ts timestamp, ticker string, source string, score double").json(str(tmp_path / "in"))
        intake.run_available(intake.sliding_baseline(stream, 4), str(tmp_path / "out"), str(tmp_path / "state"))
    clock = rows[-1]["ts"] - dt.timedelta(hours=1)
    want = {}
    for x in rows:
        for back in range(4):
            end = (x["ts"] + dt.timedelta(days=back + 1)).date()
            if dt.datetime.combine(end, dt.time(), dt.timezone.utc) <= clock:
                want[end, x["ticker"]] = want.get((end, x["ticker"]), 0) + 0.25
    got = {(g.date, g.ticker): g.daily_mean for g in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx(want)


def test_prices_of_zero_and_many_tickers(spark, tmp_path):
    """As floating point has it: no price of zero, no division by zero and no 0 / 0 is lost on the way."""
    predictions = [{"ts": at(1), "ticker": f"T{k}", "score": 0.5, "p0": p0} for k, p0 in enumerate((2.0, 0.0, 0.0, 4.0))]
    prices = [{"ts": at(50), "ticker": f"T{k}", "price": x} for k, x in enumerate((0.0, 3.0, 0.0))]
    prices.append({"ts": at(400), "ticker": "T0", "price": 1.0})
    land(tmp_path / "p", 0, predictions)
    land(tmp_path / "q", 0, prices)
    got = {r.ticker: (r.status, r.target) for r in run(spark, tmp_path, 24)}
    assert got.pop("T3") == ("no_price", None)
    assert {t: (s, str(x)) for t, (s, x) in got.items()} == {"T0": ("scored", "-inf"), "T1": ("scored", "inf"), "T2": ("scored", "nan")}


def test_grid_keeps_what_is_not_finite(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1e300,), (1.25,), (None,)], "x double")
    assert [str(r[0]) for r in rows.select(grid("x", 1)).collect()] == ["inf", "-inf", "nan", "1e+300", "1.3", "None"]
