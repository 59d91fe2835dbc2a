"""Prediction dates, lookback windows and targets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import asof, calendar, normalize, samples, technical
from tidemark.plans.base import Inputs
from tidemark.plans.q_features import TR_DATASET, _ewm_sql, _frame, _full
from tidemark.plans.registry import g, grid, gridded, gs, query

LO, HI, LOOKBACK, HORIZON, STRIDE = "1996-01-01", "2001-12-31", 12, 2, 4
DATES_SQL = f"""valid AS (SELECT date, dn, row_number() OVER (ORDER BY date) - 1 AS k FROM calendar
  WHERE date BETWEEN DATE '{LO}' AND DATE '{HI}' AND dn >= {LOOKBACK} AND dn <= n_dates - {HORIZON}),
dates AS (SELECT date AS pred_date, dn, k FROM valid WHERE k % {STRIDE} = 0 QUALIFY row_number() OVER (ORDER BY date DESC) > 3)"""


def dates(i: Inputs):
    return calendar.prediction_dates(i.calendar, LO, HI, LOOKBACK, HORIZON, STRIDE, 0, 3)


@query("smp1_prediction_dates", f"WITH {DATES_SQL} SELECT pred_date, dn, k FROM dates")
def _(i: Inputs):
    return dates(i)


@query("smp1_prediction_dates_compat", f"""SELECT date AS pred_date, dn FROM calendar WHERE date BETWEEN DATE '{LO}' AND DATE '{HI}' AND dn >= {LOOKBACK} AND dn <= n_dates - {HORIZON} + 1""")
def _(i: Inputs):
    return calendar.prediction_dates(i.calendar, LO, HI, LOOKBACK, HORIZON, compat_last_date=True).select("pred_date", "dn")


@query("smp2_rotation_folds", f"WITH {DATES_SQL} SELECT date AS pred_date, dn, k, (k % {STRIDE})::INT AS fold FROM valid")
def _(i: Inputs):
    return calendar.rotation_folds(i.calendar, LO, HI, LOOKBACK, HORIZON, STRIDE)


ANCHORS_SQL = f"""{DATES_SQL},
days AS (SELECT pred_date, (SELECT max(snapshot_date) FROM snapshots WHERE snapshot_date <= pred_date) AS snapshot_date FROM dates),
members AS (SELECT pred_date, ticker FROM days JOIN roster USING (snapshot_date)),
numbered AS (SELECT *, row_number() OVER w::INT AS rn, lead(adj_close, {HORIZON}) OVER w AS ahead,
  ln(lead(adj_close, 1) OVER w / adj_close) AS f1, ln(lead(adj_close, 2) OVER w / lead(adj_close, 1) OVER w) AS f2
  FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY date)),
anchors AS (SELECT m.pred_date, m.ticker, n.rn AS anchor_rn, n.ahead, n.adj_close, n.f1, n.f2 FROM members m ASOF JOIN numbered n ON m.ticker = n.ticker AND m.pred_date >= n.date),
labels AS (SELECT pred_date, ticker, anchor_rn, ln(ahead / adj_close) AS target, abs(f1 - f2) / 2 AS vol_target FROM anchors WHERE anchor_rn >= {LOOKBACK} AND ahead IS NOT NULL)"""


def _built(i: Inputs, mode: str = "ohlcv", **kw):
    return samples.build_samples(i.weekly, i.roster, dates(i), LOOKBACK, HORIZON, mode, **kw)


@query("smp3_lookback_windows", f"""WITH {ANCHORS_SQL} SELECT pred_date, ticker, lag::INT AS lag, {g('n.adj_close')} AS adj_close, n.volume AS volume
FROM labels l CROSS JOIN (SELECT unnest(range(0, {LOOKBACK})) AS lag) JOIN numbered n USING (ticker) WHERE n.rn = anchor_rn - lag""")
def _(i: Inputs):
    windows, _ = _built(i)
    return windows.select("pred_date", "ticker", "lag", grid("adj_close").alias("adj_close"), "volume")


@query("smp4_forward_return", f"WITH {ANCHORS_SQL} SELECT pred_date, ticker, {gs('target')} FROM labels")
def _(i: Inputs):
    return gridded(_built(i)[1], "pred_date ticker", "target")


@query("smp5_forward_volatility", f"WITH {ANCHORS_SQL} SELECT pred_date, ticker, {gs('vol_target')} FROM labels")
def _(i: Inputs):
    return gridded(_built(i)[1], "pred_date ticker", "vol_target")


WINDOW_SQL = f"""WITH {ANCHORS_SQL}, feats AS (SELECT ticker, rn, ln(adj_close) - ln(lag(adj_close, 5) OVER (PARTITION BY ticker ORDER BY rn)) AS ret_5d, ln(1 + volume) AS log_volume,
  (high - low) / close AS intraday_range, ln(adj_close) - ln(lag(adj_close, 20) OVER (PARTITION BY ticker ORDER BY rn)) AS ret_20d FROM numbered),
windows AS (SELECT pred_date, ticker, lag, f.* EXCLUDE (ticker, rn) FROM labels l CROSS JOIN (SELECT unnest(range(0, {LOOKBACK}))::INT AS lag) JOIN feats f USING (ticker) WHERE f.rn = anchor_rn - lag)"""


# all indicators of the window's rows; the recursive ones step by row number
WEEKS = """weeks0 AS (SELECT *, row_number() OVER w - 1 AS rn, lag(adj_close) OVER w AS before, lag(close) OVER w AS pc FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY date)),
weeks AS (SELECT *, adj_close - before AS delta, coalesce(pc, close) AS pc0, ln(adj_close) AS x, coalesce(ln(adj_close) - ln(before), 0) AS r1 FROM weeks0)"""
SMOOTHED = {"up": ("greatest(coalesce(s.delta, 0), 0)", 1 / 14), "down": ("greatest(-coalesce(s.delta, 0), 0)", 1 / 14), "atr": (TR_DATASET, 1 / 14),
            "fast": ("s.adj_close", 2 / 13), "slow": ("s.adj_close", 2 / 27)}
INDICATOR_SQL = f"""WITH RECURSIVE {ANCHORS_SQL}, {WEEKS}, {_ewm_sql("e", "weeks", SMOOTHED, 0)}, lines AS (SELECT ticker, rn, fast - slow AS macd FROM e), {_ewm_sql("sig", "lines", {"sg": ("s.macd", 0.2)}, 0)},
feats AS (SELECT ticker, rn + 1 AS rn, x - lag(x, 5) OVER w AS ret_5d, x - lag(x, 20) OVER w AS ret_20d, CASE WHEN rn >= 4 THEN stddev_pop(r1) OVER {_frame(5)} END AS vol_5d,
  CASE WHEN rn >= 19 THEN stddev_pop(r1) OVER {_frame(20)} END AS vol_20d, CASE WHEN rn >= 14 THEN 100 - 100 / (1 + up / greatest(down, 1e-8)) END AS rsi_14, macd, sg AS macd_signal, macd - sg AS macd_hist,
  {_full(20, 'adj_close', 'stddev_pop(adj_close)')} / {_full(20, 'adj_close', 'avg(adj_close)')} * 4 AS bbw_20, CASE WHEN rn >= 14 THEN atr END AS atr_14, ln(1 + volume) AS log_volume,
  volume / greatest({_full(20, 'volume', 'avg(volume)')}, 1e-8) AS rel_volume_20, (high - low) / close AS intraday_range, (open - pc0) / pc0 AS gap
  FROM weeks JOIN e USING (ticker, rn) JOIN lines USING (ticker, rn) JOIN sig USING (ticker, rn) WINDOW w AS (PARTITION BY ticker ORDER BY rn)),
windows AS (SELECT pred_date, ticker, lag, f.* EXCLUDE (ticker, rn) FROM labels l CROSS JOIN (SELECT unnest(range(0, {LOOKBACK}))::INT AS lag) JOIN feats f USING (ticker) WHERE f.rn = anchor_rn - lag)"""
INDICATORS = " ".join(n for n in technical.feature_names("dataset") if n != "rsi_14")


@query("smp6_technical_mode", f"{INDICATOR_SQL} SELECT pred_date, ticker, lag, {gs(INDICATORS)}, {gs('rsi_14', 3)} FROM windows")
def _(i: Inputs):
    rows = _built(i, "technical")[0]
    return rows.select("pred_date", "ticker", "lag", *[grid(c).alias(c) for c in INDICATORS.split()], grid("rsi_14", 3).alias("rsi_14"))


def relative_price(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"to_high": pdf["adj_close"] / pdf["adj_close"].cummax()})


@query("smp6_custom_mode", f"""WITH {ANCHORS_SQL}, feats AS (SELECT ticker, rn, adj_close / max(adj_close) OVER (PARTITION BY ticker ORDER BY rn) AS to_high FROM numbered)
SELECT pred_date, ticker, lag::INT AS lag, {gs('to_high')} FROM labels CROSS JOIN (SELECT unnest(range(0, {LOOKBACK})) AS lag) JOIN feats f USING (ticker) WHERE f.rn = anchor_rn - lag""")
def _(i: Inputs):
    return gridded(_built(i, "custom", feature_fn=relative_price, fn_columns=["to_high"])[0], "pred_date ticker lag", "to_high")


@query("smp7_padded_universe", f"WITH {ANCHORS_SQL} SELECT pred_date, ticker, target IS NOT NULL AS valid, {g('coalesce(target, 0)')} AS target FROM members LEFT JOIN labels USING (pred_date, ticker)")
def _(i: Inputs):
    out = samples.padded_universe(_built(i)[1], dates(i), i.roster)
    return gridded(out, "pred_date ticker valid", "target")


@query("smp9_short_window", f"{WINDOW_SQL} SELECT pred_date, ticker, lag, {gs('ret_5d')} FROM windows WHERE lag < 5")
def _(i: Inputs):
    return gridded(samples.short_window(_built(i, "technical")[0], 5), "pred_date ticker lag", "ret_5d")


@query("prj4_fast_slow_split", f"""{WINDOW_SQL} SELECT pred_date, ticker, count(*) AS n_fast, count_if(lag = 0) AS n_slow, {g('max(log_volume)')} AS top_volume, {g('max(ret_20d) FILTER (lag = 0)')} AS ret_20d FROM windows GROUP BY 1, 2""")
def _(i: Inputs):
    fast, slow = technical.split_fast_slow(_built(i, "technical")[0])
    a = fast.groupBy("pred_date", "ticker").agg(F.count(F.lit(1)).alias("n_fast"), F.max("log_volume").alias("top_volume"))
    b = slow.groupBy("pred_date", "ticker").agg(F.count(F.lit(1)).alias("n_slow"), F.max("ret_20d").alias("ret_20d"))
    return gridded(a.join(b, ["pred_date", "ticker"]), "pred_date ticker n_fast n_slow", "top_volume ret_20d")


@query("nrm6_window_standardise", f"""{WINDOW_SQL}, z AS (SELECT *, avg(log_volume) OVER d AS m, stddev_pop(log_volume) OVER d AS sd, count(*) OVER d AS n FROM windows WINDOW d AS (PARTITION BY pred_date, lag))
SELECT pred_date, ticker, lag, {g('CASE WHEN n >= 5 THEN (log_volume - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END ELSE log_volume END')} AS log_volume FROM z""")
def _(i: Inputs):
    out = normalize.cross_section_standardise(_built(i, "technical")[0], ["log_volume"])
    return gridded(out, "pred_date ticker lag", "log_volume")


@query("u1_feature_function", f"SELECT ticker, date, {g('adj_close / max(adj_close) OVER (PARTITION BY ticker ORDER BY date)')} AS to_high FROM daily")
def _(i: Inputs):
    return gridded(samples.apply_feature_fn(i.daily, relative_price, ["to_high"]), "ticker date", "to_high")


def blend(pdf: pd.DataFrame) -> pd.Series:
    return 0.5 * pdf["score"] - pdf["volatility"]


@query("u2_scorer_function", f"SELECT pred_date, ticker, {g('0.5::DOUBLE * score - volatility')} AS score FROM predictions WHERE score IS NOT NULL")
def _(i: Inputs):
    rows = i.predictions.where("score is not null").select("pred_date", "ticker", "score", "volatility")
    return gridded(samples.apply_scorer(rows, blend), "pred_date ticker", "score")


@query("u3_universe_table", f"""WITH days AS (SELECT pred_date, ticker, score, (SELECT max(snapshot_date) FROM snapshots WHERE snapshot_date <= pred_date) AS snapshot_date FROM predictions)
SELECT pred_date, count(*) AS n, {g('avg(score)')} AS mean_score FROM days SEMI JOIN roster USING (snapshot_date, ticker) GROUP BY 1""")
def _(i: Inputs):
    kept = asof.keep_members(i.predictions, i.roster, "pred_date")
    return gridded(kept.groupBy("pred_date").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "pred_date n", "mean_score")
