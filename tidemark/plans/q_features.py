"""Technical, fundamental, sentiment and normalised features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import add_ewm, span
from tidemark.operators import engine, fundamental, normalize, sentiment, technical
from tidemark.operators.fundamental import METRICS
from tidemark.plans.base import Inputs, _case, _mapped, per_supplier
from tidemark.plans.q_pit import FUND_DAILY
from tidemark.plans.registry import g, grid, gridded, gs, query

# The recursions run as recursive SQL, one step per row number.
NUMBERED = """numbered AS (SELECT *, row_number() OVER w - 1 AS rn, lag(adj_close) OVER w AS before, lag(close) OVER w AS pc
  FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)),
moves AS (SELECT *, adj_close - before AS delta, coalesce(pc, close) AS pc0 FROM numbered)"""


def _ewm_sql(name: str, source: str, columns: dict[str, tuple[str, float]], first: int) -> str:
    start = ", ".join(f"{x} AS {c}" for c, (x, _) in columns.items())
    step = ", ".join(f"{a!r}::DOUBLE * {x} + (1 - {a!r}::DOUBLE) * e.{c}" for c, (x, a) in columns.items())
    return f"""{name} AS (SELECT ticker, rn, {start} FROM {source} s WHERE rn = {first}
  UNION ALL SELECT s.ticker, s.rn, {step} FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"""


def _rec(head: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((head, *parts))


TR_ENGINE = "greatest(s.high - s.low, abs(s.high - s.pc), abs(s.low - s.pc))"
TR_DATASET = "greatest(s.high - s.low, abs(s.high - s.pc0), abs(s.low - s.pc0))"
W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _tech(i: Inputs, variant: str, columns: str, digits: int = 4):
    return gridded(technical.technical_features(i.daily, variant), "ticker date", columns, digits)


def _frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} >= {n} THEN {value} OVER {_frame(n)} END"


R1 = f"r AS (SELECT *, ln(adj_close) AS x, ln(adj_close) - lag(ln(adj_close)) OVER w AS r1, row_number() OVER w AS k FROM daily {W})"


@query("tec1_log_returns", f"""WITH p AS (SELECT ticker, date, ln(adj_close / lag(adj_close) OVER w) AS ret_1d, ln(adj_close / lag(adj_close, 5) OVER w) AS ret_5d,
  ln(adj_close / lag(adj_close, 20) OVER w) AS ret_20d FROM daily {W}) SELECT ticker, date, {gs('ret_1d ret_5d ret_20d')} FROM p""")
def _(i: Inputs):
    return _tech(i, "engine", "ret_1d ret_5d ret_20d")


@query("tec1_log_returns_dataset", f"""WITH p AS (SELECT ticker, date, x - lag(x, 5) OVER w AS ret_5d, x - lag(x, 20) OVER w AS ret_20d
  FROM (SELECT ticker, date, ln(adj_close) AS x FROM daily) {W}) SELECT ticker, date, {gs('ret_5d ret_20d')} FROM p""")
def _(i: Inputs):
    return _tech(i, "dataset", "ret_5d ret_20d")


@query("tec2_volatility", f"""WITH {R1}, v AS (SELECT ticker, date, {', '.join(f"{_full(n, 'r1', 'stddev_samp(r1)')} AS vol_{n}d" for n in (5, 20, 60))} FROM r)
SELECT ticker, date, {gs('vol_5d vol_20d vol_60d')} FROM v""")
def _(i: Inputs):
    return _tech(i, "engine", "vol_5d vol_20d vol_60d")


@query("tec2_volatility_dataset", f"""WITH {R1}, z AS (SELECT ticker, date, k, coalesce(r1, 0) AS r1 FROM r),
v AS (SELECT ticker, date, {', '.join(f"CASE WHEN k >= {n} THEN stddev_pop(r1) OVER {_frame(n)} END AS vol_{n}d" for n in (5, 20))} FROM z)
SELECT ticker, date, {gs('vol_5d vol_20d')} FROM v""")
def _(i: Inputs):
    return _tech(i, "dataset", "vol_5d vol_20d")


@query("tec3_rsi", _rec(NUMBERED, _ewm_sql("e", "moves", {"up": ("greatest(s.delta, 0)", 1 / 14), "down": ("greatest(-s.delta, 0)", 1 / 14)}, 1)) + f"""
SELECT m.ticker, m.date, {g('CASE WHEN m.rn >= 14 AND down > 0 THEN 100 - 100 / (1 + up / down) END', 3)} AS rsi_14 FROM moves m LEFT JOIN e USING (ticker, rn)""")
def _(i: Inputs):
    return _tech(i, "engine", "rsi_14", 3)


@query("tec3_rsi_dataset", _rec(NUMBERED, _ewm_sql("e", "moves", {"up": ("greatest(coalesce(s.delta, 0), 0)", 1 / 14), "down": ("greatest(-coalesce(s.delta, 0), 0)", 1 / 14)}, 0)) + f"""
SELECT m.ticker, m.date, {g('CASE WHEN m.rn >= 14 THEN 100 - 100 / (1 + up / greatest(down, 1e-8)) END', 3)} AS rsi_14 FROM moves m LEFT JOIN e USING (ticker, rn)""")
def _(i: Inputs):
    return _tech(i, "dataset", "rsi_14", 3)


@query("tec4_ewm", _rec(NUMBERED, _ewm_sql("e", "moves", {"slow": ("s.close", 2 / 27), "quick": ("s.close", 0.2)}, 0)) + f"""
SELECT m.ticker, m.date, {gs('slow quick', 3)} FROM moves m JOIN e USING (ticker, rn)""")
def _(i: Inputs):
    df = add_ewm(i.daily, {"slow": ("close", span(26), 0), "quick": ("close", 0.2, 0)})
    return gridded(df, "ticker date", "slow quick", 3)


@query("tec5_macd", _rec(NUMBERED, _ewm_sql("e", "moves", {"f": ("s.adj_close", 2 / 13), "s": ("s.adj_close", 2 / 27)}, 0).replace("e.s", "e.s"),
       "lines AS (SELECT ticker, rn, f - e.s AS macd FROM e)", _ewm_sql("sig", "lines", {"sg": ("s.macd", 0.2)}, 0).replace("e.sg", "e.sg")) + f"""
SELECT m.ticker, m.date, {g('macd')} AS macd, {g('sg')} AS macd_signal, {g('macd - sg')} AS macd_hist FROM moves m JOIN lines USING (ticker, rn) JOIN sig USING (ticker, rn)""")
def _(i: Inputs):
    return _tech(i, "engine", "macd macd_signal macd_hist")


@query("tec6_bollinger_width", f"""WITH v AS (SELECT ticker, date, {_full(20, 'adj_close', '4 * stddev_samp(adj_close)').replace('4 * stddev', 'stddev')} AS sd, {_full(20, 'adj_close', 'avg(adj_close)')} AS m FROM daily)
SELECT ticker, date, {g('4 * sd / m')} AS bbw_20 FROM v""")
def _(i: Inputs):
    return _tech(i, "engine", "bbw_20")


@query("tec6_bollinger_width_dataset", f"""WITH v AS (SELECT ticker, date, {_full(20, 'adj_close', 'stddev_pop(adj_close)')} AS sd, {_full(20, 'adj_close', 'avg(adj_close)')} AS m FROM daily)
SELECT ticker, date, {g('4 * sd / m')} AS bbw_20 FROM v""")
def _(i: Inputs):
    return _tech(i, "dataset", "bbw_20")


@query("tec7_true_range", _rec(NUMBERED, _ewm_sql("e", "moves", {"atr": (TR_ENGINE, 1 / 14)}, 0)) + f"""
SELECT m.ticker, m.date, {g('CASE WHEN m.rn >= 13 THEN atr END')} AS atr_14 FROM moves m JOIN e USING (ticker, rn)""")
def _(i: Inputs):
    return _tech(i, "engine", "atr_14")


@query("tec7_true_range_dataset", _rec(NUMBERED, _ewm_sql("e", "moves", {"atr": (TR_DATASET, 1 / 14)}, 0)) + f"""
SELECT m.ticker, m.date, {g('CASE WHEN m.rn >= 14 THEN atr END')} AS atr_14 FROM moves m JOIN e USING (ticker, rn)""")
def _(i: Inputs):
    return _tech(i, "dataset", "atr_14")


@query("tec8_on_balance_volume", f"""WITH {NUMBERED} SELECT ticker, date, {g('sum(coalesce(sign(close - pc), 0) * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS obv FROM moves""")
def _(i: Inputs):
    return _tech(i, "engine", "obv")


@query("tec9_relative_volume", f"WITH v AS (SELECT ticker, date, volume, {_full(20, 'volume', 'avg(volume)')} AS m FROM daily) SELECT ticker, date, {g('volume / m')} AS relvol_20 FROM v")
def _(i: Inputs):
    return _tech(i, "engine", "relvol_20")


@query("tec10_log_volume", f"SELECT ticker, date, {g('ln(1 + volume)')} AS log_volume FROM daily")
def _(i: Inputs):
    return _tech(i, "dataset", "log_volume")


@query("tec11_intraday_range", f"SELECT ticker, date, {g('(high - low) / close')} AS intraday_range FROM daily")
def _(i: Inputs):
    return _tech(i, "engine", "intraday_range")


@query("tec12_overnight_gap", f"WITH {NUMBERED} SELECT ticker, date, {g('(open - pc) / pc')} AS gap FROM moves")
def _(i: Inputs):
    return _tech(i, "engine", "gap")


@query("tec12_overnight_gap_dataset", f"WITH {NUMBERED} SELECT ticker, date, {g('(open - pc0) / pc0')} AS gap FROM moves")
def _(i: Inputs):
    return _tech(i, "dataset", "gap")


@query("tec13_rolling_primitives", f"""WITH v AS (SELECT ticker, date, {_full(10, 'high', 'avg(high)')} AS mean_10, {_full(10, 'high', 'stddev_samp(high)')} AS std_10,
  high - lag(high, 3) OVER w AS diff_3 FROM daily {W}) SELECT ticker, date, {gs('mean_10 std_10 diff_3')} FROM v""")
def _(i: Inputs):
    df = i.daily.select("ticker", "date", technical.rolling_mean(F.col("high"), 10).alias("mean_10"),
                        technical.rolling_std(F.col("high"), 10).alias("std_10"), technical.lag_diff(F.col("high"), 3).alias("diff_3"))
    return gridded(df, "ticker date", "mean_10 std_10 diff_3")


@query("tec14_configured_indicators", f"""WITH v AS (SELECT ticker, date, ln(adj_close / lag(adj_close, 2) OVER w) AS ret_2d, {_full(7, 'volume', 'avg(volume)')} AS m, volume FROM daily {W})
SELECT ticker, date, {g('ret_2d')} AS ret_2d, {g('volume / m')} AS relvol_7, 10 AS n_features FROM v""")
def _(i: Inputs):
    config = {"indicators": {"log_returns": {"periods": [2]}, "relative_volume": {"window": 7}, "obv": {"enabled": False}}}
    names = technical.feature_names("engine", config)
    df = technical.technical_features(i.daily, "engine", config)
    return gridded(df, "ticker date", "ret_2d relvol_7").withColumn("n_features", F.lit(len(names)))


# -- fundamentals -----------------------------------------------------------------------------

RATIO_SQL = f"""WITH {FUND_DAILY},
caps AS (SELECT *, CASE WHEN count(capex) OVER (PARTITION BY ticker) = 0 THEN 0 ELSE capex END AS cx FROM fund_daily),
ratios AS (SELECT ticker, date, ln(price * shares_outstanding) AS log_market_cap, price / nullif(net_income / shares_outstanding, 0) AS pe,
  price / (stockholders_equity / shares_outstanding) AS pb, total_debt / stockholders_equity AS de, net_income / stockholders_equity AS roe,
  (operating_cashflow - cx) / shares_outstanding / price AS fcf_yield, abs(dividends_paid) / shares_outstanding / price AS div_yield,
  total_revenue / back4 - 1 AS rev_growth_yoy, total_revenue / lag(total_revenue, 4) OVER w - 1 AS daily_growth FROM caps {W})"""
FUNS = "log_market_cap pe pb de roe"


def _ratios(i: Inputs, **kw):
    return fundamental.fundamental_ratios(fundamental.daily_fundamentals(i.fundamentals, i.weekly), **kw)


@query("fun1_valuation_ratios", f"{RATIO_SQL} SELECT ticker, date, {gs(FUNS)} FROM ratios")
def _(i: Inputs):
    return gridded(_ratios(i), "ticker date", FUNS)


@query("fun2_cash_flow_yield", f"{RATIO_SQL} SELECT ticker, date, {gs('fcf_yield')} FROM ratios")
def _(i: Inputs):
    return gridded(_ratios(i), "ticker date", "fcf_yield")


@query("fun3_dividend_yield", f"{RATIO_SQL} SELECT ticker, date, {gs('div_yield')} FROM ratios")
def _(i: Inputs):
    return gridded(_ratios(i), "ticker date", "div_yield")


@query("fun4_revenue_growth", f"{RATIO_SQL} SELECT ticker, date, {gs('rev_growth_yoy')} FROM ratios")
def _(i: Inputs):
    return gridded(_ratios(i), "ticker date", "rev_growth_yoy")


@query("fun4_revenue_growth_compat", f"{RATIO_SQL} SELECT ticker, date, {g('daily_growth')} AS rev_growth_yoy FROM ratios")
def _(i: Inputs):
    return gridded(_ratios(i, compat_growth=True), "ticker date", "rev_growth_yoy")


NOT_ASIA = "CASE WHEN sector = 'ASIA' THEN NULL ELSE pe END"


@query("fun5_sector_skip", f"{RATIO_SQL} SELECT ticker, date, {g(NOT_ASIA)} AS pe, {g('pb')} AS pb FROM ratios JOIN sectors USING (ticker)")
def _(i: Inputs):
    return gridded(_ratios(i, sectors=i.sectors, skip={"ASIA": ["pe"]}), "ticker date", "pe pb")


@query("fun6_cross_section_zscore", f"""WITH s AS (SELECT pred_date, ticker, score, volatility, avg(score) OVER d AS m, stddev_samp(score) OVER d AS sd, avg(volatility) OVER d AS m2, stddev_samp(volatility) OVER d AS sd2
  FROM predictions WINDOW d AS (PARTITION BY pred_date))
SELECT pred_date AS date, ticker, {g('(score - m) / nullif(sd, 0)')} AS score, {g('(volatility - m2) / nullif(sd2, 0)')} AS volatility FROM s""")
def _(i: Inputs):
    df = i.predictions.select(F.col("pred_date").alias("date"), "ticker", "score", "volatility")
    return gridded(fundamental.cross_section_zscore(df, ["score", "volatility"]), "date ticker", "score volatility")


# -- sentiment --------------------------------------------------------------------------------

SENT_SQL = f"""WITH weighted AS (SELECT *, CASE source WHEN 'finviz' THEN 0.4::DOUBLE WHEN 'stocktwits' THEN 0.3::DOUBLE WHEN 'reddit' THEN 0.3::DOUBLE ELSE 0 END AS wt FROM sentiment),
sent_days AS (SELECT ticker, date, sum(score * wt) / nullif(sum(wt), 0) AS sent_composite,
  abs(avg(score) FILTER (source = 'finviz') - avg(score) FILTER (source IN ('stocktwits', 'reddit'))) AS sent_divergence, sum(volume)::DOUBLE AS sent_volume FROM weighted GROUP BY 1, 2),
full_days AS (SELECT ticker, date, coalesce(sent_composite, 0) AS sent_composite, coalesce(sent_divergence, 0) AS sent_divergence, coalesce(sent_volume, 0) AS sent_volume
  FROM sentiment_spine LEFT JOIN sent_days USING (ticker, date)),
sent_feats AS (SELECT ticker, date, sent_composite, coalesce(sent_composite - lag(sent_composite, 5) OVER w, 0) AS sent_momentum_5d, sent_divergence,
  coalesce(sent_volume / nullif(avg(sent_volume) OVER {_frame(20)}, 0), 1) AS sent_mention_spike FROM full_days {W})"""


@query("sen1_weighted_composite", f"{SENT_SQL} SELECT ticker, date, {gs('sent_composite')} FROM sent_days")
def _(i: Inputs):
    return gridded(sentiment.daily_sentiment(i.sentiment), "ticker date", "sent_composite")


@query("sen2_divergence", f"{SENT_SQL} SELECT ticker, date, {gs('sent_divergence')} FROM sent_days")
def _(i: Inputs):
    return gridded(sentiment.daily_sentiment(i.sentiment), "ticker date", "sent_divergence")


@query("sen3_daily_spine", f"{SENT_SQL} SELECT ticker, date, {gs('sent_composite sent_divergence sent_volume')} FROM full_days")
def _(i: Inputs):
    return gridded(sentiment.on_spine(sentiment.daily_sentiment(i.sentiment), i.sentiment_spine), "ticker date", "sent_composite sent_divergence sent_volume")


@query("sen4_momentum", f"{SENT_SQL} SELECT ticker, date, {gs('sent_momentum_5d')} FROM sent_feats")
def _(i: Inputs):
    return gridded(sentiment.sentiment_features(i.sentiment, i.sentiment_spine), "ticker date", "sent_momentum_5d")


@query("sen5_mention_spike", f"{SENT_SQL} SELECT ticker, date, {gs('sent_mention_spike')} FROM sent_feats")
def _(i: Inputs):
    return gridded(sentiment.sentiment_features(i.sentiment, i.sentiment_spine), "ticker date", "sent_mention_spike")


@query("sen6_empty_coverage", "SELECT ticker, date, 0.0::DOUBLE AS sent_composite, 0.0::DOUBLE AS sent_momentum_5d, 0.0::DOUBLE AS sent_divergence, 1.0::DOUBLE AS sent_mention_spike FROM weekly")
def _(i: Inputs):
    return sentiment.sentiment_features(i.sentiment, i.weekly).select("ticker", "date", "sent_composite", "sent_momentum_5d", "sent_divergence", "sent_mention_spike")


@query("sen8_concat_sources", "SELECT ticker, date, count(*) AS n, sum(volume)::BIGINT AS volume FROM sentiment GROUP BY 1, 2")
def _(i: Inputs):
    parts = [i.sentiment.where(F.col("source") == s) for s in ("finviz", "stocktwits", "reddit", "error", "signup")]
    return sentiment.concat_sources(parts).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


# -- normalisation ------------------------------------------------------------------------------

NORM_SQL = """WITH f AS (SELECT pred_date AS date, ticker, score, volatility FROM predictions),
z AS (SELECT date, ticker,
  CASE WHEN count(score) OVER p >= 10 THEN (score - avg(score) OVER p) / nullif(stddev_samp(score) OVER p, 0) END AS score,
  CASE WHEN count(volatility) OVER p >= 10 THEN (volatility - avg(volatility) OVER p) / nullif(stddev_samp(volatility) OVER p, 0) END AS volatility
  FROM f WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
filled AS (SELECT date, ticker, coalesce(score, median(score) OVER d, 0) AS score, coalesce(volatility, median(volatility) OVER d, 0) AS volatility
  FROM z WINDOW d AS (PARTITION BY date)),
cut AS (SELECT date, ticker, greatest(-3, least(3, score)) AS score, greatest(-3, least(3, volatility)) AS volatility FROM filled)"""


def _panel(i: Inputs):
    return i.predictions.select("ticker", F.col("pred_date").alias("date"), "score", "volatility")


@query("nrm1_training_moments", f"""SELECT {g('avg(score)')} AS mean_score, {g('stddev_samp(score)')} AS std_score, {g('avg(volatility)')} AS mean_volatility, {g('stddev_samp(volatility)')} AS std_volatility
FROM predictions WHERE pred_date <= DATE '1998-12-31'""")
def _(i: Inputs):
    df = normalize.PanelNormalizer().training_moments(_panel(i), "1998-12-31")
    return df.select(*[grid(c).alias(c) for c in df.columns])


@query("nrm2_past_zscore", f"{NORM_SQL} SELECT ticker, date, {gs('score volatility')} FROM z")
def _(i: Inputs):
    return gridded(normalize.past_zscore(_panel(i), ["score", "volatility"], 40), "ticker date", "score volatility")


@query("nrm3_median_fill", f"{NORM_SQL} SELECT ticker, date, {gs('score volatility')} FROM filled")
def _(i: Inputs):
    z = normalize.past_zscore(_panel(i), ["score", "volatility"], 40)
    return gridded(normalize.fill_with_date_median(z, ["score", "volatility"]), "ticker date", "score volatility")


@query("nrm4_winsorise", f"{NORM_SQL} SELECT ticker, date, {g('coalesce(CASE WHEN score IS NOT NULL THEN greatest(-1, least(1, score)) END, 0)')} AS score FROM z")
def _(i: Inputs):
    z = normalize.past_zscore(_panel(i), ["score"], 40)
    return gridded(normalize.winsorise(z, ["score"], 1.0), "ticker date", "score")


@query("nrm5_normalizer", f"{NORM_SQL} SELECT ticker, date, {gs('score volatility')} FROM cut")
def _(i: Inputs):
    out = normalize.PanelNormalizer(window=40).fit_transform(_panel(i), "1998-12-31")
    return gridded(out, "ticker date", "score volatility")


@query("nrm6_cross_section_standardise", f"""WITH s AS (SELECT pred_date, ticker, coalesce(score, 0) AS score FROM predictions),
t AS (SELECT *, avg(score) OVER d AS m, stddev_pop(score) OVER d AS sd, count(*) OVER d AS n FROM s WINDOW d AS (PARTITION BY pred_date))
SELECT pred_date, ticker, {g('CASE WHEN n >= 5 THEN (score - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END ELSE score END')} AS score FROM t""")
def _(i: Inputs):
    out = normalize.cross_section_standardise(i.predictions.select("pred_date", "ticker", "score"), ["score"], ["pred_date"])
    return gridded(out, "pred_date ticker", "score")


# Messages about the panel's own tickers: line items by week, the return flag as source.
FLAGS = {"A": "finviz", "N": "stocktwits", "R": "reddit"}
LINE_SENTIMENT = f"""line_scores AS (SELECT 'S' || l_suppkey AS ticker, date_trunc('week', l_shipdate)::DATE AS date, {_case('l_returnflag', FLAGS, "'other'")} AS source, avg((l_quantity - 25) / 25) AS score, count(*) AS volume FROM lineitem GROUP BY 1, 2, 3),
line_days AS (SELECT ticker, date, sum(score * wt) / nullif(sum(wt), 0) AS composite, sum(volume) AS volume FROM (SELECT *, CASE source WHEN 'finviz' THEN 0.4 WHEN 'other' THEN 0 ELSE 0.3 END AS wt FROM line_scores) GROUP BY 1, 2),
line_full AS (SELECT ticker, date, coalesce(composite, 0) AS sent_composite, coalesce(d.volume, 0) AS v FROM weekly LEFT JOIN line_days d USING (ticker, date)),
line_feats AS (SELECT ticker, date, sent_composite, coalesce(sent_composite - lag(sent_composite, 5) OVER w, 0) AS sent_momentum_5d,
  coalesce(v / nullif(avg(v) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), 0), 1) AS sent_mention_spike FROM line_full WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
PANEL = "ret_5d intraday_range roe div_yield sent_composite sent_momentum_5d sent_mention_spike"


@query("fen1_feature_panel", f"""{RATIO_SQL}, {LINE_SENTIMENT}, t AS (SELECT ticker, date, ln(adj_close / lag(adj_close, 5) OVER w) AS ret_5d, (high - low) / close AS intraday_range FROM weekly {W})
SELECT ticker, date, {gs(PANEL)} FROM t JOIN ratios USING (ticker, date) JOIN line_feats USING (ticker, date)""")
def _(i: Inputs):
    used = i.table("lineitem").select("l_suppkey", F.trunc("l_shipdate", "week").alias("date"), _mapped("l_returnflag", FLAGS, F.lit("other")).alias("source"), "l_quantity")
    scores = per_supplier(used, lambda rows: rows.groupBy("l_suppkey", "date", "source").agg(F.avg((F.col("l_quantity") - 25) / 25).alias("score"), F.count(F.lit(1)).alias("volume")))
    scores = scores.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "date", "source", "score", "volume")
    panel = engine.feature_panel(i.weekly, {"sentiment": {"enabled": True}}, i.fundamentals, scores, sectors=i.sectors)
    return gridded(panel, "ticker date", PANEL)
