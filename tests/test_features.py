"""Exact values, invariants and leak checks of features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import business_days, day, random_walk
from tidemark.functions.ewm import add_ewm, block_rows
from tidemark.operators import calendar, clean, engine, fundamental, macro, normalize, sentiment, technical
from tidemark.operators.samples import apply_feature_fn, apply_scorer, build_samples, targets


@pytest.fixture(scope="module")
def prices(spark):
    pdf = random_walk(["A", "B", "C"], 90)
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("block", [None, 120, 7 * 10])
@pytest.mark.parametrize("first", [0, 1])
def test_ewm_equals_recursion(prices, block, first):
    df, pdf = prices
    alpha = 0.6 if block == 70 else 0.2       # blocks need 1e-20 decay
    out = add_ewm(df, {"y": ("close", alpha, first)}, block=block).toPandas().sort_values(["ticker", "date"])
    for t, d in out.groupby("ticker"):
        x, y = pdf[pdf.ticker == t].close.to_numpy(), None
        for k, v in enumerate(x):
            if k < first:
                assert np.isnan(d.y.iloc[k])
                continue
            y = v if y is None else alpha * v + (1 - alpha) * y
            assert d.y.iloc[k] == pytest.approx(y, rel=1e-12)


def test_ewm_block_choice():
    assert block_rows([0.2, 1 / 14]) > 2000
    with pytest.raises(ValueError):
        block_rows([0.9, 1e-4])


@pytest.mark.parametrize("variant", ["engine", "dataset"])
def test_features_do_not_look_ahead(prices, variant):
    df, _ = prices
    cut = business_days("2020-01-02", 90)[70]
    names = technical.feature_names(variant)
    whole = technical.technical_features(df, variant).where(F.col("date") <= F.lit(cut))
    short = technical.technical_features(df.where(F.col("date") <= F.lit(cut)), variant)
    a, b = (x.toPandas().sort_values(["ticker", "date"])[names].to_numpy(dtype=float) for x in (whole, short))
    assert np.allclose(a, b, equal_nan=True, rtol=1e-12)


def test_rsi_range_and_warm_up(prices):
    df, _ = prices
    out = technical.technical_features(df).toPandas().sort_values(["ticker", "date"])
    for _, d in out.groupby("ticker"):
        assert d.rsi_14.isna().sum() == 14 and d.rsi_14.dropna().between(0, 100).all()
        assert d.vol_20d.isna().sum() == 20 and d.atr_14.isna().sum() == 13
    assert (out.intraday_range > 0).all()


def test_missing_price_column_raises(prices):
    with pytest.raises(KeyError):
        technical.technical_features(prices[0].drop("adj_close"))


def test_spike_is_removed(spark):
    values = [100.0] * 5 + [210.0] + [100.0] * 4
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": business_days("2024-01-02", 10), "adj_close": values}))
    flagged = clean.flag_revert_spikes(df).orderBy("date").toPandas()
    assert list(np.flatnonzero(flagged.spike)) == [5]
    assert clean.remove_revert_spikes(df).count() == 9
    assert clean.flag_revert_spikes(df.limit(2)).where("spike").count() == 0


@pytest.mark.parametrize("dropped, added", [(range(50, 51), 1), (range(50, 52), 2), (range(50, 60), 0)])
def test_gap_fill(spark, dropped, added):
    pdf = random_walk(["A"], 90).drop(index=list(dropped))
    df = spark.createDataFrame(pdf)
    out = clean.fill_small_gaps(df).toPandas()
    assert out.filled.sum() == added and len(out) == len(pdf) + added
    full = spark.createDataFrame(pd.DataFrame({"date": business_days("2020-01-02", 90)}))
    by_calendar = clean.fill_small_gaps(df, calendar.trading_calendar(full)).toPandas()
    assert by_calendar.filled.sum() == added
    compat = clean.fill_small_gaps(df, compat_zero_volume=True).toPandas()
    assert (compat.volume == 0).all()
    assert (out[~out.filled].volume > 0).all()


def test_business_days_and_splits(spark):
    span = spark.createDataFrame([(day("2024-01-05"), day("2024-01-09"))], "start date, end date")
    assert [r.date.isoformat() for r in calendar.business_days(span).orderBy("date").collect()] == ["2024-01-05", "2024-01-08", "2024-01-09"]


def test_prediction_dates_rotate_without_overlap(spark):
    days = spark.createDataFrame(pd.DataFrame({"date": business_days("2024-01-01", 60)}))
    cal = calendar.trading_calendar(days)
    folds = [set(r.dn for r in calendar.prediction_dates(cal, "2024-01-01", "2024-12-31", 10, 5, 5, k).collect()) for k in range(5)]
    assert set.union(*folds) == set(range(10, 56)) and sum(map(len, folds)) == 46
    kept = [r.dn for r in calendar.prediction_dates(cal, "2024-01-01", "2024-12-31", 10, 5, 5, 0, purge=2).orderBy("dn").collect()]
    assert kept == [10, 15, 20, 25, 30, 35, 40, 45]


def test_targets_and_windows(spark, prices):
    df, pdf = prices
    roster = spark.createDataFrame([(day("2020-01-01"), "A"), (day("2020-01-01"), "B")], "snapshot_date date, ticker string")
    dates = calendar.prediction_dates(calendar.trading_calendar(df), "2020-01-01", "2020-12-31", 20, 5, 10)
    windows, labels = build_samples(df, roster, dates, 20, 5, "ohlcv")
    w = windows.toPandas()
    assert set(w.ticker) == {"A", "B"} and (w.groupby(["pred_date", "ticker"]).size() == 20).all()
    series = pdf[pdf.ticker == "A"].set_index("date").adj_close
    last = w[(w.ticker == "A") & (w.lag == 0)].set_index("pred_date").adj_close
    assert all(last[d] == series[d] for d in last.index)
    for r in labels.where("ticker = 'A'").collect():
        k = list(series.index).index(r.pred_date)
        ahead = np.diff(np.log(series.to_numpy()[k:k + 6]))
        assert r.target == pytest.approx(ahead.sum()) and r.vol_target == pytest.approx(ahead.std())
    assert targets(df, 5).where("target is null").count() == 15


def test_user_functions_are_checked(spark, prices):
    df, _ = prices
    out = apply_feature_fn(df, lambda p: pd.DataFrame({"x": p["close"] * 2}), ["x"])
    assert out.count() == df.count()
    with pytest.raises(Exception, match="expected"):
        apply_feature_fn(df, lambda p: pd.DataFrame({"x": p["close"].head(3)}), ["x"]).count()
    rows = df.select(F.col("date").alias("pred_date"), "ticker", "close")
    with pytest.raises(Exception, match="scores"):
        apply_scorer(rows, lambda p: pd.Series([1.0])).count()


def _fundamentals(spark):
    rows = []
    for k, d in enumerate(["2019-12-31", "2020-03-31", "2020-06-30", "2020-09-30"]):
        for m, v in (("total_revenue", 1e9 + k * 1e8), ("net_income", 1e8), ("total_debt", 5e8), ("stockholders_equity", 2e9), ("shares_outstanding", 1e7)):
            rows.append(("A", day(d), m, v))
    return spark.createDataFrame(rows, "ticker string, date date, metric string, value double")


def test_fundamentals_wait_for_the_report(spark, prices):
    df = prices[0].where("ticker = 'A'")
    daily = fundamental.daily_fundamentals(_fundamentals(spark), df)
    first = daily.where("total_debt is not null").agg(F.min("date")).first()[0]
    assert first == day("2020-02-14")     # 45 days after year end
    out = fundamental.fundamental_ratios(daily).where("roe is not null").toPandas()
    assert out.roe.iloc[0] == pytest.approx(0.05) and out.fcf_yield.isna().all()
    skipped = fundamental.fundamental_ratios(daily, spark.createDataFrame([("A", "Banks")], "ticker string, sector string"), {"Banks": ["pe"]})
    assert skipped.where("pe is not null").count() == 0 and skipped.where("pb is not null").count() > 0


def test_sentiment_weights_and_default(spark):
    rows = [("A", day("2024-01-02"), "finviz", 0.4, 5), ("A", day("2024-01-02"), "stocktwits", -0.2, 10)]
    long = spark.createDataFrame(rows, "ticker string, date date, source string, score double, volume bigint")
    one = sentiment.daily_sentiment(long, {"finviz": 0.5, "stocktwits": 0.5, "reddit": 0.0}).first()
    assert one.sent_composite == pytest.approx(0.1) and one.sent_divergence == pytest.approx(0.6) and one.sent_volume == 15
    spine = spark.createDataFrame([("Z", day("2024-01-02"))], "ticker string, date date")
    empty = sentiment.sentiment_features(long, spine).first()
    assert tuple(empty)[2:] == (0.0, 0.0, 0.0, 1.0)


def test_macro_clips_and_defaults(spark):
    days = business_days("2024-01-01", 8)
    rows = [("vix", d, 10.0 if k < 6 else 100.0) for k, d in enumerate(days)] + [("tnx", d, 4.0 + k) for k, d in enumerate(days[:3])]
    series = spark.createDataFrame(rows, "series string, date date, close double")
    dates = spark.createDataFrame([(days[4],), (days[7],), (day("2024-02-01"),)], "pred_date date")
    out = {r.pred_date: r for r in macro.macro_features(series, dates).collect()}
    assert out[days[4]].vix_change_5d == 0.0 and out[days[7]].vix_change_5d == 1.0 and out[day("2024-02-01")].vix_change_5d == 1.0
    assert out[days[7]].tnx_change_5d == 0.0 and out[days[7]].spy_return_5d == 0.0


def test_normalizer(spark, prices, tmp_path):
    df, _ = prices
    panel = technical.technical_features(df).select("ticker", "date", "ret_1d", "vol_5d")
    with pytest.raises(RuntimeError):
        normalize.PanelNormalizer().transform(panel)
    fitted = normalize.PanelNormalizer(window=40).fit(panel, "2020-03-01")
    fitted.save(str(tmp_path / "state.json"))
    again = normalize.PanelNormalizer.load(str(tmp_path / "state.json"))
    assert again == fitted
    a, b = (n.transform(panel).toPandas().sort_values(["ticker", "date"]) for n in (fitted, again))
    assert np.allclose(a.ret_1d, b.ret_1d) and a.ret_1d.abs().max() <= 3 and not a.isna().any().any()
    cut = business_days("2020-01-02", 90)[60]
    c = fitted.transform(panel.where(F.col("date") <= F.lit(cut))).toPandas().sort_values(["ticker", "date"])
    assert np.allclose(c.ret_1d, a[a.date <= cut].ret_1d)


def test_median_fill_uses_the_date(spark):
    df = spark.createDataFrame([("A", day("2024-01-01"), 1.0), ("B", day("2024-01-01"), 3.0), ("C", day("2024-01-01"), None), ("A", day("2024-01-02"), None)],
                               "ticker string, date date, x double")
    out = {(r.ticker, r.date.day): r.x for r in normalize.fill_with_date_median(df, ["x"]).collect()}
    assert out == {("A", 1): 1.0, ("B", 1): 3.0, ("C", 1): 2.0, ("A", 2): 0.0}


def test_panel_merges_groups(spark, prices):
    df, _ = prices
    panel = engine.feature_panel(df, {"sentiment": {"enabled": False}}, _fundamentals(spark))
    assert {"ret_1d", "roe"} <= set(panel.columns) and panel.count() == df.count()
    with pytest.raises(ValueError):
        engine.feature_panel(df, {"technical": {"enabled": False}})


@pytest.mark.parametrize("with_calendar", [True, False])
def test_cleaning_report_counts_what_the_steps_do(spark, with_calendar):
    import numpy as np

    from tidemark.operators import calendar as cal
    from tidemark.operators import clean

    r = np.random.default_rng(12)
    rows = []
    for t in ("A", "B", "C"):
        for k in range(90):
            price = float(np.exp(r.normal(0, 0.3))) if r.uniform() < 0.8 else None
            d = pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(k * (1 if t != "C" else 1.6)))
            rows += [(t, d.date(), price, float("nan") if r.uniform() < 0.05 else price, 1.0, n) for n in range(int(r.integers(0, 3)))]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, adj_close double, volume double, n int")
    calendar = cal.trading_calendar(df.where("dayofmonth(date) <> 9")) if with_calendar else None
    deduped = clean.drop_duplicates(df, ["n"])
    priced = clean.drop_missing_prices(deduped)
    kept = clean.remove_revert_spikes(priced, 0.3)
    filled = clean.fill_small_gaps(kept, calendar, 2)

    def n(frame):
        return {x.ticker: x["count"] for x in frame.groupBy("ticker").count().collect()}

    a, b, c, d, e, f = (n(x) for x in (df, deduped, priced, kept, filled, filled.where("filled")))
    for x in clean.cleaning_report(df, ["n"], calendar, 0.3, 2).collect():
        t = x.ticker
        assert (x.rows_in, x.duplicates, x.missing_prices, x.spikes, x.gap_rows_added, x.rows_out) == (
            a[t], a[t] - b[t], b[t] - c[t], c[t] - d[t], f.get(t, 0), e[t])
