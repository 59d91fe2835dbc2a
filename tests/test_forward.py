"""The prediction log, back-scoring, streaming intake and sinks."""

import json
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import business_days, day, random_walk
from tidemark.operators import forward
from tidemark.session import store, work_folder
from tidemark.sources import sinks
from tidemark.streaming import intake

TICKERS = [f"T{k:02d}" for k in range(6)]


@pytest.fixture(scope="module")
def world(spark):
    pdf = random_walk(TICKERS, 60, start="2024-01-02", seed=11)
    wide = pdf.pivot(index="date", columns="ticker", values="adj_close")
    rows = [(d, t, float(np.log(wide[t].iloc[k + 5] / wide[t].iloc[k])), 5)
            for k, d in enumerate(wide.index) if 20 <= k < 30 for t in TICKERS]
    rows += [(wide.index[-1], t, 0.1 * n, 5) for n, t in enumerate(TICKERS)]
    log = spark.createDataFrame(rows, "pred_date date, ticker string, score double, horizon int")
    return spark.createDataFrame(pdf), log


def test_log_is_append_only_and_scores_mature_dates(spark, world, tmp_path):
    prices, rows = world
    log = forward.PredictionLog(spark, str(tmp_path))
    assert log.predictions().count() == 0 and log.results().count() == 0
    log.append(rows)
    log.append(rows.withColumn("score", F.lit(9.0)))
    assert log.predictions().count() == rows.count() and log.predictions().where("score = 9").count() == 0
    assert log.predictions_on("2024-02-01").count() == 6
    early = log.rescore(prices.where("date < '2024-02-12'"))
    n_early = early.count()
    out = log.rescore(prices).collect()
    assert 0 < n_early < 10 and len(out) == 10 and all(r.ic == pytest.approx(1.0) and r.n_valid == 6 for r in out)
    assert log.rescore(prices).count() == 10
    summary = forward.live_summary(log.results()).first()
    assert summary.n_scored == 10 and summary.ic_30 == pytest.approx(1.0) and summary.first_date < summary.last_date
    log.upsert_results(log.results().limit(1).withColumn("ic", F.lit(0.5)))
    assert log.results().count() == 10 and log.results().where("ic = 0.5").count() == 1
    assert [r.n_tickers for r in log.overview().limit(1).collect()] == [6] and log.recent(3).count() == 3


def test_too_few_names_wait(spark, world):
    prices, rows = world
    few = rows.where(F.col("ticker").isin(TICKERS[:4]))
    assert forward.back_score(few, prices).count() == 0


def test_live_summary_tails(spark):
    rows = pd.DataFrame({"pred_date": business_days("2024-01-01", 40), "ic": 0.03 + 0.0005 * np.arange(40), "hit_rate": 0.55, "spread": 0.01, "n_valid": 50, "horizon": 5})
    s = forward.live_summary(spark.createDataFrame(rows)).first()
    assert s.mean_ic == pytest.approx(rows.ic.mean()) and s.ic_30 == pytest.approx(rows.ic.tail(30).mean()) and s.ic_90 == pytest.approx(s.mean_ic)


def test_records_must_match(spark):
    good = spark.createDataFrame([("2024-01-02", ["A", "B"], [1.0, None], 5)], "date string, tickers array<string>, scores array<double>, horizon int")
    assert {(r.ticker, r.score) for r in forward.explode_records(good).collect()} == {("A", 1.0), ("B", None)}
    bad = spark.createDataFrame([("2024-01-02", ["A", "B"], [1.0], 5)], good.schema)
    with pytest.raises(Exception, match="differ in length"):
        forward.explode_records(bad).collect()


def _stream(spark, folder, rows, schema, n):
    """Append one more file to a folder of JSON lines."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"part-{n}.json"), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    return spark.readStream.schema(schema).json(str(folder))


def test_stream_intake_does_not_repeat(spark, tmp_path):
    schema = "pred_date date, ticker string, score double, horizon int"
    rows = [{"pred_date": "2024-01-02", "ticker": t, "score": 1.0, "horizon": 5} for t in TICKERS]
    log = forward.PredictionLog(spark, str(tmp_path / "log"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    intake.log_predictions(_stream(spark, source, rows, schema, 1), log, state).awaitTermination()
    again = [{**r, "score": 2.0} for r in rows] + [{**rows[0], "pred_date": "2024-01-03"}] * 2
    intake.log_predictions(_stream(spark, source, again, schema, 2), log, state).awaitTermination()
    assert {(str(r.pred_date), r.n_tickers) for r in log.overview().collect()} == {("2024-01-02", 6), ("2024-01-03", 1)}
    assert log.predictions().where("score <> 1.0").count() == 0


def test_bars_stream_scores_on_arrival(spark, world, tmp_path):
    prices, rows = world
    log = forward.PredictionLog(spark, str(tmp_path / "log"))
    log.append(rows)
    incoming = str(tmp_path / "bars")
    prices.repartition(4, "date").write.parquet(incoming)
    stream = spark.readStream.schema(prices.schema).parquet(incoming)
    for state in ("a", "b"):        # a replay replaces whole days
        intake.score_on_arrival(stream, log, str(tmp_path / "prices"), str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "prices")).count() == prices.count()
    assert log.results().count() == 10


def test_late_messages_are_dropped_behind_the_watermark(spark, tmp_path):
    schema = "ts timestamp, ticker string, source string, score double"

    def message(ts):
        return {"ts": ts, "ticker": "A", "source": "s", "score": 1.0}

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    intake.run_available(intake.daily_counts(_stream(spark, source, [message("2024-01-01T10:00:00Z"), message("2024-01-03T10:00:00Z")], schema, 1)), out, state)
    intake.run_available(intake.daily_counts(_stream(spark, source, [message("2024-01-01T11:00:00Z"), message("2024-01-05T10:00:00Z")], schema, 2)), out, state)
    got = {str(r.date): r.volume for r in spark.read.parquet(out).collect()}
    assert got == {"2024-01-01": 1, "2024-01-03": 1}


def test_sinks_and_resume(spark, world, tmp_path):
    prices, _ = world
    sinks.write_table(prices, str(tmp_path / "t"), ["ticker"])
    assert spark.read.parquet(str(tmp_path / "t")).where("ticker = 'T01'").count() == 60
    work = spark.createDataFrame([(t,) for t in "abcd"], "k string")
    before, now = work.where("k = 'a'"), work.where("k in ('b', 'c')")
    assert {r.k for r in sinks.pending(work, before, ["k"]).collect()} == set("bcd")
    assert {r.status: r.n for r in sinks.work_status(work, before, now, ["k"]).collect()} == {"skipped": 1, "succeeded": 2, "failed": 1}
    roster = spark.createDataFrame([(day("2024-01-02"), t) for t in "ba"], "snapshot_date date, ticker string")
    assert sinks.roster_to_json(roster).first().json == '{"2024-01-02":["a","b"]}'
    sinks.write_report(spark.createDataFrame([("x", 1.0)], "strategy string, sharpe double"), {"ret": prices.select("date", "close")}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/summary")).first().sharpe == 1.0


def test_work_folder_follows_the_session_setting(spark, tmp_path):
    assert os.path.isdir(work_folder(spark))
    named = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: {"spark.checkpoint.dir": str(tmp_path)}))
    assert work_folder(named) == str(tmp_path)
    kept = store(spark.range(5).toDF("x"), str(tmp_path / "kept"))
    assert kept.count() == 5 and kept.columns == ["x"]


def test_a_date_may_come_in_pieces(spark, tmp_path):
    log = forward.PredictionLog(spark, str(tmp_path / "pieces"))
    schema = "pred_date date, ticker string, score double, horizon int"
    one = spark.createDataFrame([(pd.Timestamp("2024-01-02").date(), "A", 0.5, 5), (pd.Timestamp("2024-01-02").date(), "A", 0.1, 5)], schema)
    two = spark.createDataFrame([(pd.Timestamp("2024-01-02").date(), "B", 0.7, 5), (pd.Timestamp("2024-01-02").date(), "A", 0.9, 5)], schema)
    for batch in (one, two, one, two):
        log.append(batch)
    assert {(r.ticker, r.score) for r in log.predictions().collect()} == {("A", 0.1), ("B", 0.7)} and log.predictions().count() == 2


def test_resume_has_all_three_statuses(spark):
    from tidemark.plans import QUERIES

    assert {r.status for r in QUERIES["snk5_resume"](spark, "/root/testdata/sf0.001").collect()} == {"skipped", "succeeded", "failed"}


def _rows(spark, *rows):
    return spark.createDataFrame([(day(d), t, s, 5) for d, t, s in rows], "pred_date date, ticker string, score double, horizon int")


def _held(log):
    return sorted((str(r.pred_date), r.ticker, r.score) for r in log.predictions().collect())


def test_a_stopped_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    log = forward.PredictionLog(spark, str(tmp_path))
    log.append(_rows(spark, ("2024-01-02", "A", 1.0)))
    with monkeypatch.context() as m:
        m.setattr(log.prediction_table, "_commit", lambda at: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            log.append(_rows(spark, ("2024-01-02", "B", 2.0), ("2024-01-03", "A", 3.0)))
    assert _held(log) == [("2024-01-02", "A", 1.0)]
    log.append(_rows(spark, ("2024-01-02", "B", 2.5)))
    assert _held(log) == [("2024-01-02", "A", 1.0), ("2024-01-02", "B", 2.5)]
    table = log.prediction_table
    assert len(table._names("data")) == 3
    first = table.snapshot(1)
    table.compact()
    assert _held(log) == [("2024-01-02", "A", 1.0), ("2024-01-02", "B", 2.5)] and len(table.snapshot().folders) == 1
    assert [r.ticker for r in table.read(first).collect()] == ["A"]         # an earlier version can still be read
    table.vacuum(keep=1)
    assert len(table._names("data")) == len(table._names("commits")) == 1 and len(_held(log)) == 2


def test_of_two_writers_both_are_kept_once(spark, tmp_path, monkeypatch):
    log, other = (forward.PredictionLog(spark, str(tmp_path)) for _ in range(2))
    log.append(_rows(spark, ("2024-01-02", "A", 1.0)))
    commit, asked = log.prediction_table._commit, []

    def late(at):
        if not asked:
            # the other writer comes between this one's data and its commit, with a row of its own and one of the same
            other.append(_rows(spark, ("2024-01-02", "B", 2.0), ("2024-01-02", "C", 3.0)))
        asked.append(at.version)
        commit(at)

    monkeypatch.setattr(log.prediction_table, "_commit", late)
    log.append(_rows(spark, ("2024-01-02", "C", 9.0), ("2024-01-02", "D", 4.0)))
    assert asked == [2, 3]
    assert _held(log) == [("2024-01-02", "A", 1.0), ("2024-01-02", "B", 2.0), ("2024-01-02", "C", 3.0), ("2024-01-02", "D", 4.0)]
    assert len(log.prediction_table._names("data")) == 3


def test_numbered_batches_are_taken_once(spark, tmp_path):
    log = forward.PredictionLog(spark, str(tmp_path))
    assert log.append(_rows(spark, ("2024-01-02", "A", 1.0)), "w", 0)
    assert not log.append(_rows(spark, ("2024-01-02", "B", 1.0)), "w", 0)
    assert log.append(_rows(spark, ("2024-01-02", "B", 2.0)), "w", 1) and log.append(_rows(spark, ("2024-01-02", "C", 2.0)), "v", 0)
    assert [t for _, t, _ in _held(log)] == ["A", "B", "C"]
