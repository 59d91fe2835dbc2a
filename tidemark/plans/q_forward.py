"""Forward test, in batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import forward
from tidemark.plans.base import SOURCES, Inputs, _case, _mapped
from tidemark.plans.q_ranking import _corr, avg_rank
from tidemark.plans.registry import g, grid, gridded, gs, query
from tidemark.session import new_path
from tidemark.sources import sinks
from tidemark.streaming import intake, matured

N = 20
SCORE_COLUMNS = "ic hit_rate spread"


def log_rows(i: Inputs):
    """The momentum score of each month's first week, four weeks ahead."""
    rows = i.predictions.where("score is not null").join(i.month_starts, "pred_date", "left_semi")
    return rows.select("pred_date", "ticker", "score", F.lit(4).alias("horizon"))


LOG = """log AS (SELECT pred_date, ticker, score, 4 AS horizon FROM predictions WHERE score IS NOT NULL AND pred_date IN (SELECT pred_date FROM month_starts))"""
SCORED = f"""{LOG}, due AS (SELECT l.*, e.date AS end_date FROM log l JOIN calendar c ON c.date = l.pred_date JOIN calendar e ON e.dn = c.dn + 4),
matured AS (SELECT d.*, ln(p1.adj_close / p0.adj_close) AS target FROM due d JOIN weekly p0 ON p0.ticker = d.ticker AND p0.date = d.pred_date JOIN weekly p1 ON p1.ticker = d.ticker AND p1.date = d.end_date),
r AS (SELECT *, {avg_rank('score', 'pred_date')} AS rs, {avg_rank('target', 'pred_date')} AS rt, row_number() OVER (PARTITION BY pred_date ORDER BY score, ticker) AS up,
  row_number() OVER (PARTITION BY pred_date ORDER BY score DESC, ticker DESC) AS down, count(*) OVER (PARTITION BY pred_date) AS n FROM matured),
k AS (SELECT *, CASE WHEN n < {2 * N} THEN greatest(n // 4, 1) ELSE {N} END AS k FROM r),
results AS (SELECT pred_date, {_corr('rs', 'rt')} AS ic, CASE WHEN avg(target) FILTER (down <= k) > avg(target) FILTER (up <= k) THEN 1.0::DOUBLE ELSE 0 END AS hit_rate,
  avg(target) FILTER (down <= k) - avg(target) FILTER (up <= k) AS spread, count(*) AS n_valid, 4 AS horizon FROM k GROUP BY 1 HAVING count(*) >= 5)"""


def _log(i: Inputs) -> forward.PredictionLog:
    """Written twice, the second time with dates that are logged already."""
    if "log" not in i._stored:
        log = forward.PredictionLog(i.spark, new_path(i.spark, "log"))
        rows = log_rows(i)
        log.append(rows.where("year(pred_date) < 1999"))
        log.append(rows.withColumn("score", F.when(F.year("pred_date") < 1999, -F.col("score")).otherwise(F.col("score"))))
        log.rescore(i.weekly.where("date < '2000-06-01'"), N)
        log.rescore(i.weekly, N)
        i._stored["log"] = log
    return i._stored["log"]


@query("snk3_prediction_log", f"WITH {LOG} SELECT pred_date, ticker, {gs('score')}, horizon FROM log")
def _(i: Inputs):
    return gridded(_log(i).predictions(), "pred_date ticker horizon", "score")


@query("snk3_result_upsert", f"WITH {SCORED} SELECT pred_date, {gs(SCORE_COLUMNS)}, n_valid, horizon FROM results")
def _(i: Inputs):
    return gridded(_log(i).results(), "pred_date n_valid horizon", SCORE_COLUMNS)


@query("fwd1_append_is_idempotent", f"WITH {LOG} SELECT year(pred_date) AS year, count(*) AS n, {g('sum(score)', 3)} AS total FROM log GROUP BY 1")
def _(i: Inputs):
    log = _log(i)
    log.append(log_rows(i))
    return gridded(log.predictions().groupBy(F.year("pred_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")), "year n", "total", 3)


@query("fwd2_log_overview", f"WITH {LOG} SELECT pred_date, count(*) AS n_tickers, 4 AS horizon FROM log GROUP BY 1")
def _(i: Inputs):
    return _log(i).overview()


@query("fwd2_recent_results", f"WITH {SCORED} SELECT pred_date, {gs('ic')} FROM results ORDER BY pred_date DESC LIMIT 10")
def _(i: Inputs):
    return gridded(_log(i).recent(10), "pred_date", "ic")


@query("fwd2_array_records", f"WITH {LOG} SELECT pred_date, ticker, {gs('score')}, horizon FROM log")
def _(i: Inputs):
    # records hold up to 200 tickers each, so that no array grows with the table
    part = F.floor(F.substring(F.col("ticker"), 2, 20).cast("bigint") / F.lit(200))
    item = F.struct("ticker", "score")
    records = log_rows(i).groupBy("pred_date", "horizon", part.alias("part")).agg(F.collect_list(item).alias("_r")).select(
        F.date_format("pred_date", "yyyy-MM-dd").alias("date"), F.col("_r.ticker").alias("tickers"), F.col("_r.score").alias("scores"), "horizon")
    return gridded(forward.explode_records(records), "pred_date ticker horizon", "score")


@query("fwd3_back_score", f"WITH {SCORED} SELECT pred_date, {gs(SCORE_COLUMNS)}, n_valid, horizon FROM results")
def _(i: Inputs):
    return gridded(forward.back_score(log_rows(i), i.weekly, top_n=N, calendar=i.calendar), "pred_date n_valid horizon", SCORE_COLUMNS)


LIVE = "mean_ic ic_30 ic_90 ic_ir hit_rate"


@query("fwd4_live_summary", f"""WITH {SCORED}, b AS (SELECT *, row_number() OVER (ORDER BY pred_date DESC) AS back FROM results)
SELECT count(*) AS n_scored, {g('avg(ic)')} AS mean_ic, {g('avg(ic) FILTER (back <= 30)')} AS ic_30, {g('avg(ic) FILTER (back <= 90)')} AS ic_90, {g('avg(ic) / stddev_pop(ic)')} AS ic_ir, {g('avg(hit_rate)')} AS hit_rate,
  min(pred_date) AS first_date, max(pred_date) AS last_date FROM b""")
def _(i: Inputs):
    out = forward.live_summary(forward.back_score(log_rows(i), i.weekly, top_n=N, calendar=i.calendar))
    return gridded(out, "n_scored first_date last_date", LIVE)


@query("fwd5_latest_date", "SELECT max(date) AS as_of FROM daily")
def _(i: Inputs):
    return forward.latest_date(i.daily)


# Tickers with a very busy day have landed before, those with a busy one land now.
@query("snk5_resume", """SELECT CASE WHEN v >= 120 THEN 'skipped' WHEN v >= 100 THEN 'succeeded' ELSE 'failed' END AS status, count(*) AS n
FROM (SELECT ticker, max(volume) AS v FROM daily GROUP BY 1) GROUP BY 1""")
def _(i: Inputs):
    work = i.daily.select("ticker").distinct()
    before = i.daily.where("volume >= 120").select("ticker").distinct()
    todo = sinks.pending(work, before, ["ticker"])
    landed = i.daily.where("volume >= 100").select("ticker").distinct().join(todo, "ticker", "left_semi")
    return sinks.work_status(work, before, landed, ["ticker"])


# -- streaming over the event files -----------------------------------------------------------------


def _events(i: Inputs):
    schema = i.table("events").schema
    raw = i.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(i.folder)
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        _mapped("event_type", SOURCES, F.col("event_type")).alias("source"), ((F.col("value") - 50) / (F.col("value") + 50)).alias("score"), "value")


def _drain(i: Inputs, stream, name: str, mode: str = "append"):
    path = new_path(i.spark, name)
    intake.run_available(stream, path, new_path(i.spark, f"{name}-state"), mode)
    return i.spark.read.schema(stream.schema).parquet(path)


@query("str1_distinct_intake", "SELECT ts::DATE AS pred_date, 'U' || user_id AS ticker, 1::BIGINT AS n FROM events GROUP BY 1, 2")
def _(i: Inputs):
    stream = _events(i).select("ts", F.col("date").alias("pred_date"), "ticker")
    out = _drain(i, intake.distinct_predictions(stream, "1 day"), "intake")
    return out.groupBy("pred_date", "ticker").agg(F.count(F.lit(1)).alias("n"))


@query("str1_log_intake", "SELECT ts::DATE AS pred_date, count(DISTINCT user_id) AS n_tickers, 5 AS horizon FROM events GROUP BY 1")
def _(i: Inputs):
    log = forward.PredictionLog(i.spark, new_path(i.spark, "stream-log"))
    stream = _events(i).select(F.col("date").alias("pred_date"), "ticker", "score", F.lit(5).alias("horizon"))
    for _ in range(2):      # a second run with lost progress replays the batch and adds nothing
        intake.log_predictions(stream, log, new_path(i.spark, "log-state")).awaitTermination()
    return log.overview()


@query("str2_score_matured", f"""WITH e AS (SELECT ts, 'U' || user_id AS ticker, (value - 50) / (value + 50) AS score, value FROM events),
q AS (SELECT ticker, ts AS price_ts, min(value) AS price FROM e GROUP BY 1, 2),
p AS (SELECT ticker, ts AS pred_ts, ts + INTERVAL 5 DAY AS due, score, value AS p0 FROM e),
j AS (SELECT p.*, CASE WHEN q.price_ts < due + INTERVAL 1 DAY THEN q.price_ts END AS price_ts, q.price FROM p ASOF LEFT JOIN q ON p.ticker = q.ticker AND p.due <= q.price_ts),
w AS (SELECT 1000 * (epoch_ms(max(ts)) - 172800000) AS mark FROM events)
SELECT ticker, epoch_us(pred_ts) AS pred_us, epoch_us(price_ts) AS price_us, {gs('score')}, CASE WHEN price_ts IS NOT NULL THEN {g('ln(price / p0)', 3)} END AS target,
  CASE WHEN price_ts IS NULL THEN 'no_price' ELSE 'scored' END AS status FROM j, w WHERE CASE WHEN price_ts IS NULL THEN epoch_us(due) + 86400000000 <= mark ELSE epoch_us(price_ts) < mark END""")
def _(i: Inputs):
    predictions = _events(i).select("ts", "ticker", "score", F.col("value").alias("p0"))
    prices = _events(i).select("ts", "ticker", F.col("value").alias("price"))
    out = _drain(i, matured.score_matured(predictions, prices, 5), "matured")
    return out.select("ticker", F.unix_micros("pred_ts").alias("pred_us"), F.unix_micros("price_ts").alias("price_us"), grid("score").alias("score"), grid("target", 3).alias("target"), "status")


@query("str3_daily_counts", f"""SELECT ts::DATE AS date, 'U' || user_id AS ticker, {_case('event_type', SOURCES, 'event_type')} AS source, count(*) AS volume, {g('sum((value - 50) / (value + 50))')} AS score_sum
FROM events WHERE ts::DATE + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2, 3""")
def _(i: Inputs):
    out = _drain(i, intake.daily_counts(_events(i)), "counts")
    return gridded(out, "date ticker source volume", "score_sum")


@query("str3_sliding_baseline", f"""WITH d AS (SELECT ts, 'U' || user_id AS ticker, (ts::DATE + unnest(range(1, 21))::INT)::DATE AS date FROM events)
SELECT date, ticker, {g('count(*) / 20')} AS daily_mean FROM d WHERE date <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _(i: Inputs):
    out = _drain(i, intake.sliding_baseline(_events(i)), "baseline")
    return gridded(out, "date ticker", "daily_mean")
