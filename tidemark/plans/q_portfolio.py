"""Portfolio weights, backtests, regimes, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest, portfolio, ranking, regimes, report, significance
from tidemark.plans.base import Inputs
from tidemark.plans.q_ranking import BLOCK, DRAWS, MIX, avg_rank, student_sql
from tidemark.plans.registry import g, grid, gridded, gs, query
from tidemark.session import new_path
from tidemark.sources import readers, sinks

N = 15
USABLE = "usable AS (SELECT pred_date, ticker, score, volatility FROM predictions WHERE valid AND score IS NOT NULL)"
PICKED = f"""{USABLE}, placed AS (SELECT *, row_number() OVER (PARTITION BY pred_date ORDER BY score, ticker) AS up, row_number() OVER (PARTITION BY pred_date ORDER BY score DESC, ticker DESC) AS down,
  least({N}, count(*) OVER (PARTITION BY pred_date) // 2) AS k FROM usable),
picked AS (SELECT pred_date, ticker, k, volatility, 1 AS leg FROM placed WHERE down <= k UNION ALL SELECT pred_date, ticker, k, volatility, -1 FROM placed WHERE up <= k),
equal_w AS (SELECT pred_date, ticker, leg / k AS weight FROM picked)"""


@query("prt1_usable_rows", f"WITH {USABLE} SELECT pred_date, count(*) AS n FROM usable GROUP BY 1")
def _(i: Inputs):
    return portfolio.usable(i.predictions).groupBy("pred_date").agg(F.count(F.lit(1)).alias("n"))


@query("prt2_equal_weight", f"WITH {PICKED} SELECT pred_date, ticker, {gs('weight')} FROM equal_w")
def _(i: Inputs):
    return gridded(portfolio.equal_weight(i.predictions, top_n=N), "pred_date ticker", "weight")


@query("prt2_equal_weight_capped", f"WITH {PICKED} SELECT pred_date, ticker, {g('sign(weight) * least(abs(weight), 0.06)')} AS weight FROM equal_w")
def _(i: Inputs):
    return gridded(portfolio.equal_weight(i.predictions, top_n=N, cap=0.06), "pred_date ticker", "weight")


@query("prt3_risk_parity", f"""WITH {PICKED}, inv AS (SELECT *, 1 / greatest(volatility, 0.005) AS inv FROM picked), w AS (SELECT pred_date, ticker, leg * inv / sum(inv) OVER (PARTITION BY pred_date, leg) AS weight FROM inv)
SELECT pred_date, ticker, {g('sign(weight) * least(abs(weight), 0.2)')} AS weight FROM w""")
def _(i: Inputs):
    rows = i.predictions.where("volatility is not null or score is null or not valid")
    return gridded(portfolio.risk_parity(rows, top_n=N, cap=0.2), "pred_date ticker", "weight")


SECTOR = f"""{USABLE}, sized AS (SELECT u.pred_date, u.ticker, score, sector, count(*) OVER s AS n, row_number() OVER (PARTITION BY pred_date, sector ORDER BY score, u.ticker) AS place FROM usable u JOIN sectors s2 ON s2.ticker = u.ticker WINDOW s AS (PARTITION BY pred_date, sector)),
big AS (SELECT *, greatest(1, round_even(n * 0.2::DOUBLE, 0))::INT AS k FROM sized WHERE n >= 2), counted AS (SELECT pred_date, count(DISTINCT sector) AS ns FROM big GROUP BY 1),
sector_w AS (SELECT pred_date, ticker, (CASE WHEN place > n - k THEN 1 ELSE 0 END - CASE WHEN place <= k THEN 1 ELSE 0 END) * (1 / ns / k) AS weight FROM big JOIN counted USING (pred_date) WHERE place > n - k OR place <= k)"""


@query("prt4_sector_neutral", f"WITH {SECTOR} SELECT pred_date, ticker, {gs('weight')} FROM sector_w")
def _(i: Inputs):
    return gridded(portfolio.sector_neutral(i.predictions, i.sectors), "pred_date ticker", "weight")


@query("prt5_exposures", f"WITH {PICKED} SELECT pred_date, {g('sum(abs(weight))')} AS gross, {g('sum(weight)')} AS net, abs(sum(weight)) < 1e-6 AS dollar_neutral, count_if(weight > 0) AS n_long, count_if(weight < 0) AS n_short FROM equal_w GROUP BY 1")
def _(i: Inputs):
    return gridded(portfolio.exposures(portfolio.equal_weight(i.predictions, top_n=N)), "pred_date dollar_neutral n_long n_short", "gross net")


@query("prt6_constructor_by_name", f"""WITH {PICKED}, {SECTOR[len(USABLE) + 2:]}
SELECT 'equal' AS name, count(*) AS n, {g('sum(abs(weight))', 2)} AS gross FROM equal_w UNION ALL SELECT 'sector', count(*), {g('sum(abs(weight))', 2)} FROM sector_w""")
def _(i: Inputs):
    out = None
    for name, alias in (("equal", "long_short"), ("sector", "sector_neutral")):
        build = portfolio.constructor(alias, i.sectors, **({"top_n": N} if name == "equal" else {}))
        one = build(i.predictions).agg(F.count(F.lit(1)).alias("n"), grid(F.sum(F.abs("weight")), 2).alias("gross")).select(F.lit(name).alias("name"), "n", "gross")
        out = one if out is None else out.unionByName(one)
    return out


# -- backtest: monthly rebalance on weekly bars ---------------------------------------------------


def scored(i: Inputs):
    return i.predictions.where("score is not null")


def run(i: Inputs, name: str):
    """Days, written once, and positions, which read what the run wrote."""
    if f"run_{name}" in i._stored:
        return i._stored[f"run_{name}"]
    build = {"equal": portfolio.constructor("equal", top_n=N), "sector": portfolio.constructor("sector", i.sectors),
             "risk": portfolio.constructor("risk", top_n=N)}[name]
    rows = scored(i)
    if name == "risk":
        rows = rows.where("volatility is not null")
    result = backtest.run_backtest(rows, i.weekly, build, "M", 10.0, i.roster if name == "equal" else None, strategy=name)
    i._stored[f"run_{name}"] = i._keep(f"daily_{name}", lambda: result.daily), result.positions
    return i._stored[f"run_{name}"]


def variants(i: Inputs):
    return run(i, "equal")[0].unionByName(run(i, "sector")[0]).unionByName(run(i, "risk")[0])


def _book_sql(tag: str, rows: str, weights: str) -> str:
    """The day-by-day rule, replayed by recursion over days with the book as a list of positions."""
    return f"""
cal_{tag} AS (SELECT date, row_number() OVER (ORDER BY date)::INT AS day FROM (SELECT DISTINCT date FROM weekly)
  WHERE date BETWEEN (SELECT min(pred_date) FROM {rows}) AND (SELECT max(pred_date) FROM {rows})),
reb_{tag} AS (SELECT c.date, c.day FROM (SELECT date, day, row_number() OVER (PARTITION BY year(date), month(date) ORDER BY date) AS k FROM cal_{tag}) c
  WHERE k = 1 AND date IN (SELECT pred_date FROM {rows})),
new_{tag} AS (SELECT r.day, w.ticker, w.weight FROM {weights} w JOIN reb_{tag} r ON r.date = w.pred_date),
px_{tag} AS (SELECT c.day, ticker, adj_close AS px FROM weekly JOIN cal_{tag} c USING (date)),
step_{tag} AS (
  SELECT n.day AS day, n.ticker, n.weight AS weight, p.px AS last_px, 0.0::DOUBLE AS gain, true AS fresh FROM new_{tag} n JOIN px_{tag} p ON p.day = n.day AND p.ticker = n.ticker
  UNION ALL
  SELECT s.day + 1, s.ticker, CASE WHEN p.px IS NULL THEN s.weight ELSE s.weight * p.px / s.last_px END, p.px,
         CASE WHEN p.px IS NULL THEN 0.0 ELSE s.weight * (p.px / s.last_px - 1) END, false
  FROM step_{tag} s JOIN cal_{tag} c ON c.day = s.day + 1 LEFT JOIN px_{tag} p ON p.day = s.day + 1 AND p.ticker = s.ticker
  WHERE s.last_px IS NOT NULL AND (s.fresh OR s.day NOT IN (SELECT day FROM reb_{tag}))),
pnl_{tag} AS (SELECT day, sum(gain) AS gain FROM step_{tag} WHERE NOT fresh GROUP BY 1),
turn_{tag} AS (SELECT day, sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) AS turnover FROM new_{tag} n
  FULL JOIN (SELECT * FROM step_{tag} WHERE NOT fresh AND day IN (SELECT day FROM reb_{tag})) o USING (day, ticker) GROUP BY 1),
daily_{tag} AS (SELECT '{tag}' AS strategy, c.date, r.day IS NOT NULL AS reb, CASE WHEN r.day IS NOT NULL THEN coalesce(turnover, 0) END AS turnover,
  CASE WHEN r.day IS NOT NULL THEN coalesce(turnover, 0) * 0.001::DOUBLE END AS cost, coalesce(gain, 0) - coalesce(CASE WHEN r.day IS NOT NULL THEN turnover * 0.001::DOUBLE END, 0) AS ret
  FROM cal_{tag} c LEFT JOIN reb_{tag} r USING (day) LEFT JOIN pnl_{tag} USING (day) LEFT JOIN turn_{tag} USING (day)),
positions_{tag} AS (SELECT '{tag}' AS strategy, c.date, ticker, weight FROM step_{tag} JOIN cal_{tag} c USING (day) WHERE fresh OR day NOT IN (SELECT day FROM reb_{tag}))"""


MEMBER_ROWS = """rows_equal AS (SELECT p.* FROM predictions p JOIN (SELECT date, (SELECT max(snapshot_date) FROM snapshots WHERE snapshot_date <= date) AS snapshot_date FROM calendar) d ON d.date = p.pred_date
  SEMI JOIN roster r ON r.snapshot_date = d.snapshot_date AND r.ticker = p.ticker WHERE p.score IS NOT NULL),
all_scored AS (SELECT * FROM predictions WHERE score IS NOT NULL)"""


def _variant(sql: str, tag: str, rows: str) -> str:
    """PICKED or SECTOR on another row set, with its tables renamed."""
    for t in ("usable", "placed", "picked", "equal_w", "sized", "big", "counted", "sector_w"):
        sql = sql.replace(f"{t} ", f"{t}_{tag} ").replace(f"{t})", f"{t}_{tag})")
    return sql.replace("FROM predictions", f"FROM {rows}")


EQUAL_RUN = f"{MEMBER_ROWS}, {_variant(PICKED, 'e', 'rows_equal')}, {_book_sql('equal', 'all_scored', 'equal_w_e')}"
SECTOR_RUN = f"{_variant(SECTOR, 's', 'predictions')}, {_book_sql('sector', 'all_scored', 'sector_w_s')}"
RUN = f"WITH RECURSIVE {EQUAL_RUN}"
BOTH = f"WITH RECURSIVE {EQUAL_RUN}, {SECTOR_RUN}, dailies AS (SELECT * FROM daily_equal UNION ALL SELECT * FROM daily_sector)"


def two(i: Inputs):
    return run(i, "equal")[0].unionByName(run(i, "sector")[0])


for _f, _part in (("W", "isoyear(date), week(date)"), ("M", "year(date), month(date)"), ("D", "date")):

    @query(f"bt1_rebalance_days_{_f.lower()}", f"SELECT date, row_number() OVER (PARTITION BY {_part} ORDER BY date) = 1 AS scheduled FROM daily_calendar")
    def _(i: Inputs, f: str = _f):
        return backtest.rebalance_days(i.daily_calendar, f).select("date", "scheduled")


@query("bt2_effective_rebalances", f"{RUN} SELECT strategy, date FROM daily_equal WHERE reb")
def _(i: Inputs):
    return run(i, "equal")[0].where("turnover is not null").select("strategy", "date")


@query("bt3_daily_returns", f"{BOTH} SELECT strategy, date, {gs('ret')} FROM dailies")
def _(i: Inputs):
    return gridded(two(i), "strategy date", "ret")


@query("bt4_turnover_and_costs", f"{BOTH} SELECT strategy, date, {gs('turnover')}, {g('cost', 6)} AS cost FROM dailies WHERE reb")
def _(i: Inputs):
    return two(i).where("turnover is not null").select("strategy", "date", grid("turnover").alias("turnover"), grid("cost", 6).alias("cost"))


CURVE = f"""{BOTH}, curve AS (SELECT strategy, date, ret, turnover, cost, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS equity FROM dailies),
curves AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY date) AS peak FROM curve),
summary AS (SELECT strategy, avg(ret) / stddev_pop(ret) * sqrt(252) AS sharpe, (1 + avg(ret)) ^ 252 - 1 AS annual_return, stddev_pop(ret) * sqrt(252) AS annual_vol, avg(turnover) AS avg_turnover, sum(cost) AS total_cost,
  count(*) AS n_days, min((equity - peak) / peak) AS max_drawdown, arg_max(equity, date) AS final_equity FROM curves GROUP BY 1)"""


@query("bt5_equity_curve", f"{CURVE} SELECT strategy, date, {gs('equity peak')}, {g('(equity - peak) / peak')} AS drawdown FROM curves")
def _(i: Inputs):
    return gridded(backtest.equity_curve(two(i), 1.0), "strategy date", "equity peak drawdown")


SUMMARY = "sharpe annual_return annual_vol max_drawdown avg_turnover total_cost final_equity"


@query("bt6_summary", f"{CURVE} SELECT strategy, n_days, {gs(SUMMARY, 3)} FROM summary")
def _(i: Inputs):
    return gridded(backtest.summarise(two(i), 1.0), "strategy n_days", SUMMARY, 3)


@query("bt7_positions", f"{RUN} SELECT strategy, date, ticker, {gs('weight')} FROM positions_equal")
def _(i: Inputs):
    return gridded(run(i, "equal")[1], "strategy date ticker", "weight")


S1, S7 = ("coalesce(sum(weight) FILTER (ticker = 'S1'), 0)", "coalesce(sum(weight) FILTER (ticker = 'S7'), 0)")


@query("bt7_position_matrix", f"{RUN} SELECT strategy, date, {g(S1)} AS S1, {g(S7)} AS S7 FROM positions_equal GROUP BY 1, 2")
def _(i: Inputs):
    return gridded(backtest.position_matrix(run(i, "equal")[1], ["S1", "S7"]), "strategy date", "S1 S7")


HOLD = "sharpe annual_return cumulative_return max_drawdown hit_rate daily_vol"


@query("bt8_buy_and_hold", f"""WITH r AS (SELECT ticker, adj_close, ln(adj_close / lag(adj_close) OVER w) AS r, max(adj_close) OVER w AS peak FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY date)),
s AS (SELECT ticker, count(r) AS n_days, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, exp(avg(r) * 252) - 1 AS annual_return, exp(sum(r)) - 1 AS cumulative_return, min(adj_close / peak - 1) AS max_drawdown, count_if(r > 0) / count(r) AS hit_rate, stddev_samp(r) AS daily_vol FROM r GROUP BY 1)
SELECT ticker, n_days, {gs(HOLD)} FROM s""")
def _(i: Inputs):
    return gridded(backtest.buy_and_hold(i.weekly), "ticker n_days", HOLD)


# -- regimes ------------------------------------------------------------------------------------

LABELS = f"""{BOTH}, lab AS (SELECT strategy, date, ret, CASE WHEN count(*) OVER t >= 20 THEN sum(ret) OVER t END AS trend_sum, CASE WHEN count(*) OVER v >= 8 THEN stddev_samp(ret) OVER v * sqrt(252) END AS vol FROM dailies
  WINDOW t AS (PARTITION BY strategy ORDER BY date ROWS 19 PRECEDING), v AS (PARTITION BY strategy ORDER BY date ROWS 7 PRECEDING)),
labels AS (SELECT strategy, date, ret, CASE WHEN trend_sum > 0 THEN 'bull' WHEN trend_sum < 0 THEN 'bear' ELSE 'unknown' END AS trend, CASE WHEN vol > 0.3 THEN 'high_vol' WHEN vol < 0.2 THEN 'low_vol' ELSE 'unknown' END AS vol_regime FROM lab)"""
WINDOWS = {"trend_window": 20, "vol_window": 8, "high": 0.3, "low": 0.2}


@query("reg1_labels", f"{LABELS} SELECT strategy, date, trend, vol_regime FROM labels")
def _(i: Inputs):
    return regimes.label_regimes(two(i), **WINDOWS).select("strategy", "date", "trend", "vol_regime")


REG = "annual_return annual_vol sharpe max_drawdown hit_rate"
REG_SQL = f"""{LABELS}, long AS (SELECT strategy, date, ret, trend AS regime FROM labels UNION ALL SELECT strategy, date, ret, vol_regime FROM labels UNION ALL SELECT strategy, date, ret, 'all' FROM labels),
eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy, regime ORDER BY date) AS e FROM long WHERE regime <> 'unknown'),
dd AS (SELECT *, e / max(e) OVER (PARTITION BY strategy, regime ORDER BY date) - 1 AS dd FROM eq),
st AS (SELECT strategy, regime, count(*) AS n_days, (1 + avg(ret)) ^ 252 - 1 AS annual_return, stddev_pop(ret) * sqrt(252) AS annual_vol, CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(252) END AS sharpe, min(dd) AS max_drawdown, count_if(ret > 0) / count(*) AS hit_rate FROM dd GROUP BY 1, 2),
regs AS (SELECT strategy, regime, coalesce(n_days, 0) AS n_days, annual_return, annual_vol, sharpe, max_drawdown, hit_rate FROM (SELECT DISTINCT strategy FROM dailies) CROSS JOIN (VALUES ('bull'), ('bear'), ('high_vol'), ('low_vol'), ('all')) x(regime) LEFT JOIN st USING (strategy, regime))"""


def _regime_stats(i: Inputs):
    out = None
    for name in ("equal", "sector"):
        one = run(i, name)[0]
        stats = regimes.regime_stats(one, regimes.label_regimes(one, **WINDOWS))
        out = stats if out is None else out.unionByName(stats)
    return out


@query("reg2_regime_stats", f"{REG_SQL} SELECT strategy, regime, n_days, {gs(REG, 3)} FROM regs")
def _(i: Inputs):
    return gridded(_regime_stats(i), "strategy regime n_days", REG, 3)


# -- report tables --------------------------------------------------------------------------------


def comparison(i: Inputs):
    return report.comparison_table(backtest.summarise(two(i), 1.0))


@query("rpt1_comparison", f"{CURVE} SELECT strategy AS variant, n_days, {gs(SUMMARY, 3)} FROM summary")
def _(i: Inputs):
    return gridded(comparison(i), "variant n_days", SUMMARY, 3)


@query("rpt2_executive_summary", f"""{CURVE} SELECT arg_max(strategy, sharpe) AS best_variant, {g('max(sharpe)', 3)} AS best_sharpe, {g('arg_max(annual_return, sharpe)', 3)} AS best_annual_return,
  {g('arg_max(max_drawdown, sharpe)', 3)} AS best_max_drawdown, min(strategy) AS baseline_variant, {g('max(sharpe) - arg_min(sharpe, strategy)', 3)} AS sharpe_lift FROM summary""")
def _(i: Inputs):
    out = report.executive_summary(comparison(i))
    return gridded(out, "best_variant baseline_variant", "best_sharpe best_annual_return best_max_drawdown sharpe_lift", 3)


def _landed_runs(i: Inputs) -> str:
    """Summaries and series of both runs as files, one folder per variant."""
    if "runs" not in i._stored:
        path = new_path(i.spark, "runs")
        for name in ("equal", "sector"):
            daily = run(i, name)[0]
            stats = _regime_stats(i).where(F.col("strategy") == name)
            entry = F.struct(F.col("regime"), F.struct("n_days", "annual_return", "annual_vol", "sharpe", "max_drawdown", "hit_rate"))
            maps = stats.groupBy("strategy").agg(F.map_from_entries(F.collect_list(entry)).alias("regimes"))   # five regimes
            fields = ["sharpe", "annual_return", "annual_vol", "max_drawdown", "avg_turnover", "total_cost", "final_equity", "n_days"]
            summary = backtest.summarise(daily, 1.0).select("strategy", F.struct(*fields).alias("backtest")).join(maps, "strategy")
            body = summary.select(F.to_json(F.struct("backtest", "regimes")).alias("value"))
            body.coalesce(1).write.text(f"{path}/{name}/summary.json")
            daily.select("date", "ret").coalesce(1).write.option("header", True).csv(f"{path}/{name}/daily_returns.csv")
        i._stored["runs"] = path
    return i._stored["runs"]


def _summaries(i: Inputs):
    return readers.read_run_summaries(i.spark, _landed_runs(i))


@query("src17_run_artefacts", f"{CURVE} SELECT strategy AS variant, {gs('sharpe max_drawdown', 3)}, n_days, {g('(SELECT sum(ret) FROM dailies d WHERE d.strategy = s.strategy)', 3)} AS total FROM summary s")
def _(i: Inputs):
    series = readers.read_run_series(i.spark, _landed_runs(i), "daily_returns", "ret")
    total = series.groupBy("variant").agg(F.sum("ret").alias("total"))
    rows = _summaries(i).select("variant", "backtest.*").join(total, "variant")
    return gridded(rows, "variant n_days", "sharpe max_drawdown total", 3)


@query("rpt3_regime_breakdown", f"{REG_SQL} SELECT strategy AS variant, regime, n_days, {gs(REG, 3)} FROM regs")
def _(i: Inputs):
    return gridded(report.regime_breakdown(_summaries(i)), "variant regime n_days", REG, 3)


@query("reg3_regime_table", f"{REG_SQL} SELECT regime, sum(n_days)::BIGINT AS n_days FROM regs GROUP BY 1")
def _(i: Inputs):
    return _regime_stats(i).groupBy("regime").agg(F.sum("n_days").alias("n_days"))


MONTHS = [f"m{m:02d}" for m in range(1, 13)]


@query("rpt4_monthly_grid", f"{BOTH} SELECT strategy, year(date) AS year, " + ", ".join(
    f"{g(f'(product(1 + ret) FILTER (month(date) = {m})) - 1')} AS m{m:02d}" for m in range(1, 13)) + " FROM dailies GROUP BY 1, 2")
def _(i: Inputs):
    return gridded(report.monthly_grid(two(i)), "strategy year", " ".join(MONTHS))


@query("rpt5_rolling_ic", f"""WITH r AS (SELECT pred_date, {avg_rank('score', 'pred_date')} AS rs, {avg_rank('target', 'pred_date')} AS rt FROM valid_predictions),
i AS (SELECT pred_date, corr(rs, rt) AS ic FROM r GROUP BY 1 HAVING count(*) >= 2)
SELECT pred_date, {g('CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END')} AS rolling_ic FROM i WINDOW w AS (ORDER BY pred_date ROWS 19 PRECEDING)""")
def _(i: Inputs):
    ic = ranking.rank_ic(i.predictions).withColumn("variant", F.lit("momentum"))
    return gridded(report.rolling_ic(ic), "pred_date", "rolling_ic")


@query("rpt6_variant_ranking", f"{CURVE} SELECT strategy AS variant, {gs('sharpe', 3)}, row_number() OVER (ORDER BY sharpe DESC, strategy)::INT AS place FROM summary")
def _(i: Inputs):
    return gridded(report.rank_variants(comparison(i)), "variant place", "sharpe", 3)


SHARPES = "avg(a) / stddev_pop(a) * sqrt(252) - avg(b) / stddev_pop(b) * sqrt(252)"
T_RETURNS = "(m / (sd / sqrt(n)))"


@query("sig7_consecutive_variants", f"""{BOTH}, j AS (SELECT date, s.ret AS a, e.ret AS b FROM daily_sector s JOIN daily_equal e USING (date)),
stats AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd, {SHARPES} AS diff FROM j),
seq AS (SELECT a, b, row_number() OVER (ORDER BY date) - 1 AS i FROM j),
plan AS (SELECT draw, blk, n, {MIX} % (n - {BLOCK} + 1) AS start FROM stats CROSS JOIN (SELECT unnest(range(0, {DRAWS}))::BIGINT AS draw) CROSS JOIN LATERAL (SELECT unnest(range(0, ceil(n / {BLOCK})::BIGINT))::BIGINT AS blk)),
idx AS (SELECT draw, start + o AS i FROM plan CROSS JOIN (SELECT unnest(range(0, {BLOCK})) AS o) WHERE blk * {BLOCK} + o < n),
per AS (SELECT draw, {SHARPES} AS diff FROM idx JOIN seq USING (i) GROUP BY 1),
ends AS (SELECT quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high FROM per)
SELECT 'sector' AS variant, 'equal' AS baseline, n, {g(T_RETURNS, 3)} AS t_stat_returns, {g(student_sql(T_RETURNS, '(n - 1)'), 4)} AS p_value_returns, {g('diff', 3)} AS sharpe_diff,
  {g('low', 3)} AS ci_low, {g('high', 3)} AS ci_high FROM stats, ends""")
def _(i: Inputs):
    rows = two(i).select(F.col("strategy").alias("variant"), "date", "ret")
    out = significance.compare_consecutive(rows, draws=DRAWS, block=BLOCK)
    return out.select("variant", "baseline", "n", grid("p_value_returns").alias("p_value_returns"), *[grid(c, 3).alias(c) for c in ("t_stat_returns", "sharpe_diff", "ci_low", "ci_high")])


@query("snk2_report_sink", f"{CURVE} SELECT strategy, {gs('sharpe', 3)}, (SELECT count(*) FROM curves c WHERE c.strategy = s.strategy) AS n_rows FROM summary s")
def _(i: Inputs):
    path = new_path(i.spark, "report")
    curve = backtest.equity_curve(two(i), 1.0)
    sinks.write_report(backtest.summarise(two(i), 1.0), {"equity": curve}, path)
    back = i.spark.read.schema("strategy string, sharpe double").json(f"{path}/summary")
    rows = i.spark.read.option("header", True).schema("strategy string, date date, equity double, peak double, drawdown double").csv(f"{path}/equity")
    return gridded(back.join(rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_rows")), "strategy"), "strategy n_rows", "sharpe", 3)


@query("snk4_summary_append", f"{CURVE} SELECT strategy, {gs('sharpe', 3)} FROM summary")
def _(i: Inputs):
    path = new_path(i.spark, "summaries")
    for name in ("equal", "sector"):
        sinks.append_summary(backtest.summarise(run(i, name)[0], 1.0).select("strategy", "sharpe"), path)
    return gridded(i.spark.read.option("header", True).schema("strategy string, sharpe double").csv(path), "strategy", "sharpe", 3)


@query("u4_constructor_protocol", f"WITH {USABLE} SELECT pred_date, ticker, {g('2 * score / sum(abs(score)) OVER (PARTITION BY pred_date)')} AS weight FROM usable")
def _(i: Inputs):
    def proportional(df):
        rows = portfolio.usable(df)
        total = rows.groupBy("pred_date").agg(F.sum(F.abs("score")).alias("_t"))
        return rows.join(total, "pred_date").select("pred_date", "ticker", (2 * F.col("score") / F.nullif(F.col("_t"), F.lit(0.0))).alias("weight"))

    build: portfolio.Constructor = proportional
    return gridded(build(i.predictions), "pred_date ticker", "weight")
