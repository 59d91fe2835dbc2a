"""Ranking metrics, losses and significance."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.pvalues import normal_pvalue, student_pvalue
from tidemark.operators import losses, ranking, significance
from tidemark.operators.spread import average_ranks
from tidemark.plans.base import Inputs
from tidemark.plans.registry import g, grid, gridded, gs, query

N = 20
def avg_rank(column: str, *by: str) -> str:
    part = ", ".join(by)
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {column}) + (count(*) OVER (PARTITION BY {part}, {column}) - 1) / 2)"


def _corr(x: str, y: str) -> str:
    return f"(sum({x} * {y}) - sum({x}) * sum({y}) / count(*)) / nullif(sqrt(sum({x} * {x}) - sum({x}) ^ 2 / count(*)) * sqrt(sum({y} * {y}) - sum({y}) ^ 2 / count(*)), 0)"


RANKS = f"ranks AS (SELECT *, {avg_rank('score', 'pred_date')} AS rs, {avg_rank('target', 'pred_date')} AS rt FROM valid_predictions)"
DAILY = f"""{RANKS},
ics AS (SELECT pred_date, CASE WHEN count(*) >= 2 THEN {_corr('rs', 'rt')} END AS ic, count(*) AS n_valid FROM ranks GROUP BY 1),
placed AS (SELECT pred_date, target, row_number() OVER (PARTITION BY pred_date ORDER BY score, ticker) AS up, row_number() OVER (PARTITION BY pred_date ORDER BY score DESC, ticker DESC) AS down,
  count(*) OVER (PARTITION BY pred_date) AS n FROM valid_predictions),
sized AS (SELECT *, CASE WHEN n < {2 * N} THEN greatest(n // 4, 1) ELSE {N} END AS k FROM placed),
legs AS (SELECT pred_date, avg(target) FILTER (down <= k) AS top, avg(target) FILTER (up <= k) AS bottom FROM sized WHERE n >= 2 GROUP BY 1),
daily_m AS (SELECT pred_date, ic, CASE WHEN top > bottom THEN 1.0::DOUBLE WHEN top IS NOT NULL THEN 0.0 END AS hit_rate, top - bottom AS spread, coalesce(n_valid, 0) AS n_valid
  FROM (SELECT DISTINCT pred_date FROM predictions) LEFT JOIN ics USING (pred_date) LEFT JOIN legs USING (pred_date))"""


def daily(i: Inputs):
    return i._keep("daily_metrics", lambda: ranking.daily_metrics(i.predictions, top_n=N))


@query("met1_average_rank", f"WITH rounded AS (SELECT pred_date, ticker, {g('score', 1)} AS s FROM valid_predictions) SELECT pred_date, ticker, (rank() OVER (PARTITION BY pred_date ORDER BY s) + (count(*) OVER (PARTITION BY pred_date, s) - 1) / 2)::DOUBLE AS rank FROM rounded")
def _(i: Inputs):
    rows = ranking.valid_rows(i.predictions).select("pred_date", "ticker", grid("score", 1).alias("s"))
    return average_ranks(rows, ["pred_date"], {"s": "rank"}).select("pred_date", "ticker", "rank")


@query("met2_rank_ic", f"WITH {DAILY} SELECT pred_date, {gs('ic')}, n_valid AS n FROM ics")
def _(i: Inputs):
    return gridded(ranking.rank_ic(i.predictions), "pred_date n", "ic")


@query("met3_hit_rate", f"WITH {DAILY} SELECT pred_date, hit_rate FROM daily_m WHERE hit_rate IS NOT NULL")
def _(i: Inputs):
    return ranking.leg_spread(i.predictions, top_n=N).select("pred_date", "hit_rate")


@query("met4_long_short_spread", f"WITH {DAILY} SELECT pred_date, {gs('spread')} FROM daily_m WHERE spread IS NOT NULL")
def _(i: Inputs):
    return gridded(ranking.leg_spread(i.predictions, top_n=N), "pred_date", "spread")


@query("met5_daily_metrics", f"WITH {DAILY} SELECT pred_date, {gs('ic hit_rate spread')}, n_valid FROM daily_m")
def _(i: Inputs):
    return gridded(ranking.daily_metrics(i.predictions, top_n=N), "pred_date n_valid", "ic hit_rate spread")


AGG = "mean_ic ic_std ic_ir hit_rate mean_spread"


@query("met6_aggregate_metrics", f"""WITH {DAILY}, a AS (SELECT avg(ic) AS mean_ic, stddev_pop(ic) AS ic_std, avg(ic) / stddev_pop(ic) AS ic_ir, avg(hit_rate) AS hit_rate, avg(spread) AS mean_spread, count(ic) AS n_days FROM daily_m)
SELECT {gs(AGG)}, n_days FROM a""")
def _(i: Inputs):
    return gridded(ranking.aggregate_metrics(daily(i)), "n_days", AGG)


@query("met7_sector_ic", f"""WITH sectored AS (SELECT v.*, sector FROM valid_predictions v JOIN sectors USING (ticker)),
r AS (SELECT *, {avg_rank('score', 'pred_date', 'sector')} AS rs, {avg_rank('target', 'pred_date', 'sector')} AS rt FROM sectored),
i AS (SELECT pred_date, sector, {_corr('rs', 'rt')} AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT sector, {g('avg(ic)')} AS mean_ic, count(*) AS n_days FROM i WHERE ic IS NOT NULL GROUP BY 1""")
def _(i: Inputs):
    return gridded(ranking.sector_ic(i.predictions, i.sectors), "sector n_days", "mean_ic")


DIAG = "mean_ic ic_std se t_stat frac_pos frac_neg p05 p25 p50 p75 p95"
DIAG_SQL = f"""{DAILY}, d AS (SELECT count(ic) AS n, avg(ic) AS mean_ic, stddev_pop(ic) AS ic_std, stddev_pop(ic) / sqrt(count(ic)) AS se, avg(ic) / greatest(stddev_pop(ic) / sqrt(count(ic)), 1e-12) AS t_stat,
  count_if(ic > 0) / count(ic) AS frac_pos, count_if(ic < 0) / count(ic) AS frac_neg, {', '.join(f"quantile_cont(ic, {q}) AS p{q[2:]}" for q in ('0.05', '0.25', '0.50', '0.75', '0.95'))} FROM daily_m)"""


@query("met8_ic_diagnostics", f"WITH {DIAG_SQL} SELECT n, {gs(DIAG)} FROM d")
def _(i: Inputs):
    return gridded(ranking.ic_diagnostics(daily(i)), "n", DIAG)


@query("met9_half_year_ic", f"""WITH {DAILY} SELECT year(pred_date) || '-H' || CASE WHEN month(pred_date) <= 6 THEN '1' ELSE '2' END AS bucket, count(*) AS n, {g('avg(ic)')} AS mean_ic, {g('stddev_samp(ic)')} AS ic_std
FROM daily_m WHERE ic IS NOT NULL GROUP BY 1""")
def _(i: Inputs):
    return gridded(ranking.half_year_ic(daily(i)), "bucket n", "mean_ic ic_std")


SNAP = "min p10 p25 p50 p75 p90 max mean std iqr range_over_std"
SNAP_SQL = f"""scored AS (SELECT pred_date, score FROM predictions WHERE score IS NOT NULL),
days AS (SELECT pred_date, row_number() OVER (ORDER BY pred_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT pred_date FROM scored)),
snap AS (SELECT pred_date, count(*) AS n, min(score) AS min, max(score) AS max, avg(score) AS mean, stddev_pop(score) AS std, {', '.join(f"quantile_cont(score, 0.{q}) AS p{q}" for q in (10, 25, 50, 75, 90))}
  FROM scored WHERE pred_date IN (SELECT pred_date FROM days WHERE i IN (0, n // 2, n - 1)) GROUP BY 1),
snaps AS (SELECT *, p75 - p25 AS iqr, (max - min) / (std + 1e-12) AS range_over_std FROM snap)"""


@query("met10_score_snapshots", f"WITH {SNAP_SQL} SELECT pred_date, n, {gs(SNAP)} FROM snaps")
def _(i: Inputs):
    return gridded(ranking.score_snapshots(i.predictions.where("score is not null")), "pred_date n", SNAP)


@query("met11_verdict", f"""WITH {DIAG_SQL}, {SNAP_SQL} SELECT {g('mean_ic')} AS mean_ic, {g('t_stat')} AS t_stat, {g('r')} AS avg_range_over_std,
  CASE WHEN mean_ic IS NULL THEN 'NO DATA' WHEN abs(t_stat) < 2 THEN 'OVERFITTING' WHEN t_stat <= -2 THEN 'REGIME INVERSION' WHEN t_stat >= 3 AND mean_ic >= 0.05 THEN 'WORKING MODEL'
  WHEN t_stat >= 2 AND mean_ic >= 0.02 THEN 'WEAK SIGNAL' ELSE 'AMBIGUOUS' END AS verdict, r < 3 AS collapse_warning FROM d CROSS JOIN (SELECT avg(range_over_std) AS r FROM snaps)""")
def _(i: Inputs):
    out = ranking.verdict(ranking.ic_diagnostics(daily(i)), ranking.score_snapshots(i.predictions.where("score is not null")))
    return gridded(out, "verdict collapse_warning", "mean_ic t_stat avg_range_over_std")


# -- losses -----------------------------------------------------------------------------------


@query("met12_pearson_loss", f"""WITH p AS (SELECT pred_date, covar_pop(score, target) * count(*) / (sqrt(var_pop(score) * count(*)) * sqrt(var_pop(target) * count(*)) + 1e-8) AS ic FROM valid_predictions GROUP BY 1 HAVING count(*) >= 3)
SELECT {g('-avg(ic)', 5)} AS loss, count(*) AS n_dates FROM p""")
def _(i: Inputs):
    return gridded(losses.pearson_ic_loss(i.predictions), "n_dates", "loss", 5)


@query("met13_pairwise_hinge", f"""SELECT {g('sum(greatest(0.05::DOUBLE - (a.score - b.score), 0)) / count(*)', 5)} AS loss, count(*) AS n_pairs
FROM valid_predictions a JOIN valid_predictions b ON a.pred_date = b.pred_date AND a.target > b.target""")
def _(i: Inputs):
    return gridded(losses.pairwise_hinge_loss(i.predictions, 0.05), "n_pairs", "loss", 5)


@query("met14_listmle", f"""WITH t AS (SELECT pred_date, ln(sum(exp(score)) OVER (PARTITION BY pred_date ORDER BY target, ticker)) - score AS term FROM valid_predictions), d AS (SELECT pred_date, avg(term) AS l FROM t GROUP BY 1)
SELECT {g('avg(l)', 5)} AS loss, count(*) AS n_dates FROM d""")
def _(i: Inputs):
    return gridded(losses.listmle_loss(i.predictions), "n_dates", "loss", 5)


@query("met15_mse_and_weighted", f"""WITH m AS (SELECT avg((score - target) ^ 2) AS mse FROM valid_predictions), p AS (SELECT -avg(ic) AS l FROM (
  SELECT covar_pop(score, target) * count(*) / (sqrt(var_pop(score) * count(*)) * sqrt(var_pop(target) * count(*)) + 1e-8) AS ic FROM valid_predictions GROUP BY pred_date HAVING count(*) >= 3))
SELECT {g('mse', 5)} AS mse, {g('l', 5)} AS pearson, {g('0.3::DOUBLE * mse + 0.7::DOUBLE * l', 5)} AS total FROM m CROSS JOIN p""")
def _(i: Inputs):
    out = losses.weighted_loss({"mse": (losses.masked_mse(i.predictions), 0.3), "pearson": (losses.pearson_ic_loss(i.predictions), 0.7)})
    return out.select(*[grid(c, 5).alias(c) for c in ("mse", "pearson", "total")])


# -- paired series: IC by daily score (a) and by volatility (b) ----------------------------------


def _vol_ic(i: Inputs):
    return ranking.rank_ic(i.predictions.where("volatility is not null").withColumn("score", -F.col("volatility")))


PAIR_SQL = f"""{DAILY}, vol_rows AS (SELECT pred_date, -volatility AS v, target FROM predictions WHERE valid AND volatility IS NOT NULL AND target IS NOT NULL),
vol_ranks AS (SELECT pred_date, {avg_rank('v', 'pred_date')} AS rs, {avg_rank('target', 'pred_date')} AS rt FROM vol_rows),
vol_ics AS (SELECT pred_date, {_corr('rs', 'rt')} AS b FROM vol_ranks GROUP BY 1 HAVING count(*) >= 2),
pairs AS (SELECT pred_date, ic AS a, b FROM ics JOIN vol_ics USING (pred_date) WHERE ic IS NOT NULL AND b IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM pairs)"""


def pair(i: Inputs):
    a = ranking.rank_ic(i.predictions).select("pred_date", F.col("ic").alias("a"))
    b = _vol_ic(i).select("pred_date", F.col("ic").alias("b"))
    return i._keep("ic_pair", lambda: a.join(b, "pred_date"))


def student_sql(t: str, df: str) -> str:
    """Two-sided Student p-value of whole degrees of freedom; the products of the finite series as gamma functions."""
    theta = f"atan(abs({t}) / sqrt({df}::DOUBLE))"
    power = f"k * ln(greatest(cos({theta}) ^ 2, 1e-300))"
    even = f"(1 + coalesce(list_sum(list_transform(range(1, ({df} // 2)::BIGINT), lambda k: exp({power} + lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1::DOUBLE)))), 0))"
    odd = f"(1 + coalesce(list_sum(list_transform(range(1, (({df} - 1) // 2)::BIGINT), lambda k: exp({power} + lgamma(k + 1::DOUBLE) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE)))), 0))"
    return f"""greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN sin({theta}) * {even} WHEN {df} = 1 THEN 2 / pi() * {theta} ELSE 2 / pi() * ({theta} + sin({theta}) * cos({theta}) * {odd}) END)"""


@query("sig1_paired_t", f"WITH {PAIR_SQL} SELECT {g('m / (sd / sqrt(n))')} AS statistic, {g(student_sql('(m / (sd / sqrt(n)))', '(n - 1)'), 6)} AS pvalue, {g('m')} AS effect, n FROM stats")
def _(i: Inputs):
    out = significance.paired_t(pair(i))
    return out.select(grid("statistic").alias("statistic"), grid("pvalue", 6).alias("pvalue"), grid("effect").alias("effect"), "n")


NW_SQL = f"""{PAIR_SQL}, loss AS (SELECT pred_date, a * a - b * b AS d FROM pairs), cen AS (SELECT pred_date, d - avg(d) OVER () AS x, avg(d) OVER () AS m FROM loss),
lagged AS (SELECT x, m, x * lag(x, 1) OVER w AS p1, x * lag(x, 2) OVER w AS p2 FROM cen WINDOW w AS (ORDER BY pred_date)),
nw AS (SELECT greatest(avg(x * x) + 2 * (1 - 1 / 3::DOUBLE) * avg(p1) + 2 * (1 - 2 / 3::DOUBLE) * avg(p2), 0) AS variance, any_value(m) AS m, count(*) AS n FROM lagged)"""
T_NW = "abs(m / sqrt(variance / n)) / sqrt(2::DOUBLE)"
K = f"(1 / (1 + 0.3275911::DOUBLE * {T_NW}))"
POLY = f"((((1.061405429::DOUBLE * {K} - 1.453152027::DOUBLE) * {K} + 1.421413741::DOUBLE) * {K} - 0.284496736::DOUBLE) * {K} + 0.254829592::DOUBLE) * {K} * exp(-({T_NW}) * ({T_NW}))"


@query("sig2_diebold_mariano", f"WITH {NW_SQL} SELECT {g('m / sqrt(variance / n)')} AS statistic, {g(POLY)} AS pvalue, {g('m')} AS effect, n FROM nw")
def _(i: Inputs):
    return gridded(significance.diebold_mariano(pair(i), "pred_date", h=3), "n", "statistic pvalue effect")


@query("sig3_newey_west", f"WITH {NW_SQL} SELECT {g('variance', 6)} AS variance, n FROM nw")
def _(i: Inputs):
    rows = pair(i).where("a is not null and b is not null").withColumn("d", F.pow("a", 2) - F.pow("b", 2))
    return gridded(significance.newey_west_variance(rows, "d", "pred_date", 2), "n", "variance", 6)


@query("sig4_sharpe", f"SELECT ticker, {g('avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252)', 3)} AS sharpe FROM returns WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def _(i: Inputs):
    return gridded(i.returns.groupBy("ticker").agg(significance.sharpe(F.col("ret")).alias("sharpe")), "ticker", "sharpe", 3)


DRAWS, BLOCK = 200, 5
MIX = "((draw * 1000003 + blk * 7368787 + 1) % 2147483647)"
for _i in range(3):
    MIX = f"(({MIX} * 48271 + 1) % 2147483647)"


@query("sig5_bootstrap_sharpe", f"""WITH {PAIR_SQL}, seq AS (SELECT a, b, row_number() OVER (ORDER BY pred_date) - 1 AS i, count(*) OVER () AS n FROM pairs),
sizes AS (SELECT any_value(n) AS n, ceil(any_value(n) / {BLOCK})::BIGINT AS nb FROM seq),
plan AS (SELECT draw, blk, n, {MIX} % (n - {BLOCK} + 1) AS start FROM sizes CROSS JOIN (SELECT unnest(range(0, {DRAWS}))::BIGINT AS draw) CROSS JOIN LATERAL (SELECT unnest(range(0, nb))::BIGINT AS blk)),
idx AS (SELECT draw, start + o AS i FROM plan CROSS JOIN (SELECT unnest(range(0, {BLOCK})) AS o) WHERE blk * {BLOCK} + o < n),
per AS (SELECT draw, avg(a) / stddev_pop(a) * sqrt(252) - avg(b) / stddev_pop(b) * sqrt(252) AS diff FROM idx JOIN seq USING (i) GROUP BY 1)
SELECT {g('(SELECT avg(a) / stddev_pop(a) * sqrt(252) - avg(b) / stddev_pop(b) * sqrt(252) FROM seq)', 3)} AS statistic, {g('quantile_cont(diff, 0.025)', 3)} AS ci_low, {g('quantile_cont(diff, 0.975)', 3)} AS ci_high, (SELECT n FROM sizes) AS n FROM per""")
def _(i: Inputs):
    return gridded(significance.bootstrap_sharpe_difference(pair(i), "pred_date", DRAWS, BLOCK), "n", "statistic ci_low ci_high", 3)


def _a_and_s(z: str) -> str:
    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    k = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    return f"((((1.061405429::DOUBLE * {k} - 1.453152027::DOUBLE) * {k} + 1.421413741::DOUBLE) * {k} - 0.284496736::DOUBLE) * {k} + 0.254829592::DOUBLE) * {k} * exp(-{x} * {x})"


# one to five degrees of freedom, and up to those of ten years of days
FREEDOMS = [1, 2, 3, 4, 5, 30, 121, 500, 2500]


@query("sig6_pvalues", f"""WITH t AS (SELECT pred_date, ticker, score / volatility AS t, {FREEDOMS}[(month(pred_date) % 9 + 1)::INT] AS df FROM predictions WHERE score IS NOT NULL AND volatility > 0)
SELECT pred_date, ticker, df, {g(_a_and_s('t'))} AS p_normal, {g(student_sql('t', 'df'))} AS p_student FROM t""")
def _(i: Inputs):
    t = F.col("score") / F.col("volatility")
    df = F.element_at(F.lit(FREEDOMS), F.month("pred_date") % 9 + 1)
    rows = i.predictions.where("score is not null and volatility > 0").withColumn("df", df)
    return rows.select("pred_date", "ticker", "df", grid(normal_pvalue(t)).alias("p_normal"), grid(student_pvalue(t, F.col("df").cast("double"))).alias("p_student"))
