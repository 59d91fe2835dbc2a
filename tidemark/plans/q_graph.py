"""Similarity graphs, relations, neighbour features and centrality."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark.operators import centrality, fundamental, pairs, relations
from tidemark.plans.base import REGIONS, Inputs
from tidemark.plans.q_features import RATIO_SQL
from tidemark.plans.registry import g, grid, gridded, gs, query

W = 12
MONTHS = "months AS (SELECT pred_date, dn FROM month_starts)"


def _complete(w: int) -> str:
    return f"""complete AS (SELECT pred_date, r.ticker FROM months m JOIN returns r ON r.dn > m.dn - {w} AND r.dn <= m.dn WHERE ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = {w}),
cells AS (SELECT pred_date, r.ticker AS ticker, m.dn - r.dn AS age, ret FROM months m JOIN returns r ON r.dn > m.dn - {w} AND r.dn <= m.dn SEMI JOIN complete c ON c.pred_date = m.pred_date AND c.ticker = r.ticker)"""


def _rho(w: int) -> str:
    """Correlation over the last w rows from sums, so that it is null rather than an error when flat."""
    f = f"FILTER (a.age < {w})"
    x, y = "a.ret", "b.ret"
    sums = [f"sum({e}) {f}" for e in (x, y, f"{x} * {x}", f"{y} * {y}", f"{x} * {y}")]
    sx, sy, sxx, syy, sxy = sums
    return f"(({sxy}) - ({sx}) * ({sy}) / {w}) / nullif(sqrt(greatest(({sxx}) - ({sx}) ^ 2 / {w}, 0)) * sqrt(greatest(({syy}) - ({sy}) ^ 2 / {w}, 0)), 0)"


def corr_sql(w: int = W) -> str:
    return f"""{MONTHS}, {_complete(w)}, rhos AS (SELECT a.pred_date, a.ticker AS src, b.ticker AS dst, {_rho(w)} AS rho
  FROM cells a JOIN cells b ON a.pred_date = b.pred_date AND a.age = b.age AND a.ticker <> b.ticker GROUP BY 1, 2, 3)"""


CORR = corr_sql()
EDGES = f"{CORR}, edges AS (SELECT pred_date, src, dst, abs(rho) AS weight FROM rhos WHERE abs(rho) > 0.6)"


def betweenness(i: Inputs, pivots: int | None):
    """Over dates with edges. Copies of a window are linked with each other (their correlation is 1) and with the same others."""
    if "classes" not in i._stored:
        i._stored["classes"] = near(i)
    return centrality.betweenness_of_similar(i._stored["classes"], 0.6, nodes(i), pivots)


def near(i: Inputs, values=None, columns=()):
    """The pairs behind ``EDGES``, for what needs no list of them."""
    return pairs.correlations(i.returns, i.month_starts, W, values=values, columns=columns)


def nodes(i: Inputs):
    """Tickers with a bar on the prediction date."""
    return i.weekly.select(F.col("date").alias("pred_date"), "ticker").join(i.month_starts, "pred_date", "left_semi")


NODES = "nodes AS (SELECT m.pred_date, m.dn, w.ticker FROM months m JOIN weekly w ON w.date = m.pred_date)"


@query("grf1_log_returns", f"SELECT ticker, date, dn, {gs('ret', 5)} FROM returns")
def _(i: Inputs):
    return gridded(pairs.daily_log_returns(i.weekly, i.calendar), "ticker date dn", "ret", 5)


@query("grf2_correlation_windows", f"WITH {MONTHS}, {_complete(W)} SELECT pred_date, ticker, count(*)::INT AS n, {g('sum(ret)')} AS total FROM cells GROUP BY 1, 2")
def _(i: Inputs):
    vec = pairs.return_windows(i.returns, i.month_starts, [W])
    return vec.select("pred_date", "ticker", F.size("vec").alias("n"), grid(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("grf2_correlation_edges", f"WITH {EDGES} SELECT pred_date, src, dst, {gs('weight')} FROM edges")
def _(i: Inputs):
    return gridded(pairs.correlation_edges(i.returns, i.month_starts, W, 0.6), "pred_date src dst", "weight")


MULTI = f"""{MONTHS}, {_complete(W)}, rhos AS (SELECT a.pred_date, a.ticker AS src, b.ticker AS dst, {_rho(6)} AS r6, {_rho(9)} AS r9, {_rho(W)} AS r12
  FROM cells a JOIN cells b ON a.pred_date = b.pred_date AND a.age = b.age AND a.ticker <> b.ticker GROUP BY 1, 2, 3),
robust AS (SELECT pred_date, src, dst, sign(r12) * least(abs(r6), abs(r9), abs(r12)) AS rho FROM rhos WHERE r6 IS NOT NULL AND r9 IS NOT NULL AND r12 IS NOT NULL)"""


@query("grf3_multi_window_edges", f"WITH {MULTI} SELECT pred_date, src, dst, {g('rho')} AS weight FROM robust WHERE rho > 0.4")
def _(i: Inputs):
    e = pairs.correlation_edges(i.returns, i.month_starts, threshold=0.4, use_absolute=False, multi_windows=[6, 9, W])
    return gridded(e, "pred_date src dst", "weight")


@query("grf4_inverse_vol_edges", f"""WITH {CORR}, vols AS (SELECT pred_date, ticker, greatest(stddev_pop(ret), 1e-8) AS vol FROM cells GROUP BY 1, 2),
stab AS (SELECT pred_date, ticker, least(greatest(median(vol) OVER (PARTITION BY pred_date) / vol, 0), 1) AS s FROM vols),
weighted AS (SELECT r.pred_date, src, dst, abs(rho) * sqrt(a.s * b.s) AS weight FROM rhos r JOIN stab a ON a.pred_date = r.pred_date AND a.ticker = src JOIN stab b ON b.pred_date = r.pred_date AND b.ticker = dst)
SELECT pred_date, src, dst, {gs('weight')} FROM weighted WHERE weight > 0.5""")
def _(i: Inputs):
    return gridded(pairs.correlation_edges(i.returns, i.month_starts, W, 0.5, inverse_vol=True), "pred_date src dst", "weight")


@query("grf5_signed_threshold", f"WITH {CORR} SELECT pred_date, src, dst, {g('rho')} AS weight FROM rhos WHERE rho > 0.65")
def _(i: Inputs):
    return gridded(pairs.correlation_edges(i.returns, i.month_starts, W, 0.65, use_absolute=False), "pred_date src dst", "weight")


@query("grf6_top_k_edges", f"""WITH {CORR} SELECT pred_date, src, dst, {g('abs(rho)')} AS weight FROM rhos WHERE rho IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY pred_date, src ORDER BY abs(rho) DESC, dst) <= 3""")
def _(i: Inputs):
    return gridded(pairs.correlation_edges(i.returns, i.month_starts, W, None, top_k=3), "pred_date src dst", "weight")


@query("grf7_self_loops", f"WITH {EDGES}, {NODES}, looped AS (SELECT pred_date, src, dst FROM edges UNION ALL SELECT pred_date, ticker, ticker FROM nodes) SELECT pred_date, count(*) AS n_edges, count_if(src = dst) AS n_loops FROM looped GROUP BY 1")
def _(i: Inputs):
    return pairs.edge_counts(near(i), 0.6, nodes(i))


@query("grf8_all_dates", f"WITH {corr_sql(8).replace('months AS (SELECT pred_date, dn FROM month_starts)', 'months AS (SELECT date AS pred_date, dn FROM calendar)')} SELECT pred_date, count_if(abs(rho) > 0.8) AS n_edges FROM rhos GROUP BY 1 HAVING count_if(abs(rho) > 0.8) > 0")
def _(i: Inputs):
    every = i.calendar.select(F.col("date").alias("pred_date"), "dn")
    return pairs.edge_counts(pairs.correlations(i.returns, every, 8), 0.8).drop("n_loops")


GROUPED = f"{MONTHS}, {NODES}, grouped AS (SELECT pred_date, sector, ticker, count(*) OVER (PARTITION BY pred_date, sector) - 1 AS degree FROM nodes JOIN sectors USING (ticker))"


@query("grf9_sector_relation", f"WITH {GROUPED} SELECT pred_date, sector, ticker, degree, 1.0::DOUBLE AS weight FROM grouped WHERE degree >= 1")
def _(i: Inputs):
    return relations.sector_relation(nodes(i), i.sectors)


@query("grf9_sector_links", f"""WITH {GROUPED}, firsts AS (SELECT pred_date, sector, min(ticker) AS src FROM grouped WHERE degree >= 1 GROUP BY 1, 2)
SELECT pred_date, src, g.ticker AS dst, 1.0::DOUBLE AS weight FROM firsts JOIN grouped g USING (pred_date, sector) WHERE g.ticker <> src""")
def _(i: Inputs):
    rel = relations.sector_relation(nodes(i), i.sectors)
    chosen = rel.groupBy("pred_date", "sector").agg(F.min("ticker").alias("ticker"))
    return relations.sector_links(rel, chosen)


COSINE_COLUMNS = ["log_market_cap", "pb", "de", "roe", "fcf_yield"]
COSINE = f"""{RATIO_SQL}, {MONTHS}, raw AS (SELECT date AS pred_date, ticker, {', '.join(COSINE_COLUMNS)} FROM ratios WHERE date IN (SELECT pred_date FROM months)),
z AS (SELECT pred_date, ticker, [{', '.join(f"coalesce(({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0), 0)" for c in COSINE_COLUMNS)}] AS v,
  {' + '.join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in COSINE_COLUMNS)} AS known FROM raw WINDOW d AS (PARTITION BY pred_date)),
sims AS (SELECT a.pred_date, a.ticker AS src, b.ticker AS dst, coalesce(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 0) AS sim
  FROM z a JOIN z b ON a.pred_date = b.pred_date AND a.ticker <> b.ticker WHERE a.known >= 2 AND b.known >= 2)"""


def _vectors(i: Inputs):
    ratios = fundamental.fundamental_ratios(fundamental.daily_fundamentals(i.fundamentals, i.weekly))
    rows = ratios.join(i.month_starts.select(F.col("pred_date").alias("date")), "date", "left_semi")
    return fundamental.cross_section_zscore(rows, COSINE_COLUMNS).withColumnRenamed("date", "pred_date")


@query("grf10_fundamental_edges", f"WITH {COSINE[5:]} SELECT pred_date, src, dst, {g('sim')} AS weight FROM sims WHERE sim > 0.9")
def _(i: Inputs):
    return gridded(pairs.cosine_edges(_vectors(i), COSINE_COLUMNS, 0.9), "pred_date src dst", "weight")


@query("grf10_fundamental_top_k", f"""WITH {COSINE[5:]} SELECT pred_date, src, dst, {g('sim')} AS weight FROM sims QUALIFY row_number() OVER (PARTITION BY pred_date, src ORDER BY sim DESC, dst) <= 2""")
def _(i: Inputs):
    return gridded(pairs.cosine_edges(_vectors(i), COSINE_COLUMNS, None, top_k=2), "pred_date src dst", "weight")


REGION_LIST = ", ".join(f"('{r}')" for r in REGIONS)
HIERARCHY = f"""{MONTHS}, {NODES}, names(sector) AS (VALUES {REGION_LIST}),
up AS (SELECT pred_date, 'stock_sector' AS edge_type, ticker AS src, sector AS dst FROM nodes JOIN sectors USING (ticker)
  UNION ALL SELECT pred_date, 'sector_market', sector, 'Market' FROM months CROSS JOIN names WHERE pred_date IN (SELECT pred_date FROM nodes)),
hier AS (SELECT * FROM up UNION ALL SELECT pred_date, CASE edge_type WHEN 'stock_sector' THEN 'sector_stock' ELSE 'market_sector' END, dst, src FROM up)"""


@query("grf11_hierarchy_edges", f"WITH {HIERARCHY} SELECT *, 1.0::DOUBLE AS weight FROM hier")
def _(i: Inputs):
    return relations.hierarchy_edges(nodes(i), i.sectors, REGIONS)


@query("grf12_feature_roll_up", f"""WITH {MONTHS}, names(sector) AS (VALUES {REGION_LIST}),
stock AS (SELECT pred_date, ticker, coalesce(score, 0) AS a, coalesce(volatility, 0) AS b FROM predictions SEMI JOIN months USING (pred_date)),
filled AS (SELECT pred_date, sector, coalesce(avg(s.a), 0) AS a, coalesce(avg(s.b), 0) AS b FROM (SELECT DISTINCT pred_date FROM stock) CROSS JOIN names
  LEFT JOIN (SELECT * FROM stock JOIN sectors USING (ticker) WHERE a * a + b * b > 0) s USING (pred_date, sector) GROUP BY 1, 2),
market AS (SELECT pred_date, coalesce(avg(a) FILTER (a * a + b * b > 0), 0) AS a, coalesce(avg(b) FILTER (a * a + b * b > 0), 0) AS b FROM filled GROUP BY 1),
everything AS (SELECT pred_date, 'stock' AS level, ticker AS node, a, b, a * a + b * b > 0 AS present FROM stock
  UNION ALL SELECT pred_date, 'sector', sector, a, b, true FROM filled UNION ALL SELECT pred_date, 'market', 'Market', a, b, true FROM market)
SELECT pred_date, level, node, present, {gs('a b', 5)} FROM everything""")
def _(i: Inputs):
    rows = i.predictions.join(i.month_starts, "pred_date", "left_semi").select("pred_date", "ticker", F.col("score").alias("a"), F.col("volatility").alias("b"))
    return gridded(relations.roll_up_features(rows, i.sectors, ["a", "b"], REGIONS), "pred_date level node present", "a b", 5)


@query("grf13_assembled_graph", f"""WITH {EDGES}, {HIERARCHY[len(MONTHS) + 2:]}, grouped AS (SELECT pred_date, sector, ticker, count(*) OVER (PARTITION BY pred_date, sector) AS n FROM nodes JOIN sectors USING (ticker)),
everything AS (SELECT pred_date, 'correlation' AS edge_type FROM edges UNION ALL SELECT pred_date, edge_type FROM hier UNION ALL SELECT pred_date, 'same_sector' FROM grouped WHERE n >= 2)
SELECT pred_date, edge_type, count(*) AS n_edges FROM everything GROUP BY 1, 2""")
def _(i: Inputs):
    return relations.graph_sizes({
        "fundamental": None, "sector": relations.sector_relation(nodes(i), i.sectors),
        "hierarchy": relations.hierarchy_edges(nodes(i), i.sectors, REGIONS)}, i.month_starts,
        {"correlation": pairs.edge_counts(near(i), 0.6)})


@query("grf14_degree", f"WITH {EDGES}, {NODES} SELECT n.pred_date, n.ticker, count(e.dst) AS degree FROM nodes n LEFT JOIN edges e ON e.pred_date = n.pred_date AND e.src = n.ticker GROUP BY 1, 2")
def _(i: Inputs):
    sums = near(i).neighbor_sums(0.6, only=()).select("pred_date", "ticker", "degree")
    return nodes(i).join(sums, ["pred_date", "ticker"], "left").na.fill(0, ["degree"])


RECENT = """recent AS (SELECT pred_date, r.ticker AS ticker, avg(ret) AS recent FROM months m JOIN returns r ON r.dn > m.dn - 5 AND r.dn <= m.dn WHERE ret IS NOT NULL GROUP BY 1, 2)"""


@query("grf15_neighbor_return", f"""WITH {EDGES}, {NODES}, {RECENT}
SELECT n.pred_date, n.ticker, {g('coalesce(avg(r.recent), 0)', 5)} AS avg_neighbor_return FROM nodes n LEFT JOIN edges e ON e.pred_date = n.pred_date AND e.src = n.ticker
LEFT JOIN (SELECT r.* FROM recent r SEMI JOIN nodes k USING (pred_date, ticker)) r ON r.pred_date = e.pred_date AND r.ticker = e.dst GROUP BY 1, 2""")
def _(i: Inputs):
    f = relations.near_features(partial(near, i), 0.6, nodes(i), i.returns, i.month_starts, i.sectors)
    return f.select(F.col("date").alias("pred_date"), "ticker", grid("avg_neighbor_return", 5).alias("avg_neighbor_return"))


@query("grf16_sector_momentum", f"""WITH {MONTHS}, {NODES}, {RECENT}, rows_ AS (SELECT n.pred_date, n.ticker, sector, recent FROM nodes n LEFT JOIN recent r USING (pred_date, ticker) JOIN sectors USING (ticker))
SELECT pred_date, ticker, {g('coalesce((sum(recent) OVER s - recent) / nullif(count(recent) OVER s - 1, 0), 0)', 5)} AS sector_momentum FROM rows_ WINDOW s AS (PARTITION BY pred_date, sector)""")
def _(i: Inputs):
    recent = nodes(i).join(relations.recent_mean_return(i.returns, i.month_starts), ["pred_date", "ticker"], "left")
    return gridded(relations.sector_neighbor_mean(recent, i.sectors, "recent", "sector_momentum"), "pred_date ticker", "sector_momentum", 5)


# every search advances one level per step; a step sees the level before it and the one before that,
# which is where neighbours can lie, as edges go both ways
PATHS = f"""{EDGES.replace("edges AS (", "edges AS MATERIALIZED (")}, {NODES},
members AS (SELECT pred_date, ticker FROM nodes SEMI JOIN edges USING (pred_date)),
paths(pred_date, s, v, d, sigma, step) AS (
  SELECT pred_date, ticker, ticker, 0, 1::DOUBLE, 0 FROM members
  UNION ALL (
    WITH ahead AS (
      SELECT w.pred_date, w.s, e.dst AS v, w.step + 1 AS d, sum(w.sigma) AS sigma, w.step + 1 AS step FROM paths w JOIN edges e ON e.pred_date = w.pred_date AND e.src = w.v AND w.d = w.step
      WHERE NOT EXISTS (SELECT 1 FROM paths x WHERE x.pred_date = w.pred_date AND x.s = w.s AND x.v = e.dst) GROUP BY ALL)
    SELECT * FROM ahead UNION ALL SELECT pred_date, s, v, d, sigma, step + 1 FROM paths WHERE d = step)),
reach AS MATERIALIZED (SELECT DISTINCT pred_date, s, v, d, sigma FROM paths),
through AS (SELECT a.pred_date, a.v, sum(a.sigma * b.sigma / c.sigma) AS b FROM reach a JOIN reach b ON b.pred_date = a.pred_date AND b.s = a.v AND b.d > 0 AND a.d > 0
  JOIN reach c ON c.pred_date = a.pred_date AND c.s = a.s AND c.v = b.v AND c.d = a.d + b.d GROUP BY 1, 2),
counted AS (SELECT pred_date, count(*) AS n FROM members GROUP BY 1)"""


@query("grf17_betweenness_exact", f"""WITH RECURSIVE {PATHS}
SELECT m.pred_date, m.ticker, {g('coalesce(t.b / nullif((n - 1) * (n - 2), 0), 0)', 6)} AS betweenness_centrality
FROM members m JOIN counted USING (pred_date) LEFT JOIN through t ON t.pred_date = m.pred_date AND t.v = m.ticker""")
def _(i: Inputs):
    return gridded(betweenness(i, None), "pred_date ticker", "betweenness_centrality", 6)


SOURCES = """starts AS (SELECT pred_date, ticker FROM members QUALIFY row_number() OVER (PARTITION BY pred_date ORDER BY md5(ticker), ticker) <= 50),
used AS (SELECT pred_date, count(*) AS k FROM starts GROUP BY 1)"""


@query("grf17_betweenness", f"""WITH RECURSIVE {PATHS.replace("through AS (", SOURCES + ", through AS (").replace("FROM reach a JOIN", "FROM (SELECT r.* FROM reach r SEMI JOIN starts t ON t.pred_date = r.pred_date AND t.ticker = r.s) a JOIN")}
SELECT m.pred_date, m.ticker, {g('coalesce(t.b * n / k / nullif((n - 1) * (n - 2), 0), 0)', 6)} AS betweenness_centrality
FROM members m JOIN counted USING (pred_date) JOIN used USING (pred_date) LEFT JOIN through t ON t.pred_date = m.pred_date AND t.v = m.ticker""")
def _(i: Inputs):
    return gridded(betweenness(i, 50), "pred_date ticker", "betweenness_centrality", 6)


@query("grf18_neighbor_mean", f"WITH {EDGES}, v AS (SELECT pred_date, ticker, score, volatility FROM predictions) SELECT e.pred_date, src AS ticker, {g('avg(score)')} AS score, {g('avg(volatility)')} AS volatility FROM edges e JOIN v ON v.pred_date = e.pred_date AND v.ticker = dst GROUP BY 1, 2")
def _(i: Inputs):
    out = relations.near_mean(near(i, i.predictions, ["score", "volatility"]), 0.6, ["score", "volatility"])
    return gridded(out, "pred_date ticker", "score volatility")


@query("grf18_weighted_neighbor_mean", f"WITH {EDGES}, v AS (SELECT pred_date, ticker, score FROM predictions) SELECT e.pred_date, src AS ticker, {g('sum(weight * score) / sum(weight) FILTER (score IS NOT NULL)')} AS score FROM edges e JOIN v ON v.pred_date = e.pred_date AND v.ticker = dst GROUP BY 1, 2")
def _(i: Inputs):
    return gridded(relations.near_mean(near(i, i.predictions, ["score"]), 0.6, ["score"], weighted=True), "pred_date ticker", "score")


@query("grf18_normalised_sum", f"""WITH {EDGES}, v AS (SELECT pred_date, ticker, score FROM predictions SEMI JOIN months USING (pred_date)),
looped AS (SELECT pred_date, src, dst, weight FROM edges UNION ALL SELECT pred_date, ticker, ticker, 1 FROM v), d AS (SELECT pred_date, src, sum(weight) AS d FROM looped GROUP BY 1, 2)
SELECT l.pred_date, l.src AS ticker, {g('sum(l.weight * v.score / sqrt(b.d)) / sqrt(any_value(a.d))')} AS score FROM looped l JOIN v ON v.pred_date = l.pred_date AND v.ticker = l.dst
JOIN d a ON a.pred_date = l.pred_date AND a.src = l.src JOIN d b ON b.pred_date = l.pred_date AND b.src = l.dst GROUP BY 1, 2""")
def _(i: Inputs):
    v = i.predictions.join(i.month_starts, "pred_date", "left_semi").select("pred_date", "ticker", "score")
    return gridded(relations.near_normalised_sum(partial(near, i), 0.6, v, ["score"]), "pred_date ticker", "score")


@query("grf19_density_sweep", f"""WITH {CORR.replace('rhos', 'rhos12').replace('cells', 'cells12').replace('complete', 'complete12')},
{', '.join(x for x in corr_sql(8).split(MONTHS + ', ')[1:]).replace('rhos', 'rhos8').replace('cells', 'cells8').replace('complete', 'complete8')},
both_ AS (SELECT 12 AS lookback, * FROM rhos12 UNION ALL SELECT 8, * FROM rhos8),
kept AS (SELECT * FROM both_ WHERE abs(rho) > 0.5), days AS (SELECT DISTINCT pred_date, lookback FROM kept),
sources AS (SELECT pred_date, lookback, src, count(rho) AS n FROM both_ GROUP BY 1, 2, 3)
SELECT pred_date, lookback, 'tau_' || t AS setting, count_if(abs(rho) > t::DOUBLE) AS n_edges FROM kept CROSS JOIN (VALUES ('0.5'), ('0.7')) s(t) GROUP BY 1, 2, 3
UNION ALL SELECT pred_date, lookback, 'top_' || k, sum(least(n, k))::BIGINT FROM sources CROSS JOIN (VALUES (2), (5)) s(k) GROUP BY 1, 2, 3""")
def _(i: Inputs):
    return pairs.edge_density(i.returns, i.month_starts, [8, W], [0.5, 0.7], [2, 5])
