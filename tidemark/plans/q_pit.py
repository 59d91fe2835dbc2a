"""Membership in time and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, drift, macro, samples
from tidemark.operators.fundamental import METRICS, daily_fundamentals
from tidemark.plans.base import Inputs
from tidemark.plans.registry import g, grid, gridded, gs, query

# a date's snapshot: the latest at or before it
DAYS = "days AS (SELECT date, (SELECT max(snapshot_date) FROM snapshots WHERE snapshot_date <= date) AS snapshot_date FROM daily_calendar)"


@query("pit1_members_on", f"WITH {DAYS} SELECT date, snapshot_date, ticker FROM days JOIN roster USING (snapshot_date)")
def _(i: Inputs):
    return asof.members_on(i.daily_calendar, i.roster)


@query("pit1_membership_intervals", "SELECT ticker, snapshot_date AS valid_from, valid_to FROM roster JOIN snapshots USING (snapshot_date)")
def _(i: Inputs):
    return asof.membership_intervals(i.roster)


@query("pit2_ever_members", "SELECT DISTINCT ticker FROM roster")
def _(i: Inputs):
    return asof.ever_members(i.roster)


@query("pit3_member_counts", f"WITH {DAYS} SELECT date, count(*) AS n_members FROM days JOIN roster USING (snapshot_date) GROUP BY 1")
def _(i: Inputs):
    return asof.member_counts(i.daily_calendar, i.roster)


CHANGES = """changes AS (
  SELECT r.snapshot_date AS snapshot_date, ticker, 'added' AS action FROM roster r JOIN snapshots s USING (snapshot_date)
  WHERE previous IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster p WHERE p.snapshot_date = s.previous AND p.ticker = r.ticker)
  UNION ALL
  SELECT s.valid_to, ticker, 'removed' FROM roster r JOIN snapshots s USING (snapshot_date)
  WHERE valid_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster n WHERE n.snapshot_date = s.valid_to AND n.ticker = r.ticker))"""


@query("pit4_roster_changes", f"WITH {CHANGES} SELECT * FROM changes")
def _(i: Inputs):
    return asof.roster_changes(i.roster)


def _rebuilt(i: Inputs, compat: bool):
    changes = asof.roster_changes(i.roster).select("ticker", F.col("snapshot_date").alias("date"), "action")
    last = i.roster.agg(F.max("snapshot_date").alias("snapshot_date"))
    current = i.roster.join(last, "snapshot_date", "left_semi").select("ticker")
    return asof.roster_from_changes(current, changes, "2030-01-01", compat)


@query("pit5_rebuild_from_changes", """
SELECT snapshot_date, ticker FROM roster WHERE snapshot_date > (SELECT min(snapshot_date) FROM roster)
UNION ALL SELECT DATE '2030-01-01', ticker FROM roster WHERE snapshot_date = (SELECT max(snapshot_date) FROM roster)""")
def _(i: Inputs):
    return _rebuilt(i, False)


@query("pit5_rebuild_compat", """
SELECT valid_to AS snapshot_date, ticker FROM roster JOIN snapshots USING (snapshot_date) WHERE valid_to IS NOT NULL
UNION ALL SELECT DATE '2030-01-01', ticker FROM roster WHERE snapshot_date = (SELECT max(snapshot_date) FROM roster)""")
def _(i: Inputs):
    return _rebuilt(i, True)


@query("pit6_validate_roster", f"""WITH {CHANGES},
events AS (SELECT ticker, snapshot_date - 2 AS event_date FROM changes WHERE action = 'added'),
probes AS (SELECT ticker, event_date, (event_date + unnest(generate_series(-3, 3))::INT)::DATE AS d FROM events),
seen AS (SELECT DISTINCT p.ticker, event_date FROM probes p ASOF JOIN snapshots s ON p.d >= s.snapshot_date JOIN roster r ON r.ticker = p.ticker AND r.snapshot_date = s.snapshot_date)
SELECT 'missing_event' AS error, ticker, event_date AS date, NULL::BIGINT AS n_members FROM events ANTI JOIN seen USING (ticker, event_date)
UNION ALL SELECT 'implausible_count', NULL, snapshot_date, count(*) FROM roster WHERE year(snapshot_date) >= 1996 GROUP BY 3 HAVING count(*) NOT BETWEEN 65 AND 72""")
def _(i: Inputs):
    # additions announced two days ahead: within the tolerance, except where the first of the
    # month before still decides
    events = asof.roster_changes(i.roster).select("ticker", F.date_sub("snapshot_date", 2).alias("date"), "action")
    return asof.validate_roster(i.roster, events, 65, 72, 3, 1996)


@query("pit7_keep_members", f"WITH {DAYS} SELECT w.ticker, w.date, {g('adj_close')} AS adj_close FROM daily w JOIN days USING (date) SEMI JOIN roster r USING (snapshot_date, ticker)")
def _(i: Inputs):
    return asof.keep_members(i.daily.select("ticker", "date", "adj_close"), i.roster).select(
        "ticker", "date", grid("adj_close").alias("adj_close"))


FUND_DAILY = "fund_daily AS (SELECT d.ticker, d.date, d.adj_close AS price, " + ", ".join(f"f.{m}" for m in METRICS if m != "capex") + """,
  (SELECT arg_max(c.capex, c.date) FROM fund_wide c WHERE c.capex IS NOT NULL AND c.ticker = d.ticker AND c.date + 45 <= d.date) AS capex, f.back4
  FROM weekly d ASOF LEFT JOIN (SELECT *, date + 45 AS eff, lag(total_revenue, 4) OVER (PARTITION BY ticker ORDER BY date) AS back4 FROM fund_wide) f
  ON d.ticker = f.ticker AND d.date >= f.eff)"""


@query("pit8_fundamentals_as_of", f"WITH {FUND_DAILY} SELECT ticker, date, {gs(' '.join(METRICS), 1)} FROM fund_daily")
def _(i: Inputs):
    return gridded(daily_fundamentals(i.fundamentals, i.weekly), "ticker date", " ".join(METRICS), 1)


MACRO_SQL = """changes AS (SELECT series, date, CASE WHEN close > 0 AND lag(close, 5) OVER w > 0 THEN ln(close / lag(close, 5) OVER w) END AS ch
  FROM macro WINDOW w AS (PARTITION BY series ORDER BY date)),
months AS (SELECT pred_date FROM month_starts)"""


def _macro_column(name: str, series: str) -> str:
    value = f"(SELECT arg_max(row(ch), date) FROM changes c WHERE series = '{series}' AND c.date <= pred_date)[1]"
    return f"{g(f'CASE WHEN {value} IS NULL THEN 0 ELSE greatest(-1, least(1, {value})) END')} AS {name}"


@query("pit9_macro_features", f"WITH {MACRO_SQL} SELECT pred_date, " + ", ".join(
    _macro_column(n, s) for n, s in macro.MACRO_FEATURES.items()) + " FROM months")
def _(i: Inputs):
    return gridded(macro.macro_features(i.macro, i.month_starts), "pred_date", " ".join(macro.MACRO_FEATURES))


@query("mac1_attach_macro", f"""WITH {MACRO_SQL}, feats AS (SELECT pred_date, {_macro_column('vix_change_5d', 'vix')}, {_macro_column('spy_return_5d', 'spy')} FROM months)
SELECT w.date AS pred_date, w.ticker, vix_change_5d, spy_return_5d FROM weekly w JOIN feats ON w.date = feats.pred_date""")
def _(i: Inputs):
    feats = macro.macro_features(i.macro, i.month_starts)
    rows = i.weekly.select(F.col("date").alias("pred_date"), "ticker").join(i.month_starts, "pred_date", "left_semi")
    return gridded(macro.attach_macro(rows, feats), "pred_date ticker", "vix_change_5d spy_return_5d")


@query("pit11_sample_anchor", f"""WITH {DAYS.replace('daily_calendar', '(SELECT pred_date AS date FROM month_starts)')},
members AS (SELECT date AS pred_date, ticker FROM days JOIN roster USING (snapshot_date)),
numbered AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date)::INT AS rn FROM daily)
SELECT m.pred_date, m.ticker, n.date AS anchor_date, n.rn AS anchor_rn FROM members m ASOF JOIN numbered n ON m.ticker = n.ticker AND m.pred_date >= n.date""")
def _(i: Inputs):
    return asof.sample_anchor(i.month_starts, samples.with_row_number(i.daily_keys), i.roster)


@query("pit12_merge_groups", f"""
SELECT ticker, date, {g('a.ret')} AS x, {g('s.score')} AS y FROM (SELECT ticker, date, ret FROM returns WHERE ret IS NOT NULL) a
FULL JOIN (SELECT ticker, pred_date AS date, score FROM predictions WHERE valid) s USING (ticker, date)""")
def _(i: Inputs):
    a = i.returns.where("ret is not null").select("ticker", "date", F.col("ret").alias("x"))
    b = i.predictions.where("valid").select("ticker", F.col("pred_date").alias("date"), F.col("target").alias("x"), F.col("score").alias("y"))
    return gridded(asof.merge_groups([a, b]), "ticker date", "x y")


# -- filings on trading days ------------------------------------------------------------------

COS = "(1 - list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0))"
QOQ = COS.format(a="e.embedding", b="lag(e.embedding) OVER w")
YEAR_AGO = """(SELECT arg_max(p.embedding, p.period) FROM filing_embeddings p WHERE p.cik = e.cik AND p.form = e.form
  AND p.period BETWEEN e.period - 395 AND e.period - 270)"""
DRIFT_SQL = f"""yearly AS (SELECT *, {YEAR_AGO} AS year_ago FROM filing_embeddings e),
long AS (SELECT label, period, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM filing_embeddings),
peers AS (SELECT label, period, list(m ORDER BY k) AS peer FROM (SELECT label, period, k, avg(v) AS m FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2),
drift AS (SELECT e.*, {QOQ} AS drift_qoq, {COS.format(a='e.embedding', b='e.year_ago')} AS drift_yoy, {COS.format(a='e.embedding', b='p.peer')} AS drift_peer
  FROM yearly e JOIN peers p ON e.label = p.label AND e.period = p.period WINDOW w AS (PARTITION BY e.cik, e.form ORDER BY e.period))"""


def _drift(i: Inputs):
    # companies are runs of vectors here, so the sector is that of the filing
    return drift.drift_features(i.filing_embeddings, sectors="label")


@query("drf1_cosine_distance", f"""SELECT a.vec_id, {g(COS.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]'), 5)} AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(i: Inputs):
    from tidemark.functions.vectors import cosine_distance

    a = i.table("embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = i.table("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", grid(cosine_distance("x", "y"), 5).alias("distance"))


for _name, _column in (("drf2_drift_previous", "drift_qoq"), ("drf3_drift_year", "drift_yoy"), ("drf4_drift_peer", "drift_peer")):

    @query(_name, f"WITH {DRIFT_SQL} SELECT cik, form, period, accession, {g(_column, 5)} AS {_column} FROM drift")
    def _(i: Inputs, column: str = _column):
        return _drift(i).select("cik", "form", "period", "accession", grid(column, 5).alias(column))


@query("drf5_section_filter", "SELECT form, 0::BIGINT AS n_other, count(*) AS n_mda FROM filing_embeddings GROUP BY 1")
def _(i: Inputs):
    other = drift.drift_features(i.filing_embeddings, section="risk_factors").groupBy("form").agg(F.count(F.lit(1)).alias("n_other"))
    mda = drift.drift_features(i.filing_embeddings).groupBy("form").agg(F.count(F.lit(1)).alias("n_mda"))
    return mda.join(other, "form", "left").na.fill(0).select("form", "n_other", "n_mda")


DAILY_FILINGS = f"""{DRIFT_SQL},
sent AS (SELECT cik, period, form, (label - 4.5::DOUBLE) / 10 AS mean_score, label / 10::DOUBLE AS frac_negative FROM filing_embeddings WHERE label <> 3),
feats AS (SELECT d.cik, 'S' || (d.cik::INT) AS ticker, d.period, d.filing_date, d.form, drift_qoq, drift_yoy, mean_score, frac_negative
  FROM drift d LEFT JOIN sent s ON d.cik = s.cik AND d.period = s.period AND d.form = s.form),
days AS (SELECT ticker, date + 7300 AS date FROM daily)"""


def _filing_daily(effective: str) -> str:
    return f"""WITH {DAILY_FILINGS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, {effective} ORDER BY period DESC, form DESC, cik DESC) AS k FROM feats)
SELECT days.ticker, days.date, {gs('drift_qoq drift_yoy mean_score frac_negative', 5)} FROM days ASOF LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r
ON days.ticker = r.ticker AND days.date >= r.{effective}"""


for _effective in ("filing_date", "period"):

    @query(f"pit10_filing_features_by_{_effective}", _filing_daily(_effective))
    def _(i: Inputs, effective: str = _effective):
        d = drift.drift_features(i.filing_embeddings)
        e = i.filing_embeddings
        sent = e.where("label <> 3").select(
            "cik", "period", "form", ((F.col("label") - F.lit(4.5)) / 10).alias("mean_score"), (F.col("label") / F.lit(10.0)).alias("frac_negative"))
        ciks = e.select("cik").distinct().select(
            "cik", F.concat(F.lit("S"), F.col("cik").cast("int").cast("string")).alias("ticker"))
        days = i.daily.select("ticker", F.date_add("date", 7300).alias("date"))
        out = drift.filing_features_daily(d, sent, e, ciks, days, effective)
        return gridded(out, "ticker date", "drift_qoq drift_yoy mean_score frac_negative", 5)
