"""Sources on bars, cleaning, calendars, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, calendar, clean
from tidemark.operators.relations import encode_sectors, fixed_sector_index
from tidemark.plans.base import REGIONS, Inputs
from tidemark.plans.registry import g, grid, gridded, gs, query
from tidemark.session import new_path
from tidemark.sources import readers, sinks

OHLC = "open high low close adj_close"


@query("src1_price_scan", f"SELECT ticker, date, {gs(OHLC)}, volume, dividends, stock_splits FROM daily")
def _(i: Inputs):
    path = new_path(i.spark, "bars")
    sinks.write_by_ticker(i.daily, path, buckets=8)
    df = readers.read_prices(i.spark, path)
    return df.select("ticker", "date", *[grid(c).alias(c) for c in OHLC.split()], "volume", "dividends", "stock_splits")


@query("src2_vendor_bars", f"SELECT ticker, date, {gs(OHLC)}, volume, dividends, stock_splits FROM weekly_raw")
def _(i: Inputs):
    vendor = i.weekly_raw.drop("dividends", "stock_splits").withColumnsRenamed(
        {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Adj Close", "volume": "Volume", "ticker": "Ticker"})
    df = readers.normalise_vendor_bars(vendor.withColumn("Date", F.col("Date").cast("timestamp")))
    return df.select("ticker", "date", *[grid(c).alias(c) for c in OHLC.split()], "volume", "dividends", "stock_splits")


@query("snk1_table_sink", "SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM weekly GROUP BY 1")
def _(i: Inputs):
    path = new_path(i.spark, "weekly_by_ticker")
    sinks.write_by_ticker(i.weekly, path, buckets=8)
    return i.spark.read.parquet(path).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


TRADES = f"""trades AS (
  SELECT 'S' || l_suppkey AS ticker, l_shipdate::DATE AS date, 100 + l_extendedprice / 10000 AS adj_close,
         CASE WHEN l_quantity = 7 THEN NULL ELSE l_quantity END AS close, (l_orderkey * 8 + l_linenumber) * 100000000 + floor(l_extendedprice * 100 + 0.5)::BIGINT AS k FROM lineitem),
deduped AS (SELECT ticker, date, arg_min(row(adj_close, close), k) AS r FROM trades GROUP BY 1, 2)"""


def trades(i: Inputs):
    """Line items as duplicate-ridden bars, a few without close."""
    return i.table("lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"),
        (100 + F.col("l_extendedprice") / 10000).alias("adj_close"),
        F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("close"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5))).alias("k"))


@query("cln1_drop_duplicates", f"WITH {TRADES} SELECT ticker, date, {g('r[1]')} AS adj_close, r[2]::DOUBLE AS close FROM deduped")
def _(i: Inputs):
    df = clean.drop_duplicates(trades(i), ["k"])
    return df.select("ticker", "date", grid("adj_close").alias("adj_close"), "close")


@query("cln2_drop_missing", f"WITH {TRADES} SELECT ticker, count(*) AS n FROM deduped WHERE r[2] IS NOT NULL GROUP BY 1")
def _(i: Inputs):
    df = clean.drop_missing_prices(clean.drop_duplicates(trades(i), ["k"]))
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


SPIKES = """moves AS (
  SELECT *, ln(adj_close) - ln(lag(adj_close) OVER w) AS r0, ln(lead(adj_close) OVER w) - ln(adj_close) AS r1
  FROM daily WINDOW w AS (PARTITION BY ticker ORDER BY date)),
flagged AS (SELECT *, coalesce(abs(r0) > 0.06 AND abs(r1) > 0.03 AND sign(r0) * sign(r1) < 0, false) AS spike FROM moves)"""


@query("cln3_revert_spikes", f"WITH {SPIKES} SELECT ticker, date, spike FROM flagged")
def _(i: Inputs):
    return clean.flag_revert_spikes(i.daily, 0.06).select("ticker", "date", "spike")


@query("cln4_remove_spikes", f"WITH {SPIKES} SELECT ticker, date, {g('adj_close')} AS adj_close FROM flagged WHERE NOT spike")
def _(i: Inputs):
    return clean.remove_revert_spikes(i.daily, 0.06).select("ticker", "date", grid("adj_close").alias("adj_close"))


@query("cln5_fill_gaps", f"SELECT ticker, date, filled, {gs(OHLC)}, volume FROM weekly")
def _(i: Inputs):
    df = clean.fill_small_gaps(i.weekly_raw, i.calendar, 2)
    return df.select("ticker", "date", "filled", *[grid(c).alias(c) for c in OHLC.split()], "volume")


BUSINESS = """spine AS (
  SELECT ticker, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (
    SELECT ticker, min(date) AS lo, max(date) AS hi FROM daily WHERE isodow(date) < 6 GROUP BY 1)),
gridded AS (SELECT s.ticker, s.date, d.close, d.volume, count(d.close) OVER (PARTITION BY s.ticker ORDER BY s.date) AS grp
  FROM spine s LEFT JOIN daily d USING (ticker, date) WHERE isodow(s.date) < 6),
runs AS (SELECT ticker, date, close IS NULL AS filled, first_value(close) OVER (PARTITION BY ticker, grp ORDER BY date) AS close,
  volume, count(*) OVER (PARTITION BY ticker, grp) - 1 AS run FROM gridded)"""


@query("cln5_fill_gaps_business_days", f"""WITH {BUSINESS}
SELECT ticker, date, filled, {g('close')} AS close, 0.0::DOUBLE AS volume FROM runs WHERE NOT filled OR run <= 2""")
def _(i: Inputs):
    df = clean.fill_small_gaps(i.daily, None, 2, compat_zero_volume=True)
    return df.select("ticker", "date", "filled", grid("close").alias("close"), "volume")


@query("cln6_calendar_filter", "SELECT ticker, count(*) AS n FROM daily WHERE date IN (SELECT date FROM calendar) GROUP BY 1")
def _(i: Inputs):
    return clean_counts(calendar.keep_calendar_dates(i.daily, i.calendar))


def clean_counts(df):
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("cln7_ticker_aliases", "SELECT CASE ticker WHEN 'S1' THEN 'S0' WHEN 'S2' THEN 'NEW' ELSE ticker END AS ticker, count(*) AS n FROM daily GROUP BY 1")
def _(i: Inputs):
    return clean_counts(clean.apply_ticker_aliases(i.daily, {"s1": "S0", "S2": "NEW"}))


CLEAN_STEPS = f"""{TRADES},
priced AS (SELECT ticker, date, r[1] AS adj_close, r[2] AS close FROM deduped WHERE r[2] IS NOT NULL),
moves AS (SELECT *, ln(adj_close) - ln(lag(adj_close) OVER w) AS r0, ln(lead(adj_close) OVER w) - ln(adj_close) AS r1
  FROM priced WINDOW w AS (PARTITION BY ticker ORDER BY date)),
kept AS (SELECT ticker, date, adj_close, coalesce(abs(r0) > 0.06 AND abs(r1) > 0.03 AND sign(r0) * sign(r1) < 0, false) AS spike FROM moves),
present AS (SELECT k.*, c.dn, lead(c.dn) OVER (PARTITION BY ticker ORDER BY c.dn) AS nxt, (SELECT max(dn) FROM daily_calendar) AS last
  FROM kept k JOIN daily_calendar c USING (date) WHERE NOT spike),
gaps AS (SELECT *, coalesce(nxt, last + 1) - dn - 1 AS gap FROM present)"""


def _daily_calendar(i: Inputs):
    return i.daily_calendar


@query("cln8_clean_bars", f"""WITH {CLEAN_STEPS},
filled AS (SELECT ticker, adj_close, dn + unnest(generate_series(0, CASE WHEN gap <= 2 THEN gap ELSE 0 END)) AS dn FROM gaps),
named AS (SELECT CASE ticker WHEN 'S1' THEN 'S0' ELSE ticker END AS name, ticker, dn, adj_close FROM filled)
SELECT name AS ticker, date, {g('arg_min(adj_close, named.ticker)')} AS adj_close FROM named JOIN daily_calendar USING (dn) GROUP BY 1, 2""")
def _(i: Inputs):
    df = clean.clean_bars(trades(i), ["k"], _daily_calendar(i), 0.06, 2, {"S1": "S0"})
    return df.select("ticker", "date", grid("adj_close").alias("adj_close"))


@query("cln8_cleaning_report", f"""WITH {CLEAN_STEPS},
a AS (SELECT ticker, count(*) AS rows_in FROM trades GROUP BY 1), b AS (SELECT ticker, count(*) AS d FROM deduped GROUP BY 1),
c AS (SELECT ticker, count(*) AS p, count_if(spike) AS spikes FROM kept GROUP BY 1),
e AS (SELECT ticker, sum(CASE WHEN gap <= 2 THEN gap ELSE 0 END)::BIGINT AS added, count(*) AS n FROM gaps GROUP BY 1)
SELECT a.ticker, rows_in, rows_in - d AS duplicates, d - p AS missing_prices, spikes, added AS gap_rows_added, n + added AS rows_out
FROM a JOIN b USING (ticker) JOIN c USING (ticker) JOIN e USING (ticker)""")
def _(i: Inputs):
    return clean.cleaning_report(trades(i), ["k"], _daily_calendar(i), 0.06, 2)


@query("cln9_trading_calendar", "SELECT date, dn FROM daily_calendar")
def _(i: Inputs):
    return calendar.trading_calendar(i.daily).select("date", "dn")


@query("cln10_business_days", """SELECT ticker, count(*) AS n FROM (
  SELECT ticker, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM (SELECT ticker, min(date) AS lo, max(date) AS hi FROM daily GROUP BY 1))
WHERE isodow(d) < 6 GROUP BY 1""")
def _(i: Inputs):
    spans = i.daily.groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return clean_counts(calendar.business_days(spans))


@query("prj1_ticker_universe", "SELECT DISTINCT ticker FROM roster SEMI JOIN weekly USING (ticker)")
def _(i: Inputs):
    return asof.ticker_universe(i.traded, i.roster)


@query("prj2_sector_codes", "SELECT ticker, sector, dense_rank() OVER (ORDER BY sector)::INT AS sector_code FROM sectors")
def _(i: Inputs):
    return encode_sectors(i.table("supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")), i.sectors)


@query("prj3_fixed_sector_index", """SELECT ticker, CASE sector WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'EUROPE' THEN 3 WHEN 'MIDDLE EAST' THEN 4 ELSE -1 END AS sector_index FROM sectors""")
def _(i: Inputs):
    names = [r if r != "ASIA" else "OTHER" for r in REGIONS]
    return i.sectors.select("ticker", fixed_sector_index("sector", names).alias("sector_index"))


@query("prj5_date_range", "SELECT ticker, count(*) AS n, sum(volume) AS volume FROM daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1")
def _(i: Inputs):
    df = calendar.date_filter(i.daily, "date", "1996-01-01", "1998-12-31")
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("prj6_split_assignment", """SELECT CASE WHEN date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train'
  WHEN date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'val' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'test' END AS split,
  count(*) AS n FROM daily GROUP BY 1""")
def _(i: Inputs):
    splits = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2000-12-31")}
    return i.daily.groupBy(calendar.assign_split("date", splits).alias("split")).agg(F.count(F.lit(1)).alias("n"))
