"""Panel tables derived from the order, event and document tables, in Spark and as SQL.

A supplier is a ticker, its line items are trades, a nation's region is a sector. Derived
tables that many queries share are written once per session to the shared work folder.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import trading_calendar
from tidemark.operators.clean import fill_small_gaps
from tidemark.operators.pairs import daily_log_returns
from tidemark.operators.spread import PER_RANGE, by_size
from tidemark.session import new_path, store

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SERIES = {"1-URGENT": "vix", "2-HIGH": "tnx", "3-MEDIUM": "dxy", "5-LOW": "spy"}
SOURCES = {"purchase": "finviz", "click": "stocktwits", "view": "reddit"}
TICKER = "'S' || l_suppkey"

_known: dict[tuple[str, str], Inputs] = {}


def _mapped(column: str, names: dict[str, str], default) -> F.Column:
    c = None
    for k, v in names.items():
        c = F.when(F.col(column) == k, v) if c is None else c.when(F.col(column) == k, v)
    return c.otherwise(default)


def per_supplier(lineitem: DataFrame, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``aggregate`` of line items by supplier and something else. Few of them fall together, so a supplier's rows are
    brought together as they are, in bounded parts; suppliers with very many rows are combined before the shuffle."""
    return by_size(lineitem, ["l_suppkey"], PER_RANGE, aggregate, aggregate)


def bars(lineitem: DataFrame, day) -> DataFrame:
    """One bar per (supplier, day)."""
    px = 100 + F.col("l_extendedprice") / 10000 + 100 * F.col("l_discount")
    # one whole number, so that the aggregate stays a hash aggregate
    cents = F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5))
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + cents % 1_000_000
    # sums of cents and keys of whole numbers keep the buffers of the aggregate small; both are exact
    money, discount = (F.sum((F.col(c).cast("decimal(15,2)") * 100).cast("bigint")) / F.lit(100.0) for c in ("l_extendedprice", "l_discount"))
    n = F.count(F.lit(1))

    def aggregate(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_px", px).groupBy("l_suppkey", "date").agg(
            F.min_by("_px", key).alias("open"), F.max("_px").alias("high"), F.min("_px").alias("low"),
            F.max_by("_px", key).alias("close"),
            (100 + money / n / 10000 + 100 * discount / n).alias("adj_close"),
            F.sum("l_quantity").alias("volume"), F.lit(0.0).alias("dividends"), F.lit(0.0).alias("stock_splits"))

    used = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
    rows = per_supplier(lineitem.select(*used, day.alias("date")), aggregate)
    return rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), *rows.columns[1:])


def folder_state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what a folder holds; derived panels are kept as long as it stays."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


class Inputs:
    """Tables of one data folder and lazily derived panels."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._stored: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Inputs:
        key, state = (spark.sparkContext.applicationId, folder), folder_state(spark, folder)
        if key not in _known or _known[key].state != state:
            _known[key] = cls(spark, folder)
            _known[key].state = state
        return _known[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._stored:
            self._stored[name] = store(build(), new_path(self.spark, name))
        return self._stored[name]

    # -- panels ---------------------------------------------------------------------------

    @property
    def daily(self) -> DataFrame:
        return self._keep("daily", self._daily_bars)

    def _daily_bars(self) -> DataFrame:
        return bars(self.table("lineitem"), F.to_date("l_shipdate"))

    @property
    def daily_keys(self) -> DataFrame:
        """(ticker, date) of the daily bars, which need not be built for them."""
        return (self.daily if "daily" in self._stored else self._daily_bars()).select("ticker", "date")

    @property
    def traded(self) -> DataFrame:
        """(ticker, date) of line items, repeats included: the weekly bars have the same tickers."""
        return self.table("lineitem").where("l_shipdate is not null").select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.to_date("l_shipdate").alias("date"))

    @property
    def daily_calendar(self) -> DataFrame:
        return self._keep("daily_calendar", lambda: trading_calendar(self.table("lineitem").select(F.to_date("l_shipdate").alias("date"))))

    @property
    def weekly_raw(self) -> DataFrame:
        return self._keep("weekly_raw", self._weekly_bars)

    def _weekly_bars(self) -> DataFrame:
        return bars(self.table("lineitem"), F.trunc("l_shipdate", "week"))

    @property
    def calendar(self) -> DataFrame:
        return self._keep("calendar", lambda: trading_calendar(self.table("lineitem").select(F.trunc("l_shipdate", "week").alias("date"))))

    @property
    def weekly(self) -> DataFrame:
        return self._keep("weekly", lambda: fill_small_gaps(
            self.weekly_raw if "weekly_raw" in self._stored else self._weekly_bars(), self.calendar, 2))

    @property
    def returns(self) -> DataFrame:
        return self._keep("returns", lambda: daily_log_returns(self.weekly, self.calendar))

    @property
    def predictions(self) -> DataFrame:
        return self._keep("predictions", self._predictions)

    def _predictions(self) -> DataFrame:
        w = Window.partitionBy("ticker").orderBy("date")
        px = F.ln("adj_close")
        rows = self.weekly.select("ticker", "date", "filled", px.alias("_x"))
        rows = rows.withColumn("_r", F.col("_x") - F.lag("_x").over(w))
        return rows.select(
            F.col("date").alias("pred_date"), "ticker",
            (F.col("_x") - F.lag("_x", 4).over(w)).alias("score"),
            (F.lead("_x", 2).over(w) - F.col("_x")).alias("target"),
            (~F.col("filled")).alias("valid"),
            F.stddev_samp("_r").over(w.rowsBetween(-7, 0)).alias("volatility"))

    @property
    def sectors(self) -> DataFrame:
        return (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector")))

    @property
    def roster(self) -> DataFrame:
        """Suppliers with six or more line items in a month, as of its first day."""
        def build() -> DataFrame:
            months = self.table("lineitem").select("l_suppkey", F.trunc("l_shipdate", "month").alias("snapshot_date"))
            counts = per_supplier(months, lambda rows: rows.groupBy("snapshot_date", "l_suppkey").agg(F.count(F.lit(1)).alias("_n")))
            return counts.where("_n >= 6").select("snapshot_date", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"))

        return self._keep("roster", build)

    @property
    def fundamentals(self) -> DataFrame:
        def build() -> DataFrame:
            quarter = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
            n = F.count(F.lit(1))

            def total(c: str):
                return F.sum(F.col(c).cast("decimal(15,2)")).cast("double")

            used = self.table("lineitem").select("l_suppkey", quarter.alias("date"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")
            sums = per_supplier(used, lambda rows: rows.groupBy("l_suppkey", "date").agg(
                total("l_extendedprice").alias("p"), total("l_quantity").alias("q"),
                (total("l_discount") / n).alias("d"), (total("l_tax") / n).alias("t")))
            wide = sums.select(
                F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "date", F.expr("p * (1 - d)").alias("total_revenue"), F.expr("p * (t - 0.0347D)").alias("net_income"),
                F.expr("p * t").alias("total_debt"), F.expr("p * 0.4D").alias("stockholders_equity"),
                F.expr("q * 10").alias("shares_outstanding"), F.expr("p * 0.2D").alias("operating_cashflow"),
                F.expr("case when d >= 0.03D then p * d end").alias("capex"), F.expr("p * -0.01D").alias("dividends_paid"))
            metrics = [c for c in wide.columns if c not in ("ticker", "date")]
            return wide.unpivot(["ticker", "date"], metrics, "metric", "value").where("value is not null")

        return self._keep("fundamentals", build)

    @property
    def sentiment(self) -> DataFrame:
        return self.table("events").groupBy(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").alias("date"),
            _mapped("event_type", SOURCES, F.col("event_type")).alias("source")).agg(
            F.avg((F.col("value") - 50) / (F.col("value") + 50)).alias("score"), F.count(F.lit(1)).alias("volume"))

    @property
    def sentiment_spine(self) -> DataFrame:
        """Every user on each date from the user's first to last event."""
        return self.table("events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).agg(
            F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).select(
            "ticker", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))

    @property
    def macro(self) -> DataFrame:
        return self.table("orders").groupBy(
            _mapped("o_orderpriority", SERIES, F.lit("other")).alias("series"), F.to_date("o_orderdate").alias("date")).agg(
            F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("close"))

    @property
    def month_starts(self) -> DataFrame:
        """First weekly bar date of each month, as prediction dates with their ordinal."""
        return self.calendar.groupBy(F.trunc("date", "month").alias("_m")).agg(
            F.min("date").alias("pred_date"), F.min("dn").alias("dn")).select("pred_date", "dn")

    @property
    def filing_embeddings(self) -> DataFrame:
        """Company = 50 consecutive vectors, two forms, a filing each quarter; label = sector."""
        k = F.floor(F.pmod("vec_id", F.lit(50)) / F.lit(2)).cast("int")
        return self.table("embeddings").select(
            F.lpad(F.floor(F.col("vec_id") / F.lit(50)).cast("string"), 10, "0").alias("cik"),
            F.col("vec_id").cast("string").alias("accession"),
            F.when(F.col("vec_id") % 2 == 0, "10-K").otherwise("10-Q").alias("form"),
            F.date_add(F.lit("2015-01-15").cast("date"), k * 91).alias("period"),
            F.date_add(F.lit("2015-03-01").cast("date"), k * 91).alias("filing_date"),
            F.lit("mda").alias("section_name"), "embedding", "label")

    @property
    def filing_texts(self) -> DataFrame:
        """Documents arranged as filings: headings once in a contents line, once in the body."""
        form = F.when(F.col("doc_id") % 4 == 0, "10-K").when(F.col("doc_id") % 4 == 1, "10-Q").when(
            F.col("doc_id") % 4 == 2, "10-K/A").otherwise("8-K")
        third = F.floor(F.length("text") / F.lit(3)).cast("int")
        a, b = F.left("text", third), F.substring(F.col("text"), third + 1, third)
        c = F.substring(F.col("text"), 2 * third + 1, F.length("text"))
        annual = F.concat(
            F.lit("Contents Item 1A. Item 7. Item 7A. Item 8. Body Item 1A. "), a, F.lit(" Item 7. "), b,
            F.when(F.col("doc_id") % 8 == 0, " Item 7A. ").otherwise(" Item 8. "), c)
        quarterly = F.concat(
            F.lit("Part I Item 2. "), a, F.lit(" Part I Item 3. "), b,
            F.when(F.col("doc_id") % 8 == 1, " Part II Item 1A. ").otherwise(" Part II Item 2. "), c)
        return self.table("documents").select(
            "doc_id", form.alias("form"), F.when(F.col("doc_id") % 4 == 1, quarterly).otherwise(annual).alias("text"))


# -- the same tables as SQL ------------------------------------------------------------------


def _bars_sql(day: str) -> str:
    key = "((l_orderkey * 8 + l_linenumber) * 1000000 + floor(l_extendedprice * 100 + 0.5)::BIGINT % 1000000)"
    px = "(100 + l_extendedprice / 10000 + 100 * l_discount)"
    return f"""
  SELECT {TICKER} AS ticker, {day} AS date, arg_min({px}, {key}) AS open, max({px}) AS high, min({px}) AS low,
         arg_max({px}, {key}) AS close,
         100 + sum(l_extendedprice::DECIMAL(15,2))::DOUBLE / count(*) / 10000
             + 100 * sum(l_discount::DECIMAL(15,2))::DOUBLE / count(*) AS adj_close,
         sum(l_quantity) AS volume, 0.0::DOUBLE AS dividends, 0.0::DOUBLE AS stock_splits
  FROM lineitem GROUP BY 1, 2"""


def _case(column: str, names: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {whens} ELSE {default} END"


CTES: dict[str, str] = {
    "daily": _bars_sql("l_shipdate::DATE"),
    "daily_calendar": "SELECT date, row_number() OVER (ORDER BY date)::INT AS dn FROM (SELECT DISTINCT date FROM daily)",
    "weekly_raw": _bars_sql("date_trunc('week', l_shipdate)::DATE"),
    "calendar": """
  SELECT date, row_number() OVER (ORDER BY date)::INT AS dn, count(*) OVER ()::INT AS n_dates
  FROM (SELECT DISTINCT date FROM weekly_raw)""",
    "weekly_grid": """
  SELECT t.ticker, c.date, c.dn, r.open, r.high, r.low, r.close, r.adj_close, r.volume,
         count(r.close) OVER (PARTITION BY t.ticker ORDER BY c.date) AS grp
  FROM (SELECT DISTINCT ticker FROM weekly_raw) t CROSS JOIN calendar c LEFT JOIN weekly_raw r USING (ticker, date)""",
    "weekly_full": """
  SELECT ticker, date, dn, close IS NULL AS filled, count(*) OVER gg - 1 AS run,
         first_value(open) OVER g1 AS open, first_value(high) OVER g1 AS high, first_value(low) OVER g1 AS low,
         first_value(close) OVER g1 AS close, first_value(adj_close) OVER g1 AS adj_close, coalesce(volume, 0.0) AS volume,
         0.0::DOUBLE AS dividends, 0.0::DOUBLE AS stock_splits
  FROM weekly_grid WHERE grp > 0
  WINDOW gg AS (PARTITION BY ticker, grp), g1 AS (PARTITION BY ticker, grp ORDER BY date)""",
    "weekly": "SELECT * FROM weekly_full WHERE NOT filled OR run <= 2",
    "returns": """
  SELECT ticker, date, dn, CASE WHEN dn - lag(dn) OVER w = 1 THEN ln(adj_close) - ln(lag(adj_close) OVER w) END AS ret
  FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "log_prices": """
  SELECT ticker, date, filled, ln(adj_close) AS x,
         ln(adj_close) - lag(ln(adj_close)) OVER (PARTITION BY ticker ORDER BY date) AS r FROM weekly""",
    "predictions": """
  SELECT date AS pred_date, ticker, x - lag(x, 4) OVER w AS score, lead(x, 2) OVER w - x AS target, NOT filled AS valid,
         stddev_samp(r) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS volatility
  FROM log_prices WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    "valid_predictions": "SELECT * FROM predictions WHERE valid AND score IS NOT NULL AND target IS NOT NULL",
    "sectors": """
  SELECT 'S' || s_suppkey AS ticker, r_name AS sector FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "roster": f"""
  SELECT date_trunc('month', l_shipdate)::DATE AS snapshot_date, {TICKER} AS ticker FROM lineitem
  GROUP BY 1, 2 HAVING count(*) >= 6""",
    "snapshots": """
  SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS previous,
         lead(snapshot_date) OVER (ORDER BY snapshot_date) AS valid_to
  FROM (SELECT DISTINCT snapshot_date FROM roster)""",
    "fund_sums": f"""
  SELECT {TICKER} AS ticker, last_day(date_trunc('quarter', l_shipdate)::DATE + INTERVAL 2 MONTH)::DATE AS date,
         sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS p, sum(l_quantity::DECIMAL(15,2))::DOUBLE AS q,
         sum(l_discount::DECIMAL(15,2))::DOUBLE / count(*) AS d, sum(l_tax::DECIMAL(15,2))::DOUBLE / count(*) AS t
  FROM lineitem GROUP BY 1, 2""",
    "fund_wide": """
  SELECT ticker, date, p * (1 - d) AS total_revenue, p * (t - 0.0347::DOUBLE) AS net_income, p * t AS total_debt,
         p * 0.4::DOUBLE AS stockholders_equity, q * 10 AS shares_outstanding, p * 0.2::DOUBLE AS operating_cashflow,
         CASE WHEN d >= 0.03::DOUBLE THEN p * d END AS capex, p * -0.01::DOUBLE AS dividends_paid FROM fund_sums""",
    "sentiment": f"""
  SELECT 'U' || user_id AS ticker, ts::DATE AS date, {_case('event_type', SOURCES, 'event_type')} AS source,
         avg((value - 50) / (value + 50)) AS score, count(*) AS volume FROM events GROUP BY 1, 2, 3""",
    "sentiment_spine": """
  SELECT ticker, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM (
    SELECT 'U' || user_id AS ticker, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events GROUP BY 1)""",
    "macro": f"""
  SELECT {_case('o_orderpriority', SERIES, "'other'")} AS series, o_orderdate::DATE AS date,
         sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS close FROM orders GROUP BY 1, 2""",
    "month_starts": "SELECT min(date) AS pred_date, min(dn) AS dn FROM calendar GROUP BY date_trunc('month', date)",
    "filing_embeddings": """
  SELECT lpad((vec_id // 50)::VARCHAR, 10, '0') AS cik, vec_id::VARCHAR AS accession,
         CASE WHEN vec_id % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form,
         DATE '2015-01-15' + ((vec_id % 50) // 2 * 91)::INT AS period,
         DATE '2015-03-01' + ((vec_id % 50) // 2 * 91)::INT AS filing_date, embedding::DOUBLE[] AS embedding, label
  FROM embeddings""",
}


def with_ctes(body: str) -> str:
    """Prefix the tables a statement uses, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    ordered = [n for n in CTES if n in needed]
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
