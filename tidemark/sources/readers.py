"""Readers: landed files and raw payload columns to typed tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import null_unless_finite
from tidemark.functions.words import NEGATIVE, POSITIVE, parse_date, polarity
from tidemark.operators.clean import drop_duplicates
from tidemark.operators.text import decode_entities, table_depths
from tidemark.operators.technical import require_columns

BAR_NUMBERS = ["open", "high", "low", "close", "adj_close", "volume"]


def ticker_from_path() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.parquet$", 1)


def file_order(df: DataFrame) -> DataFrame:
    """Adds ``_order``, a long that rises with the file's path and the row's place in it; a row of a
    file costs no sort. Files are few against rows: their ranks are joined, by size as Spark decides."""
    rows = df.withColumns({"_path": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    ranks = rows.select("_path").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_path")).cast("long"))
    return rows.join(ranks, "_path").withColumn("_order", F.shiftleft("_rank", 40) + F.col("_row")).drop("_path", "_row", "_rank")


def read_prices(spark: SparkSession, path: str, ticker_files: bool = False) -> DataFrame:
    """Price parquet, one table or one file per ticker. Dates become DATE, NaN becomes null, the
    first row per (ticker, date) in file order stays."""
    df = spark.read.parquet(path)
    if ticker_files:
        df = df.withColumn("ticker", ticker_from_path())
    require_columns(df, ["ticker", "date", *BAR_NUMBERS])
    return drop_duplicates(typed_bars(file_order(df)), ["_order"]).drop("_order")


def typed_bars(df: DataFrame) -> DataFrame:
    """Cast dates and numbers, default dividends and splits to zero."""
    df = df.withColumn("date", F.to_date("date")).withColumns(
        {c: null_unless_finite(F.col(c).cast("double")) for c in BAR_NUMBERS})
    for c in ("dividends", "stock_splits"):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    return df


def normalise_vendor_bars(df: DataFrame) -> DataFrame:
    """Vendor names in title case to snake case, then required columns, types and defaults."""
    df = df.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in df.columns})
    require_columns(df, ["date", *BAR_NUMBERS])
    return typed_bars(df)


# -- rosters --------------------------------------------------------------------------------


def roster_from_rows(rows: DataFrame) -> DataFrame:
    """(date, tickers) with a comma list per row to (snapshot_date, ticker); header case is free,
    symbols are trimmed and upper-cased, empty ones dropped. A date that cannot be read raises."""
    names = {c: c.strip().lower() for c in rows.columns}
    rows = rows.withColumnsRenamed(names)
    require_columns(rows, ["date", "tickers"])
    unread = F.raise_error(F.concat(F.lit("unreadable roster date: "), F.coalesce(F.col("date").cast("string"), F.lit("null")))).cast("date")
    one = rows.select(F.coalesce(parse_date("date"), unread).alias("snapshot_date"), F.explode(F.split("tickers", ",")).alias("ticker"))
    return one.select("snapshot_date", F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct()


def read_roster_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``date,"A,B,C"``; an empty file raises."""
    rows = spark.read.option("header", True).csv(path)
    if rows.isEmpty():
        raise ValueError(f"no roster rows in {path}")
    return roster_from_rows(rows)


def roster_from_json(payload: DataFrame, column: str = "json") -> DataFrame:
    """A JSON map of date to symbols, or one such map per row."""
    parsed = F.from_json(F.col(column), "map<string,array<string>>")
    return payload.select(F.explode(parsed).alias("_d", "_t")).select(
        F.to_date("_d").alias("snapshot_date"), F.explode("_t").alias("ticker"))


def read_roster_json(spark: SparkSession, path: str) -> DataFrame:
    return roster_from_json(spark.read.text(path, wholetext=True), "value")


# -- HTML tables ----------------------------------------------------------------------------


def _rows(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))


def _cells(row: Column, tag: str = "td") -> Column:
    raw = F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(raw, lambda c: F.trim(F.regexp_replace(c, r"(?s)<[^>]+>", "")))


def _tables(html: Column) -> Column:
    """Top-level tables of a page, with what they hold."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, p, inside, after):
        text = F.when(inside, F.concat(a["open"], p)).otherwise(F.lit(""))
        ended = inside & (after == 0)
        return F.struct(after.alias("depth"), F.when(ended, F.array_append(a["done"], text)).otherwise(a["done"]).alias("done"), F.when(ended, F.lit("")).otherwise(text).alias("open"))

    return table_depths(html, step, start, lambda a: a["done"])


def _the_table(html: Column, fits, what: str) -> Column:
    """The first table that fits; an error if a page has none."""
    found = F.get(F.filter(_tables(html), fits), F.lit(0))
    return F.when(html.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(found, F.raise_error(F.lit(f"no table of {what}")).cast("string")))


def constituents_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """First cell of each row, but the header, of the table with id ``constituents``, as a ticker:
    upper case, dots to dashes."""
    fits = lambda t: F.regexp_like(t, F.lit(r"(?is)^<table\b[^>]*\bid\s*=\s*[\"']?constituents\b"))
    rows = pages.select(F.explode(F.slice(_rows(_the_table(F.col(html), fits, "constituents")), 2, 1 << 30)).alias("_row"))
    first = F.get(_cells(F.col("_row"), "t[dh]"), F.lit(0))
    return rows.select(F.upper(F.replace(first, F.lit("."), F.lit("-"))).alias("ticker")).where("ticker <> ''").distinct()


# Fixed value: shape of a ticker in a table cell.
TICKER_CELL = r"\b[A-Z][A-Z0-9.\-]{0,5}\b"


def changes_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows (date, added, name, removed, ...) of the table whose headers name added and removed, to
    (date, ticker, action). Rows without a readable date are skipped; one row may hold an addition
    and a removal, or an addition only."""
    fits = lambda t: F.lower(F.array_join(_cells(t, "th"), " ")).rlike(r"(?s)added.*removed|removed.*added")
    rows = pages.select(F.explode(_rows(_the_table(F.col(html), fits, "changes"))).alias("_row")).select(_cells(F.col("_row"), "t[dh]").alias("_c"))

    def symbol(i: int) -> Column:
        return F.replace(F.regexp_extract(F.coalesce(F.get("_c", F.lit(i)), F.lit("")), TICKER_CELL, 0), F.lit("."), F.lit("-"))

    events = rows.where(F.size("_c") >= 3).select(parse_date(F.get("_c", F.lit(0))).alias("date"), F.inline(F.array(
        F.struct(symbol(1).alias("ticker"), F.lit("added").alias("action")),
        F.struct(symbol(3).alias("ticker"), F.lit("removed").alias("action")))))
    return events.where(F.col("date").isNotNull() & (F.col("ticker") != ""))


# -- fundamentals, macro --------------------------------------------------------------------

# Metric -> accepted label parts, in order of preference.
METRIC_ALIASES = {
    "total_revenue": ["total revenue"],
    "net_income": ["net income"],
    "ebitda": ["ebitda", "normalized ebitda"],
    "total_assets": ["total assets"],
    "total_debt": ["total debt"],
    "cash": ["cash and cash equivalents", "cash and short term investments"],
    "stockholders_equity": ["stockholders equity", "total equity gross minority interest"],
    "shares_outstanding": ["share issued", "ordinary shares number"],
    "operating_cashflow": ["operating cash flow"],
    "capex": ["capital expenditure"],
    "dividends_paid": ["cash dividends paid"],
}


def statements_to_long(statements: DataFrame, aliases: Mapping[str, Sequence[str]] = METRIC_ALIASES) -> DataFrame:
    """(ticker, date, label, label_pos, value) to (ticker, date, metric, value).

    Per ticker a metric takes the first label, in statement order, containing its first alias
    that any label contains. The alias list is a literal array, matched row by row.
    """
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(i).alias("rank"), F.lit(a).alias("alias"))
        for m, names in aliases.items() for i, a in enumerate(names)])
    fits = F.filter(entries, lambda e: F.contains(F.lower(F.col("label")), e["alias"]))
    rows = statements.withColumn("_m", F.explode(fits))
    best = rows.groupBy("ticker", "_m.metric").agg(
        F.min_by("label", F.struct(F.col("_m.rank"), F.col("label_pos"), F.col("label"))).alias("label"))
    kept = statements.join(best, ["ticker", "label"]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.groupBy("ticker", "date", "metric").agg(F.min_by("value", F.struct("label_pos", "value")).alias("value"))


def wide_statement(wide: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Label columns of a (ticker, date) statement to long rows with their column position."""
    long = wide.unpivot(["ticker", "date"], list(labels), "label", "value")
    return long.withColumn("label_pos", F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int"))


def tidy_macro(rows: DataFrame, order: str) -> DataFrame:
    """(series, date, close): dates without time, one row per day, the first by ``order``."""
    typed = rows.select("series", F.to_date("date").alias("date"), null_unless_finite(F.col("close").cast("double")).alias("close"), order)
    return drop_duplicates(typed, [order], ["series", "date"]).select("series", "date", "close")


# -- messages and headlines -----------------------------------------------------------------

MESSAGES = "struct<messages: array<struct<created_at: string, sentiment: string>>>"


def messages_to_daily(payload: DataFrame, column: str = "json", source: str = "stocktwits") -> DataFrame:
    """(ticker, json) message streams to daily (score, volume): bullish +1, bearish -1, untagged
    messages count in the volume only; a day without tags scores 0."""
    rows = payload.select("ticker", F.explode(F.from_json(F.col(column), MESSAGES)["messages"]).alias("_m"))
    tag = F.when(F.col("_m.sentiment") == "Bullish", 1.0).when(F.col("_m.sentiment") == "Bearish", -1.0)
    return rows.groupBy("ticker", F.to_date(F.left("_m.created_at", F.lit(10))).alias("date")).agg(
        F.coalesce(F.avg(tag), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("volume")
    ).withColumn("source", F.lit(source))


# Fixed value: date form of headline tables.
HEADLINE_DATE = "MMM-dd-yy"


def headlines_to_daily(rows: DataFrame, source: str = "finviz", positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """(ticker, page, pos, stamp, headline) to daily mean polarity and volume.

    A stamp is ``Jan-05-24 09:30AM`` or, on the rows below it, a time only; the date is carried
    down the page. ``page`` is one fetched table, so a window holds one page.
    """
    w = Window.partitionBy("ticker", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.try_to_timestamp(F.regexp_extract("stamp", r"^\s*([A-Za-z]{3}-\d{2}-\d{2})", 1), F.lit(HEADLINE_DATE)).cast("date")
    dated = rows.withColumn("date", F.last(own, ignorenulls=True).over(w)).where(F.col("date").isNotNull())
    return dated.groupBy("ticker", "date").agg(
        F.avg(polarity("headline", positive, negative)).alias("score"), F.count(F.lit(1)).alias("volume")
    ).withColumn("source", F.lit(source))


def headline_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(ticker, page, html) to (ticker, page, pos, stamp, headline): rows of two cells or more of the first table
    with id ``news-table``, numbered down the page; pages without one have none."""
    fits = lambda t: F.regexp_like(t, F.lit(r"(?is)^<table\b[^>]*\bid\s*=\s*[\"']?news-table\b"))
    table = F.get(F.filter(_tables(F.col(html)), fits), F.lit(0))
    rows = pages.select("ticker", "page", F.posexplode(_rows(table)).alias("pos", "_row")).withColumn("_c", _cells(F.col("_row")))
    return rows.where(F.size("_c") >= 2).select(
        "ticker", "page", "pos", decode_entities(F.col("_c")[0]).alias("stamp"), decode_entities(F.col("_c")[1]).alias("headline"))


def headlines_from_html(pages: DataFrame, source: str = "finviz", positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> DataFrame:
    """Fetched headline pages (ticker, page, html) to daily polarity and volume."""
    return headlines_to_daily(headline_rows(pages), source, positive, negative)


# -- filings --------------------------------------------------------------------------------

RECENT = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]


def filings_from_submissions(
    payload: DataFrame, forms: Sequence[str], date_from: str | None = None, date_to: str | None = None, column: str = "json",
) -> DataFrame:
    """(cik, json) of parallel arrays to filing rows. Older pages have the same shape and are
    simply more rows of ``payload``. An empty report date falls back to the filing date."""
    spec = "struct<" + ", ".join(f"{c}: array<string>" for c in RECENT) + ">"
    rows = payload.select("cik", F.from_json(F.col(column), spec).alias("_r"))
    rows = rows.select("cik", F.explode(F.arrays_zip(*[F.col(f"_r.{c}").alias(c) for c in RECENT])).alias("_f")).select("cik", "_f.*")
    out = rows.where(F.col("form").isin(list(forms)))
    if date_from:
        out = out.where(F.col("filingDate") >= date_from)
    if date_to:
        out = out.where(F.col("filingDate") <= date_to)
    return out.select(
        "cik", F.col("accessionNumber").alias("accession"), "form", F.col("filingDate").alias("filing_date"),
        F.coalesce(F.nullif(F.col("reportDate"), F.lit("")), F.col("filingDate")).alias("period"),
        F.col("primaryDocument").alias("primary_doc"))


def cik_map_from_manifest(payload: DataFrame, column: str = "json") -> DataFrame:
    """Ticker manifest ``{"0": {cik_str, ticker, title}, ...}`` to (cik, ticker): ten digits, upper
    case, of several share classes the later entry."""
    entries = F.explode(F.from_json(F.col(column), "map<string, struct<cik_str: bigint, ticker: string, title: string>>")).alias("_k", "_e")
    rows = payload.select(entries).select(
        F.lpad(F.col("_e.cik_str").cast("string"), 10, "0").alias("cik"), F.upper("_e.ticker").alias("ticker"), F.col("_k").cast("bigint").alias("entry"))
    return rows.groupBy("cik").agg(F.max_by("ticker", "entry").alias("ticker"))


def document_url(base: str, cik: str = "cik", accession: str = "accession", document: str = "primary_doc") -> Column:
    """Archive address: number without leading zeros, accession without dashes."""
    return F.concat_ws("/", F.lit(base.rstrip("/")), F.col(cik).cast("bigint").cast("string"),
                       F.replace(F.col(accession), F.lit("-"), F.lit("")), F.col(document))


def pack_filings(texts: DataFrame, path: str, files: int | None = None) -> None:
    """Texts (file, text) into one container: Parquet sorted by ``file`` over all its parts, so that the ranges in its
    footers say where a filing lies, and a part is read without the others."""
    cut = texts.select("file", "text").repartitionByRange(*([files] if files else []), "file").sortWithinPartitions("file")
    cut.write.option("parquet.block.size", 16 << 20).parquet(path)


def read_filing_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file, text) of a folder with a file per filing; ``file`` is relative to it."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("_path"), F.col("value").alias("text"))
    root = folder.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return texts.select(F.substring_index("_path", root, -1).alias("file"), "text")


def read_raw_filings(spark: SparkSession, manifest_csv: str, folder: str, pattern: str = "*", packed: bool = False) -> DataFrame:
    """Manifest rows with the text of their filing (column ``file``), from a folder with a file per
    filing or, ``packed``, from a container; rows whose text is missing drop."""
    manifest = spark.read.option("header", True).csv(manifest_csv)
    texts = spark.read.schema("file string, text string").parquet(folder) if packed else read_filing_texts(spark, folder, pattern)
    return manifest.join(texts, "file")


def read_filing(spark: SparkSession, container: str, first: str, last: str | None = None) -> DataFrame:
    """One filing of a container, or a range of them: only the row groups that can hold it are read."""
    return spark.read.schema("file string, text string").parquet(container).where(F.col("file").between(first, last or first))


# -- run logs and evaluation artefacts --------------------------------------------------------

# Log line, variant and job patterns.
EPOCH_LINE = (r"epoch (\d+) \| train_loss=(-?\d+\.\d+) \| val_ic=(-?\d+\.\d+) \| "
              r"val_ic_ir=(-?\d+\.\d+) \| hit@50=(-?\d+\.\d+) \| spread@50=([+-]\d+\.\d+)")
VARIANT = r"([A-I])_(?:best\.pt|epoch\d+\.pt)"
JOB = r"_(\d+)\.err"
EPOCH_FIELDS = ["train_loss", "val_ic", "val_ic_ir", "hit", "spread"]


def epochs_from_logs(files: DataFrame, variant: str = VARIANT) -> DataFrame:
    """(path, modified, text) to (variant, job, modified, epoch, five metrics); files without a
    variant or epoch lines drop out."""
    lines = F.regexp_extract_all("text", F.lit(EPOCH_LINE), F.lit(0))
    rows = files.select(
        F.regexp_extract("text", variant, 1).alias("variant"), F.regexp_extract("path", JOB, 1).alias("_job"), "modified",
        F.explode(lines).alias("_line")).where("variant <> '' and _job <> ''")
    values = {name: F.regexp_extract("_line", EPOCH_LINE, i + 2).cast("double") for i, name in enumerate(EPOCH_FIELDS)}
    return rows.select("variant", F.col("_job").cast("bigint").alias("job"), "modified",
                       F.regexp_extract("_line", EPOCH_LINE, 1).cast("int").alias("epoch"), *[c.alias(n) for n, c in values.items()])


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def in_job_range(epochs: DataFrame, first: int | None = None, before: int | None = None) -> DataFrame:
    if first is not None:
        epochs = epochs.where(F.col("job") >= first)
    if before is not None:
        epochs = epochs.where(F.col("job") < before)
    return epochs


def with_stage(epochs: DataFrame, stages: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The first stage whose closed time interval holds the file time; rows in none drop out."""
    stage = F.lit(None).cast("string")
    for name, lo, hi in reversed(stages):
        stage = F.when(F.col("modified").between(F.to_timestamp(F.lit(lo)), F.to_timestamp(F.lit(hi))), name).otherwise(stage)
    return epochs.withColumn("stage", stage).where(F.col("stage").isNotNull())


SUMMARY_SCHEMA = (
    "backtest struct<sharpe: double, annual_return: double, annual_vol: double, max_drawdown: double, avg_turnover: double, "
    "total_cost: double, final_equity: double, n_days: bigint>, regimes map<string, struct<n_days: bigint, annual_return: double, "
    "annual_vol: double, sharpe: double, max_drawdown: double, hit_rate: double>>, _corrupt_record string")


def _variant(name: str) -> Column:
    """The folder above a file of this name, or above a folder of Spark's part files of this name."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{re.escape(name)}(?:/[^/]*)?$", 1)


def read_run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """``<variant>/summary.json`` below ``folder``: (variant, backtest, regimes); bad files skipped."""
    rows = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(f"{folder}/*/summary.json")
    return rows.withColumn("variant", _variant("summary.json")).where(F.col("backtest").isNotNull()).select("variant", "backtest", "regimes")


def read_run_series(spark: SparkSession, folder: str, name: str, value: str) -> DataFrame:
    """``<variant>/<name>.csv`` below ``folder``: (variant, date, value)."""
    rows = spark.read.schema(f"date date, {value} double").option("header", True).csv(f"{folder}/*/{name}.csv")
    return rows.select(_variant(f"{name}.csv").alias("variant"), "date", value)
