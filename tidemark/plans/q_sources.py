"""Readers on payloads that Spark composes from the given tables and then parses back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.words import parse_date
from tidemark.operators import asof, ranking
from tidemark.plans.base import Inputs
from tidemark.plans.q_pit import CHANGES
from tidemark.plans.q_text import BAD, GOOD, _hit_sql
from tidemark.plans.registry import g, grid, gridded, gs, query
from tidemark.session import new_path
from tidemark.sources import readers, sinks


def _part(size: int = 200):
    """Cuts lists of tickers into parts of bounded length, whatever their number."""
    return F.floor(F.substring(F.col("ticker"), 2, 20).cast("bigint") / F.lit(size))


def _roster_rows(i: Inputs):
    part = _part()
    return i.roster.groupBy("snapshot_date", part.alias("part")).agg(
        F.concat_ws(",", F.collect_list(F.concat(F.lit(" "), F.lower("ticker")))).alias("tickers")).select(
        F.col("snapshot_date").cast("string").alias("Date"), F.concat(F.col("tickers"), F.lit(",")).alias("Tickers"))


@query("src3_roster_csv", "SELECT snapshot_date, ticker FROM roster")
def _(i: Inputs):
    path = new_path(i.spark, "roster_csv")
    _roster_rows(i).write.option("header", True).csv(path)
    return readers.read_roster_csv(i.spark, path)


@query("src4_roster_json", "SELECT snapshot_date, ticker FROM roster")
def _(i: Inputs):
    path = new_path(i.spark, "roster_json")
    sinks.roster_to_json(i.roster).select("json").write.text(path)
    return readers.roster_from_json(i.spark.read.text(path), "value")


@query("src5_constituents_html", "SELECT DISTINCT replace(upper(c_mktsegment), '.', '-') || '-' || (c_custkey % 1000) AS ticker FROM customer")
def _(i: Inputs):
    # symbols in data or header cells
    kind = F.when(F.col("c_custkey") % 2 == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<tr><"), kind, F.lit('><a href="/x">'), F.lower("c_mktsegment"), F.lit("."), (F.col("c_custkey") % 1000).cast("string"), F.lit("</a></"), kind, F.lit("><td>"), F.col("c_name"), F.lit("</td></tr>"))
    pages = i.table("customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("page")).agg(
        F.concat(F.lit("<p>a</p><TABLE class='nav'><tr><td>HOME</td></tr></TABLE><table class=w id='constituents'><tr><th>Symbol</th><th>Security</th></tr>"),
                 F.concat_ws("\n", F.collect_list(cell)), F.lit("</table ><table><tr><td>FOOTER</td></tr></table>")).alias("html"))
    return readers.constituents_from_html(pages)


@query("src6_changes_html", f"""WITH {CHANGES} SELECT snapshot_date AS date, ticker, action FROM changes WHERE month(snapshot_date) <> 5""")
def _(i: Inputs):
    day = F.when(F.month("snapshot_date") == 5, "soon").otherwise(F.date_format("snapshot_date", "MMMM d, yyyy"))
    name = F.concat(F.lit("<b>"), "ticker", F.lit("</b>"))
    row = F.concat(F.lit("<tr><td>"), day, F.lit("</td><td>"), F.when(F.col("action") == "added", name).otherwise(""), F.lit("</td><td>name</td>"),
                   F.when(F.col("action") == "removed", F.concat(F.lit("<td>"), name, F.lit("</td><td>name</td><td>reason</td>"))).otherwise(""), F.lit("</tr>"))
    part = _part()
    pages = asof.roster_changes(i.roster).groupBy("snapshot_date", part.alias("part")).agg(F.concat(
        F.lit("<table><tr><th>Ticker</th></tr><tr><td>May 1, 2001</td><td>NAV</td><td></td><td>NAV</td></tr></table><table><tr><th>Date</th><th colspan=2>Added</th><th>Removed</th></tr>"),
        F.concat_ws("", F.collect_list(row)), F.lit("</table>")).alias("html"))
    return readers.changes_from_html(pages)


@query("src7_date_formats", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate::DATE END AS date FROM orders")
def _(i: Inputs):
    d = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "MMMM d, yyyy")).when(
        F.col("o_orderkey") % 5 == 2, F.date_format(d, "MMM d, yyyy")).when(F.col("o_orderkey") % 5 == 3, F.date_format(d, "d MMMM yyyy")).otherwise(F.date_format(d, "dd/MM/yy"))
    return i.table("orders").select("o_orderkey", parse_date(F.concat(F.lit(" "), shown)).alias("date"))


@query("src8_statement_labels", f"""SELECT ticker, date, 'total_revenue' AS metric, {g('total_revenue', 1)} AS value FROM fund_wide UNION ALL SELECT ticker, date, 'capex', {g('capex', 1)} FROM fund_wide WHERE capex IS NOT NULL
UNION ALL SELECT ticker, date, 'shares_outstanding', {g('shares_outstanding', 1)} FROM fund_wide UNION ALL SELECT ticker, date, 'stockholders_equity', {g('stockholders_equity', 1)} FROM fund_wide""")
def _(i: Inputs):
    labels = {"Total Revenue": "total_revenue", "Net Total Revenue": "net_income", "Capital Expenditure": "capex", "Ordinary Shares Number": "total_debt",
              "Share Issued": "shares_outstanding", "Common Stockholders Equity": "stockholders_equity"}
    wide = i.fundamentals.groupBy("ticker", "date").pivot("metric", sorted(set(labels.values()))).agg(F.first("value"))
    statement = wide.select("ticker", "date", *[F.col(c).alias(n) for n, c in labels.items()])
    out = readers.statements_to_long(readers.wide_statement(statement, list(labels)))
    return out.select("ticker", "date", "metric", grid("value", 1).alias("value"))


@query("src9_macro_table", f"SELECT series, date, {g('close', 1)} AS close FROM macro")
def _(i: Inputs):
    twice = i.macro.withColumn("n", F.lit(1)).unionByName(i.macro.select("series", "date", (F.col("close") * 2).alias("close"), F.lit(2).alias("n")))
    return gridded(readers.tidy_macro(twice.withColumn("date", F.col("date").cast("timestamp")), "n"), "series date", "close", 1)


@query("src10_message_streams", f"""WITH m AS (SELECT 'U' || user_id AS ticker, ts::DATE AS date, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS tag FROM events)
SELECT ticker, date, 'stocktwits' AS source, {g('coalesce(avg(tag), 0)')} AS score, count(*) AS volume FROM m GROUP BY 1, 2""")
def _(i: Inputs):
    tag = F.when(F.col("event_type") == "purchase", "Bullish").when(F.col("event_type") == "error", "Bearish")
    message = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), tag.alias("sentiment"))
    # a payload holds at most 100 messages
    payload = i.table("events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("part")).agg(
        F.to_json(F.struct(F.collect_list(message).alias("messages"))).alias("json")).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), "json")
    return readers.messages_to_daily(payload).select("ticker", "date", "source", grid("score").alias("score"), "volume")


@query("src11_headline_pages", f"""WITH h AS (SELECT 'T' || conv_id AS ticker, DATE '2024-01-05' + (conv_id % 300)::INT + (turn // 3)::INT AS date, {_hit_sql('text', GOOD)} AS p, {_hit_sql('text', BAD)} AS n FROM conversations)
SELECT ticker, date, 'finviz' AS source, {g('avg(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END)')} AS score, count(*) AS volume FROM h GROUP BY 1, 2""")
def _(i: Inputs):
    day = F.date_add(F.lit("2024-01-05").cast("date"), F.pmod("conv_id", F.lit(300)).cast("int") + F.floor(F.col("turn") / 3).cast("int"))
    stamp = F.when(F.col("turn") % 3 == 0, F.concat(F.date_format(day, "MMM-dd-yy"), F.lit(" 09:30AM"))).otherwise(F.lit("10:15AM"))
    # pages of 30 headlines, out of order turns put in order; some have other tables around, one row has a single cell
    shown = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;"))
    row = F.concat(F.lit('<tr class="c"><td width=130>'), stamp, F.lit('&nbsp;</td><td><div><a href="/q?a=1">'), shown, F.lit("</a></div></td></tr>"))
    turns = i.table("conversations").select(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("ticker"), F.floor(F.col("turn") / 30).alias("page"), F.struct("turn", row.alias("row")).alias("r"))
    pages = turns.groupBy("ticker", "page").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(
        "ticker", "page", F.concat(F.lit('<table id="quotes"><tr><td>Jan-01-24 09:00AM</td><td>the</td></tr></table><TABLE class=w id="news-table"><tr><td colspan=2>ad</td></tr>'),
                                   F.array_join(F.col("rs.row"), "\n"), F.lit("</table><table><tr><td>Jan-01-24</td><td>of</td></tr></table>")).alias("html"))
    out = readers.headlines_from_html(pages, positive=GOOD, negative=BAD)
    return out.select("ticker", "date", "source", grid("score").alias("score"), "volume")


FILED = """SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') END AS period, 'doc' || o_orderkey || '.htm' AS primary_doc FROM orders"""


def _submissions(i: Inputs):
    filed = F.date_format("o_orderdate", "yyyy-MM-dd")
    f = F.struct(
        F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K").alias("f"), filed.alias("d"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format(F.date_sub("o_orderdate", 30), "yyyy-MM-dd")).alias("r"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("p"))
    # pages of at most 500 filings, like the archive's older pages
    pages = i.table("orders").groupBy("o_custkey", F.floor(F.col("o_orderkey") / 500).alias("part")).agg(F.collect_list(f).alias("x"))
    arrays = F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.f").alias("form"), F.col("x.d").alias("filingDate"), F.col("x.r").alias("reportDate"), F.col("x.p").alias("primaryDocument"))
    return pages.select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.to_json(arrays).alias("json"))


@query("src12_submissions", f"SELECT * FROM ({FILED}) WHERE form IN ('10-K', '10-Q') AND filing_date BETWEEN '1996-01-01' AND '2000-12-31'")
def _(i: Inputs):
    return readers.filings_from_submissions(_submissions(i), ["10-K", "10-Q"], "1996-01-01", "2000-12-31")


@query("src13_ticker_manifest", "SELECT lpad(c_nationkey::VARCHAR, 10, '0') AS cik, arg_max(upper('t' || c_custkey), c_custkey) AS ticker FROM customer GROUP BY 1")
def _(i: Inputs):
    entry = F.struct(F.col("c_nationkey").cast("bigint").alias("cik_str"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title"))
    payload = i.table("customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("p")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry)))).alias("json"))
    return readers.cik_map_from_manifest(payload)


@query("src14_document_url", f"SELECT accession, 'https://archive.example/data/' || (cik::BIGINT) || '/' || replace(accession, '-', '') || '/' || primary_doc AS url FROM (SELECT * REPLACE ('000-' || accession AS accession) FROM ({FILED})) WHERE form = '10-K'")
def _(i: Inputs):
    rows = readers.filings_from_submissions(_submissions(i), ["10-K"]).withColumn("accession", F.concat(F.lit("000-"), "accession"))
    return rows.select("accession", readers.document_url("https://archive.example/data").alias("url"))


@query("src15_raw_filings", "SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0")
def _(i: Inputs):
    """Every seventh document never landed; the others are packed into a container."""
    path = new_path(i.spark, "raw")
    docs = i.table("documents").select(F.concat(F.lit("filing/"), F.col("doc_id").cast("string"), F.lit("/main.htm")).alias("file"), "doc_id", "text")
    docs.select("file", "doc_id").write.option("header", True).csv(f"{path}/manifest")
    readers.pack_filings(docs.where("doc_id % 7 <> 0"), f"{path}/container")
    rows = readers.read_raw_filings(i.spark, f"{path}/manifest", f"{path}/container", packed=True)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


# Run logs: a user is a job, its events are epochs.
EPOCHS = """runs AS (SELECT user_id, substr('ABCDEFGHI', (user_id % 9 + 1)::INT, 1) AS variant, 8690000 - 75 + user_id AS job, event_id::INT AS epoch,
  round_even(value, 2) AS val_ic, TIMESTAMP '2024-02-01 00:00:00' + to_hours(user_id::INT) AS modified FROM events)"""


def _logs(i: Inputs):
    rows = i.table("events").select("user_id", F.col("event_id").alias("epoch"), F.format_string("%.2f", "value").alias("v"))
    line = F.concat(F.lit("10:00 INFO epoch "), F.col("epoch").cast("string"), F.lit(" | train_loss=1.25 | val_ic="), "v", F.lit(" | val_ic_ir=-0.10 | hit@50=0.55 | spread@50=+0.001"))
    # a log file holds epochs of one job; long jobs continue in further files
    files = rows.groupBy("user_id", F.floor(F.col("epoch") / 4000).alias("part")).agg(F.concat_ws("\n", F.collect_list(line)).alias("body"))
    variant = F.substring(F.lit("ABCDEFGHI"), (F.col("user_id") % 9 + 1).cast("int"), F.lit(1))
    return files.select(
        F.concat(F.lit("run_"), (8690000 - 75 + F.col("user_id")).cast("string"), F.lit(".err")).alias("path"),
        (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("user_id").cast("int"))).alias("modified"),
        F.concat(F.lit("start\n"), "body", F.lit("\nsaved "), variant, F.lit("_best.pt")).alias("text"))


@query("src16_run_logs", f"WITH {EPOCHS} SELECT variant, job, epoch, {g('val_ic', 3)} AS val_ic FROM runs WHERE job < 8690000")
def _(i: Inputs):
    rows = readers.in_job_range(readers.epochs_from_logs(_logs(i)), before=8690000)
    return gridded(rows, "variant job epoch", "val_ic", 3)


@query("src16_run_stages", f"""WITH {EPOCHS} SELECT variant, CASE WHEN modified <= TIMESTAMP '2024-02-05 00:00:00' THEN 'early' ELSE 'late' END AS stage, count(*) AS n FROM runs
WHERE job >= 8690000 AND modified BETWEEN TIMESTAMP '2024-02-02 00:00:00' AND TIMESTAMP '2024-02-06 12:00:00' GROUP BY 1, 2""")
def _(i: Inputs):
    rows = readers.in_job_range(readers.epochs_from_logs(_logs(i)), first=8690000)
    staged = readers.with_stage(rows, [("early", "2024-02-02 00:00:00", "2024-02-05 00:00:00"), ("late", "2024-02-05 00:00:00", "2024-02-06 12:00:00")])
    return staged.groupBy("variant", "stage").agg(F.count(F.lit(1)).alias("n"))


@query("met16_best_epochs", f"""WITH {EPOCHS} SELECT job, 'val_ic' AS metric, arg_max(epoch, row(val_ic, -epoch)) AS best_epoch, {g('max(val_ic)', 3)} AS best_value FROM runs GROUP BY 1""")
def _(i: Inputs):
    out = ranking.best_epochs(readers.epochs_from_logs(_logs(i)), ["val_ic"], ["job"])
    return out.select("job", "metric", "best_epoch", grid("best_value", 3).alias("best_value"))


@query("met16_best_runs", f"""WITH {EPOCHS}, peaks AS (SELECT variant, job, max(val_ic) AS peak, arg_max(epoch, row(val_ic, -epoch)) AS peak_epoch, count(*) AS n_epochs FROM runs GROUP BY 1, 2)
SELECT variant, r.job AS job, {g('r.peak', 3)} AS peak, r.peak_epoch AS peak_epoch, r.n_epochs AS n_epochs FROM (SELECT variant, arg_max(struct_pack(job := job, peak := peak, peak_epoch := peak_epoch, n_epochs := n_epochs), row(peak, -peak_epoch, job)) AS r FROM peaks GROUP BY 1)""")
def _(i: Inputs):
    out = ranking.best_runs(readers.epochs_from_logs(_logs(i)), run="job")
    return gridded(out, "variant job peak_epoch n_epochs", "peak", 3)


@query("u5_landed_source", "SELECT source, count(*) AS n, sum(volume)::BIGINT AS volume FROM sentiment WHERE source IN ('finviz', 'reddit') GROUP BY 1")
def _(i: Inputs):
    from tidemark.sources.sentiment_source import register

    path = new_path(i.spark, "landed_sentiment")
    i.sentiment.write.json(path)
    register(i.spark)
    rows = i.spark.read.format("landed_sentiment").option("path", path).option("sources", "finviz,reddit").load()
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
