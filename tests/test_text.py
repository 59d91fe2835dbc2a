"""Filings text, drift, payload readers."""

from html import unescape

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panels import day
from tidemark.functions.vectors import cosine_distance
from tidemark.functions.words import parse_date, polarity
from tidemark.operators import drift, text
from tidemark.sources import readers


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression.alias("y")).first().y


def test_html_to_text(spark):
    html = "<p>One&nbsp;two</p><SCRIPT type='a'>var x='<p>'</SCRIPT><table><tr><td>9<table><tr><td>8</td></tr></table>7</td></tr></table><style>b{}</style><!-- no -->three &amp; four"
    assert _one(spark, html, text.normalise_space(text.strip_tags("x"))) == "One two three & four"
    assert _one(spark, " a  b​c \n d ", text.normalise_space("x")) == "a bc d"


TOC = "Index Item 1A. Item 7. Item 7A. Item 8. "
ANNUAL = TOC + "Item 1A. Risks are many. Item 7. We did well. Item 7A. Markets move. Item 8. Tables."


def test_sections(spark):
    rows = [
        ("10-K", ANNUAL), ("10-K/A", ANNUAL), ("8-K", ANNUAL), ("10-K", None),
        ("10-K", "ITEM 7: once only, no end"),
        ("10-K", TOC + "Item 1A. R. Item 7. Only eight ends. Item 8. T."),
        ("10-Q", "Part I Item 2. Talk. Part I Item 3. Risk numbers. Part II Item 2. Rest."),
    ]
    df = spark.createDataFrame([(k, f, t) for k, (f, t) in enumerate(rows)], "id int, form string, text string")
    out = {r.id: r for r in text.parse_filings(df).collect()}
    for k in (0, 1):
        assert (out[k].risk_factors, out[k].mda, out[k].market_risk) == ("Risks are many.", "We did well.", "Markets move.")
    assert out[2].is_empty and out[2].mda == "" and out[2].raw_length == len(ANNUAL)
    assert out[3].bad and out[3].is_empty
    assert out[4].mda == "once only, no end" and out[4].risk_factors == ""
    # without the later item the rest of the contents line is the first end found
    assert out[5].mda == "Only eight ends." and out[5].len_mda == 16
    assert (out[6].mda, out[6].market_risk, out[6].risk_factors) == ("Talk.", "Risk numbers.", "")


def test_sentences_and_roll_up(spark):
    body = "This is the first sentence of the text. short. Here comes another long sentence! 123 is no start of one."
    got = _one(spark, body, text.sentences("x"))
    assert got == ["This is the first sentence of the text. short.", "Here comes another long sentence! 123 is no start of one."]
    scored = spark.createDataFrame([("a", 0.4, 0.4, 0.2), ("a", 0.2, 0.4, 0.4), ("a", 0.1, 0.1, 0.8)], "k string, p_pos double, p_neg double, p_neu double")
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    out = {r.k: r for r in text.roll_up_sentences(keys, scored, ["k"]).collect()}
    assert out["a"].frac_positive == out["a"].frac_negative == out["a"].frac_neutral == pytest.approx(1 / 3)
    assert out["a"].mean_score == pytest.approx(-0.2 / 3) and tuple(out["b"])[1:] == (0, 0.0, 0.0, 0.0, 0.0)


def test_default_scorer_and_polarity(spark):
    assert _one(spark, "Strong gain, record LOSS gain", polarity("x")) == 0.5
    assert _one(spark, "nothing here", polarity("x")) == 0.0
    p = _one(spark, "shares surge and soar after weak start", text.lexicon_probabilities("x"))
    assert (p.p_pos, p.p_neg, p.p_neu) == (0.5, 0.25, 0.25)


def test_truncation_and_embedding(spark):
    assert _one(spark, "a" * 30 + "b" * 30, text.truncate_middle("x", 20)) == "a" * 10 + " ... " + "b" * 10
    df = spark.createDataFrame([(1, "red green red"), (2, ""), (3, "red green red")], "id int, text string")
    out = {r.id: r.embedding for r in text.embed_sections(df, dim=32).collect()}
    assert out[1] == out[3] and sum(v * v for v in out[1]) == pytest.approx(1.0) and not any(out[2])


def _filings(spark):
    rows = []
    for c in ("1", "2"):
        for k, p in enumerate(["2018-03-31", "2018-06-30", "2018-09-30", "2018-12-31", "2019-03-31", "2021-03-31"]):
            v = [0.0, 0.0] if (c, k) == ("2", 2) else [1.0, float(k + (c == "2"))]
            rows.append((c, f"{c}-{k}", "10-Q", p, "mda", v))
    return spark.createDataFrame(rows, "cik string, accession string, form string, period string, section_name string, embedding array<float>")


def test_drift(spark):
    sectors = spark.createDataFrame([("1", "X"), ("2", "X")], "cik string, sector string")
    out = {r.accession: r for r in drift.drift_features(_filings(spark), sectors=sectors).collect()}

    def cos(a, b):
        n = lambda v: (v[0] ** 2 + v[1] ** 2) ** 0.5
        return 1 - (a[0] * b[0] + a[1] * b[1]) / (n(a) * n(b))

    assert out["1-0"].drift_qoq is None and out["1-1"].drift_qoq == pytest.approx(cos([1, 1], [1, 0]))
    assert out["2-2"].drift_qoq is None and out["2-3"].drift_qoq is None          # a zero vector on either side
    assert out["1-4"].drift_yoy == pytest.approx(cos([1, 4], [1, 1]))             # 270 to 395 days back, the latest
    assert out["1-5"].drift_yoy is None
    assert out["1-1"].drift_peer == pytest.approx(cos([1, 1], [1, 1.5]))
    assert drift.drift_features(_filings(spark)).where("drift_peer is not null").count() == 0
    assert drift.drift_features(_filings(spark), section="risk_factors").count() == 0


def test_filing_features_reach_days_after_filing_only(spark):
    d = drift.drift_features(_filings(spark)).where("cik = '1'")
    filings = d.select("cik", "period", "form", F.date_add("period", 40).alias("filing_date"))
    sent = d.select("cik", "period", "form", F.lit(0.1).alias("mean_score"), F.lit(0.2).alias("frac_negative"))
    days = spark.createDataFrame([("T", day("2018-05-01")), ("T", day("2018-05-10")), ("T", day("2018-08-15"))], "ticker string, date date")
    ciks = spark.createDataFrame([("1", "T")], "cik string, ticker string")
    out = {str(r.date): r for r in drift.filing_features_daily(d, sent, filings, ciks, days).collect()}
    assert out["2018-05-01"].mean_score is None and out["2018-05-10"].mean_score == 0.1
    assert out["2018-05-10"].drift_qoq is None and out["2018-08-15"].drift_qoq is not None
    early = {str(r.date): r for r in drift.filing_features_daily(d, sent, filings, ciks, days, "period").collect()}
    assert early["2018-05-01"].mean_score == 0.1


def test_cosine_of_missing(spark):
    df = spark.createDataFrame([([1.0, 0.0], None), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    assert [r.d for r in df.select(cosine_distance("a", "b").alias("d")).collect()] == [None, 1.0]


def test_dates(spark):
    for shown in ("2024-03-05", "March 5, 2024", "Mar 5, 2024", " 5 March 2024 "):
        assert _one(spark, shown, parse_date("x")) == day("2024-03-05")
    assert _one(spark, "05/03/24", parse_date("x")) is None


def test_rosters(spark, tmp_path):
    (tmp_path / "r.csv").write_text('Date,Tickers\n2024-01-02,"aapl, MSFT,,"\n2024-02-01,"MSFT"\n')
    out = {(str(r.snapshot_date), r.ticker) for r in readers.read_roster_csv(spark, str(tmp_path / "r.csv")).collect()}
    assert out == {("2024-01-02", "AAPL"), ("2024-01-02", "MSFT"), ("2024-02-01", "MSFT")}
    (tmp_path / "e.csv").write_text("Date,Tickers\n")
    with pytest.raises(ValueError):
        readers.read_roster_csv(spark, str(tmp_path / "e.csv"))
    (tmp_path / "r.json").write_text('{\n "2024-01-02": ["A", "B"],\n "2024-02-01": []\n}')
    assert readers.read_roster_json(spark, str(tmp_path / "r.json")).count() == 2


def test_html_tables(spark):
    page = """<table><tr><td>NAV</td></tr></table><table id="constituents"><tr><th>Symbol</th></tr><tr><td><a href='x'>BRK.B</a></td><td>Berk</td></tr><tr class="r"><th> mmm </th><td>3M</td></tr></table><table><tr><td>FOOTER</td></tr></table>"""
    df = spark.createDataFrame([(page,)], "html string")
    assert {r.ticker for r in readers.constituents_from_html(df).collect()} == {"BRK-B", "MMM"}
    with pytest.raises(Exception, match="no table of constituents"):
        readers.constituents_from_html(spark.createDataFrame([("<table><tr><td>x</td></tr></table>",)], "html string")).collect()
    change = "<table><tr><th>Date</th><th>Added</th><th>Removed</th></tr><tr><td>March 5, 2024</td><td>BF.B</td><td>n</td><td>XYZ</td><td>n</td></tr><tr><td>unknown</td><td>A</td><td></td><td></td></tr><tr><td>Mar 6, 2024</td><td></td><td></td><td>Q</td></tr><tr><td>Mar 7, 2024</td><td>NEW</td><td>n</td></tr></table>"
    out = {(str(r.date), r.ticker, r.action) for r in readers.changes_from_html(spark.createDataFrame([(change,)], "html string")).collect()}
    assert out == {("2024-03-05", "BF-B", "added"), ("2024-03-05", "XYZ", "removed"), ("2024-03-06", "Q", "removed"), ("2024-03-07", "NEW", "added")}


def test_tables_of_any_depth_and_all_references(spark):
    deep = "a<table><table><table><table><table>x</table></table>y</table></table >z</TABLE>b<table>never closed"
    assert _one(spark, deep, text.strip_tags("x")) == "a b never closed"
    refs = "Item&#160;7. &#8217;&#x2019; &amp;lt; &eacute;&nbsp;&unknown; &#128; &#0; & &#xD800; AT&T &#x1F600;"
    assert _one(spark, refs, text.strip_tags("x")) == unescape(refs)


def test_statements_prefer_the_first_alias(spark):
    rows = [("A", day("2024-03-31"), "Net Income Common", 1, 5.0), ("A", day("2024-03-31"), "Net Income", 2, 6.0),
            ("A", day("2024-03-31"), "Ordinary Shares Number", 3, 7.0), ("A", day("2024-03-31"), "Share Issued", 4, 8.0), ("A", day("2024-06-30"), "Share Issued", 4, None)]
    df = spark.createDataFrame(rows, "ticker string, date date, label string, label_pos int, value double")
    assert {(r.metric, r.value) for r in readers.statements_to_long(df).collect()} == {("net_income", 5.0), ("shares_outstanding", 8.0)}


def test_headlines_carry_the_date_down(spark):
    rows = [("A", 0, 0, "Jan-05-24 09:30AM", "stocks surge"), ("A", 0, 1, "10:00AM", "big miss"), ("A", 0, 2, "Jan-04-24 08:00AM", "plain"), ("B", 0, 0, "10:00AM", "no date")]
    df = spark.createDataFrame(rows, "ticker string, page int, pos int, stamp string, headline string")
    assert {(str(r.date), r.score, r.volume) for r in readers.headlines_to_daily(df).collect()} == {("2024-01-05", 0.0, 2), ("2024-01-04", 0.0, 1)}


def test_messages(spark):
    body = '{"messages": [{"created_at": "2024-01-02T10:00:00Z", "sentiment": "Bullish"}, {"created_at": "2024-01-02T11:00:00Z", "sentiment": null}, {"created_at": "2024-01-03T11:00:00Z"}]}'
    out = {(str(r.date), r.score, r.volume) for r in readers.messages_to_daily(spark.createDataFrame([("A", body)], "ticker string, json string")).collect()}
    assert out == {("2024-01-02", 1.0, 2), ("2024-01-03", 0.0, 1)}


def test_submissions_manifest_and_urls(spark):
    body = '{"accessionNumber": ["1-2", "3-4", "5-6"], "form": ["10-K", "10-Q", "4"], "filingDate": ["2024-02-01", "2023-05-01", "2024-01-01"], "reportDate": ["", "2023-03-31", ""], "primaryDocument": ["a.htm", "b.htm", "c.xml"]}'
    df = spark.createDataFrame([("0000000012", body)], "cik string, json string")
    out = {r.accession: r for r in readers.filings_from_submissions(df, ["10-K", "10-Q"], "2023-05-01").withColumn("url", readers.document_url("https://x.example/d/")).collect()}
    assert set(out) == {"1-2", "3-4"} and out["1-2"].period == "2024-02-01" and out["3-4"].period == "2023-03-31"
    assert out["1-2"].url == "https://x.example/d/12/12/a.htm"
    manifest = '{"0": {"cik_str": 5, "ticker": "goog", "title": "G"}, "1": {"cik_str": 5, "ticker": "googl", "title": "G"}}'
    got = readers.cik_map_from_manifest(spark.createDataFrame([(manifest,)], "json string")).first()
    assert tuple(got) == ("0000000005", "GOOGL")


def test_raw_filings_skip_missing_files(spark, tmp_path):
    (tmp_path / "raw" / "1").mkdir(parents=True)
    (tmp_path / "raw" / "1" / "a.txt").write_text("line one\nline two")
    (tmp_path / "m.csv").write_text("cik,accession,file\n1,a,1/a.txt\n1,b,1/b.txt\n")
    out = readers.read_raw_filings(spark, str(tmp_path / "m.csv"), str(tmp_path / "raw")).collect()
    assert [(r.accession, r.text) for r in out] == [("a", "line one\nline two")]


def test_run_logs_and_artefacts(spark, tmp_path):
    line = "x epoch {} | train_loss=1.50 | val_ic={} | val_ic_ir=0.10 | hit@50=0.55 | spread@50=+0.001"
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "job_12.err").write_text("\n".join([line.format(1, "0.02"), line.format(2, "-0.01"), "saved B_best.pt"]))
    (logs / "job_13.err").write_text("nothing")
    out = readers.epochs_from_logs(readers.read_run_logs(spark, str(logs))).orderBy("epoch").collect()
    assert [(r.variant, r.job, r.epoch, r.val_ic, r.spread) for r in out] == [("B", 12, 1, 0.02, 0.001), ("B", 12, 2, -0.01, 0.001)]
    runs = tmp_path / "runs"
    for v, body in (("A", '{"backtest": {"sharpe": 1.5}, "regimes": {"bull": {"n_days": 3}}}'), ("B", "{broken")):
        (runs / v).mkdir(parents=True)
        (runs / v / "summary.json").write_text(body)
        (runs / v / "daily_returns.csv").write_text("date,ret\n2024-01-02,0.1\n")
    got = readers.read_run_summaries(spark, str(runs)).collect()
    assert [(r.variant, r.backtest.sharpe, r.regimes["bull"].n_days) for r in got] == [("A", 1.5, 3)]
    assert readers.read_run_series(spark, str(runs), "daily_returns", "ret").count() == 2


def test_price_files_keep_the_first_row(spark, tmp_path):
    frame = pd.DataFrame({"date": pd.to_datetime(["2024-01-02", "2024-01-02", "2024-01-03"]), "open": [1.0, 2.0, float("nan")], "high": 1.0, "low": 1.0, "close": 1.0, "adj_close": 1.0, "volume": 5})
    frame.to_parquet(tmp_path / "ABC.parquet", coerce_timestamps="us")
    out = readers.read_prices(spark, str(tmp_path), ticker_files=True).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.open, r.dividends) for r in out] == [("ABC", "2024-01-02", 1.0, 0.0), ("ABC", "2024-01-03", None, 0.0)]
    with pytest.raises(KeyError):
        readers.normalise_vendor_bars(spark.createDataFrame([("2024-01-02", 1.0)], "Date string, Open double"))


def test_headline_pages(spark):
    html = ('<p>x</p><table id="other"><tr><td>Jan-01-24</td><td>good</td></tr></table>'
            '<table class="n" id=news-table><tr><td colspan="2">ad</td></tr><tr><td>10:00AM</td><td>no date yet</td></tr>'
            '<tr><td> Jan-05-24 09:30AM&nbsp;</td><td><a href="#">AT&amp;T &lt;good&gt;</a> good</td></tr><tr><td>08:00AM</td><td>bad</td></tr></table>')
    pages = spark.createDataFrame([("A", 1, html), ("B", 1, "<p>nothing</p>"), ("C", 1, None)], "ticker string, page int, html string")
    rows = readers.headline_rows(pages).collect()
    assert {(r.ticker, r.stamp.strip("\xa0 "), r.headline) for r in rows} == {("A", "10:00AM", "no date yet"), ("A", "Jan-05-24 09:30AM", "AT&T <good> good"), ("A", "08:00AM", "bad")}
    out = readers.headlines_from_html(pages, positive=["good"], negative=["bad"]).collect()
    assert [(r.ticker, str(r.date), r.score, r.volume) for r in out] == [("A", "2024-01-05", 0.0, 2)]


def test_filings_in_a_container(spark, tmp_path):
    for k in range(40):
        (tmp_path / "raw" / f"c{k % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / f"c{k % 3}" / f"{k:02d}.htm").write_text(f"text {k}\nmore")
    texts = readers.read_filing_texts(spark, str(tmp_path / "raw"))
    readers.pack_filings(texts, str(tmp_path / "container"), files=4)
    (tmp_path / "m.csv").write_text("file,cik\n" + "".join(f"c{k % 3}/{k:02d}.htm,{k}\n" for k in range(50)))
    plain, packed = (readers.read_raw_filings(spark, str(tmp_path / "m.csv"), str(tmp_path / p), packed=q) for p, q in (("raw", False), ("container", True)))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, packed.collect())) and packed.count() == 40
    (one,) = readers.read_filing(spark, str(tmp_path / "container"), "c1/04.htm").collect()
    assert one.text == "text 4\nmore"
    assert [r.file for r in readers.read_filing(spark, str(tmp_path / "container"), "c2/", "c2/08.htm").orderBy("file").collect()] == ["c2/02.htm", "c2/05.htm", "c2/08.htm"]


def test_first_price_row_needs_no_sort(spark, tmp_path):
    schema = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
    rows = [("A", day("2024-01-02"), *[float(k)] * 6) for k in range(6)] + [("B", day("2024-01-02"), *[9.0] * 6)]
    spark.createDataFrame(rows[:3] + rows[6:], schema).coalesce(1).write.parquet(str(tmp_path / "bars" / "part=1"))
    spark.createDataFrame(rows[3:6], schema).coalesce(1).write.parquet(str(tmp_path / "bars" / "part=2"))
    df = readers.read_prices(spark, str(tmp_path / "bars"))
    assert {(r.ticker, r.close) for r in df.collect()} == {("A", 0.0), ("B", 9.0)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_unreadable_roster_dates_raise(spark):
    rows = spark.createDataFrame([("2024-01-02", "A,B"), ("sometime", "C")], "date string, tickers string")
    assert readers.roster_from_rows(rows.limit(1)).count() == 2
    with pytest.raises(Exception, match="unreadable roster date: sometime"):
        readers.roster_from_rows(rows).collect()


def test_embeddings_are_not_rounded_to_single_precision(spark):
    """Values beside a border of the grid, which single precision puts on its other side."""
    from tidemark.plans.q_text import shape, shape_embedding
    from tidemark.plans.registry import grid

    df = spark.createDataFrame([(1, " " * 113 + "a" * 121), (2, " " * 163 + "a" * 320), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (str(r.x), str(r.y)) for r in shape(text.embed_sections(df, shape_embedding)).collect()}
    assert got == {1: ("0.9", "0.435"), 2: ("0.948", "0.32"), 3: ("nan", "nan"), 4: ("None", "None")}
    words = spark.createDataFrame([("red " * 155 + "green " * 197,)], "text string")
    values = text.embed_sections(words, dim=32).select(F.explode("embedding").alias("v")).where("v > 0").select(grid("v").alias("v"))
    exact = [n / (155 * 155 + 197 * 197) ** 0.5 for n in (155, 197)]
    assert sorted(r.v for r in values.collect()) == [int(x * 1e4 + 0.5003) / 1e4 for x in exact]
