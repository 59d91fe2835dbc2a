"""WARC archives: written with Spark's text writer, read back with boundary-chain verification.

Readers of large archives start in the middle of files, where the record magic may as well be part
of a payload. So each split of a file is cut at every magic, and each cut is a candidate record that
names its successor: its own offset plus the length its header states. Only candidates that are
reached from the start of the file by following successors are records. Which ones those are is
found by pointer jumping: every round doubles the length of all jumps, so the number of rounds is
logarithmic in the records of a file. Payloads that hold magics, even whole records, come back whole.

Rules for odd rows: a null payload is empty; records with payloads under ``least`` bytes are never
revisits; rows without an id are written but are never revisits or referred to; rows that repeat
the smallest id of a payload are responses all; of rows that repeat an id with other payloads each
is decided by its own; empty tables give no records; addresses keep only
printable ASCII, so that no header can break, and pages without one are at ``urn:page:none``. Extra columns are not written.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

VERSION = "WARC/1.0"
MAGIC = VERSION + "\r\n"
HEADER_END = "\r\n\r\n"
AFTER = len(HEADER_END)
# Fixed value: the standard's name for a revisit of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """``id, digest, refers_to`` of the pages whose payload a smaller id holds. Payloads are not shuffled."""
    rows = pages.where("page_id is not null").select("page_id", F.col("html").cast("binary").alias("body"))
    rows = rows.where(F.octet_length("body") >= least).select("page_id", F.sha2("body", 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").drop("k")
    # written first, so that a digest that very many pages share is a skewed join that Spark splits
    found = rows.join(cut_lineage(first), "digest").where("page_id <> refers_to")
    return cut_lineage(found.select(F.col("page_id").alias("id"), "digest", "refers_to").distinct())


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str | None = None) -> None:
    """A record per row of ``pages(page_id, url, html)`` in the files of folder ``path``.

    ``date`` is when the pages were fetched, in UTC to the second; the time of the call if not given.
    """
    date = date or f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.join(revisits(pages, least), (F.col("page_id") == F.col("id")) & (F.sha2(F.col("html").cast("binary"), 256) == F.col("digest")), "left")
    again = F.col("refers_to").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")

    def urn(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    header = F.concat_ws(
        "\r\n", F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.nullif(F.regexp_replace("url", r"[^\x21-\x7E]", ""), F.lit("")), F.lit("urn:page:none"))),
        F.lit("Content-Type: text/html; charset=UTF-8"),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.sha2(F.col("html").cast("binary"), 256)),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("html").cast("string")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.octet_length("html")).cast("string")))
    # the writer ends each record with its line separator, the last byte of a record
    record = F.concat(header, F.lit(HEADER_END), F.when(again, F.lit("")).otherwise(F.col("html")), F.lit(HEADER_END[:-1]))
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def cuts_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, order, value``: files cut at every magic; ``order`` counts within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("order"), "value")


def with_offsets(cuts: DataFrame) -> DataFrame:
    """Cuts of ``file, split, order, bytes, ...`` with the offset ``start`` of their magic.

    Offsets are sums of lengths: within a split, then over the splits of a file. The first cut of a
    file is what precedes its first magic, nothing, and is left out.
    """
    size = F.col("bytes") + len(MAGIC)
    lengths = cuts.groupBy("file", "split").agg(F.sum(size).alias("length"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.select("file", "split", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("base"))
    before = F.sum(size).over(Window.partitionBy("file", "split").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    placed = cuts.withColumn("before", F.coalesce(before, F.lit(0))).join(bases, ["file", "split"])
    return placed.withColumn("start", F.col("base") + F.col("before") - len(MAGIC)).drop("base", "before").where("start >= 0")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, order, start, next``: each cut with its offset and that of its successor, null without a header."""
    narrow = cuts_of(spark, path).select("file", "split", "order", F.octet_length("value").cast("long").alias("bytes"),
                                         header_end(F.col("value")).alias("head"), stated_length(F.col("value")).alias("stated"))
    following = F.col("start") + len(MAGIC) + F.col("head") + AFTER + F.col("stated") + AFTER
    return with_offsets(narrow).select("file", "split", "order", "start", following.alias("next"))


def header_end(value):
    """Bytes of the header behind the magic; null without an end of the header."""
    at = F.instr(value, HEADER_END)
    return F.when(at > 0, F.octet_length(F.substring_index(value, HEADER_END, 1)).cast("long"))


def field(value, name: str):
    header = F.substring_index(value, HEADER_END, 1)
    found = F.regexp_extract(header, rf"(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def stated_length(value):
    return field(value, "Content-Length").try_cast("long")


def reachable(found: DataFrame) -> DataFrame:
    """``file, start`` of the candidates that a chain of successors reaches from offset 0.

    Each round a jump becomes two jumps, and what the jump of a reached record hits is reached.
    """
    steps = cut_lineage(found.select("file", "start", F.col("next").alias("jump"), (F.col("start") == 0).alias("reached")))
    # a chain has at most as many records as its file has candidates
    longest = steps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    rounds = max(0, longest - 1).bit_length()
    for _ in range(rounds):
        hit = steps.where("reached and jump is not null").select("file", F.col("jump").alias("start"), F.lit(True).alias("hit"))
        ahead = steps.select("file", F.col("start").alias("jump"), F.col("jump").alias("further"))
        steps = steps.join(hit, ["file", "start"], "left").join(ahead, ["file", "jump"], "left")
        steps = cut_lineage(steps.select("file", "start", F.col("further").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
    return steps.where("reached").select("file", "start")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``page_id, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Size and digest are those of the full payload: of the content for responses, where they are
    checked against the header, and as the header has them for revisits.
    """
    found = cut_lineage(candidates(spark, path))
    real = reachable(found).withColumn("real", F.lit(True))
    marked = found.join(real, ["file", "start"], "left")
    # a cut at a magic within a payload belongs to the record before it; split by split, then over splits
    inside = Window.partitionBy("file", "split").orderBy("order")
    own = F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True)
    lasts = marked.groupBy("file", "split").agg(F.max(F.when(F.col("real"), F.col("start"))).alias("last"))
    lasts = lasts.select("file", "split", F.max("last").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    placed = marked.withColumn("record", own.over(inside)).join(lasts, ["file", "split"])
    placed = placed.select("file", "start", F.coalesce("record", "carried").alias("record"), F.coalesce("real", F.lit(False)).alias("real"))
    broken = cut_lineage(placed.where("not real").select("file", "record").distinct())
    # files without a magic in a payload need no offsets a second time: each of their cuts is a record
    cuts = cuts_of(spark, path)
    whole = cuts.join(broken.select("file").distinct(), "file", "left_anti").where("value <> ''").select("value")
    odd = cuts.join(broken.select("file").distinct(), "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long"))
    pieces = with_offsets(odd).join(placed.drop("real"), ["file", "start"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"))
    joined = pieces.select(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    return parsed(whole.unionByName(joined))


def parsed(records: DataFrame) -> DataFrame:
    """Header fields and content of records without their magic."""
    value = F.col("value")
    content = F.substring(value.cast("binary"), header_end(value).cast("int") + AFTER + 1, stated_length(value).cast("int"))
    number = r"<urn:page:(-?\d*)>"
    rows = records.select(
        F.regexp_extract(field(value, "WARC-Record-ID"), number, 1).try_cast("long").alias("page_id"), field(value, "WARC-Type").alias("record_type"),
        F.regexp_extract(field(value, "WARC-Refers-To"), number, 1).try_cast("long").alias("refers_to"),
        F.regexp_replace(field(value, "WARC-Payload-Digest"), "^sha256:", "").alias("stated_digest"),
        field(value, "X-Payload-Length").cast("long").alias("stated_bytes"), content.alias("payload"))
    full = F.col("record_type") == "response"
    digest = F.when(full, F.sha2("payload", 256)).otherwise(F.col("stated_digest"))
    wrong = full & ((F.sha2("payload", 256) != F.col("stated_digest")) | (F.octet_length("payload") != F.col("stated_bytes")))
    return rows.select(
        "page_id", "record_type", "refers_to", F.when(full, F.octet_length("payload")).otherwise(F.col("stated_bytes")).cast("long").alias("payload_bytes"),
        F.when(wrong, F.raise_error(F.lit("a payload differs from its digest"))).otherwise(digest).alias("payload_digest"), "payload")
