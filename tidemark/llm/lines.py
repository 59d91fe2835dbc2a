"""Line dedup by range-partitioned hashes; DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Lines of
long enough keys that enough documents hold are dropped everywhere but in the document with the
largest id. Work goes on over (two 64-bit hashes of the key, document, position), never over text:
the hashes are range-partitioned with a secondary sort by document and position, a stream over each
key's rows passes on its first documents only, and what comes back is a keep bitmap per document,
compressed as run lengths ``[kept, dropped, kept, dropped, ...]`` (lines after the last run are kept).

Rules for odd rows: a null or empty text is one empty line; rows without an id count as one
document, smaller than all; rows that repeat an id count as one document but have bitmaps of
their own. Input columns may have any names; helper columns start with ``_ln_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower
from tidemark.session import cut_lineage

NO_ID = -(1 << 63)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _row(documents: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_ln_id"), F.xxhash64(F.col(text)).alias("_ln_row")]


def keep_bitmaps(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text",
                 salts: int = 64) -> DataFrame:
    """``(_ln_id, _ln_row, keep_runs, n_dropped)`` for the documents that lose a line.

    A key that a large share of all documents holds is combined before each shuffle and dealt
    over ``salts`` ranges, of which each passes on at most ``min_docs`` documents.
    """
    lines = documents.select(*_row(documents, doc_id, text), F.posexplode(split_lines(F.col(text))).alias("_ln_pos", "_ln_line"))
    lines = lines.where(F.length("_ln_line") >= min_chars).withColumn("_ln_line", line_key(F.col("_ln_line")))
    lines = lines.where(F.length("_ln_line") >= min_chars).select(
        F.xxhash64("_ln_line").alias("_ln_h1"), F.xxhash64(F.lit(1), "_ln_line").alias("_ln_h2"), "_ln_id", "_ln_row", "_ln_pos")
    # keys on fewer lines than that are on fewer documents; one row per key and task is shuffled
    repeated = cut_lineage(lines.groupBy("_ln_h1", "_ln_h2").agg(F.count("*").alias("_ln_n")).where(F.col("_ln_n") >= min_docs).drop("_ln_n"))
    found = cut_lineage(lines.join(repeated, ["_ln_h1", "_ln_h2"]))

    key = ["_ln_h1", "_ln_h2", "_ln_salt"]
    salted = found.withColumn("_ln_salt", F.pmod(F.xxhash64("_ln_id"), F.lit(salts))).repartitionByRange(*key)
    w = Window.partitionBy(*key).orderBy(F.col("_ln_id").desc(), "_ln_pos")
    firsts = salted.select(*key, "_ln_id", F.dense_rank().over(w).alias("_ln_k"), F.lag("_ln_id").over(w).alias("_ln_before"))
    firsts = firsts.where((F.col("_ln_k") <= min_docs) & ~F.col("_ln_id").eqNullSafe(F.col("_ln_before")))
    keepers = firsts.groupBy("_ln_h1", "_ln_h2").agg(F.count_distinct("_ln_id").alias("_ln_docs"), F.max("_ln_id").alias("_ln_keeper"))
    keepers = cut_lineage(keepers.where(F.col("_ln_docs") >= min_docs).drop("_ln_docs"))

    gone = found.join(keepers, ["_ln_h1", "_ln_h2"]).where("_ln_id <> _ln_keeper").select("_ln_id", "_ln_row", "_ln_pos")
    row = Window.partitionBy("_ln_id", "_ln_row").orderBy("_ln_pos")
    # dense, as rows that repeat a whole document drop the same positions
    runs = gone.withColumn("_ln_run", F.col("_ln_pos") - F.dense_rank().over(row)).groupBy("_ln_id", "_ln_row", "_ln_run").agg(
        F.min("_ln_pos").alias("_ln_pos"), F.max("_ln_pos").alias("_ln_end"))
    runs = runs.withColumn("_ln_gap", F.col("_ln_pos") - 1 - F.coalesce(F.lag("_ln_end").over(row), F.lit(-1)))
    length = F.col("_ln_end") - F.col("_ln_pos") + 1
    bitmaps = runs.groupBy("_ln_id", "_ln_row").agg(
        F.array_sort(F.collect_list(F.struct("_ln_pos", "_ln_gap", length.alias("_ln_len")))).alias("_ln_runs"), F.sum(length).alias("n_dropped"))
    return bitmaps.select("_ln_id", "_ln_row", F.flatten(F.transform("_ln_runs", lambda r: F.array(r["_ln_gap"], r["_ln_len"]))).alias("keep_runs"), "n_dropped")


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``_ln_kept`` (the lines that stay), ``_ln_lines`` and ``_ln_dropped``."""
    rows = documents.select("*", *_row(documents, doc_id, text)).join(bitmaps, ["_ln_id", "_ln_row"], "left")
    keep = F.flatten(F.transform(F.col("keep_runs"), lambda n, i: F.array_repeat(i % 2 == 0, n.cast("int"))))
    lines = split_lines(F.col(text))
    kept = F.array_join(F.zip_with(lines, keep, lambda line, k: F.when(F.coalesce(k, F.lit(True)), line)), "\n")
    return rows.select(
        *[documents[c] for c in documents.columns], F.when(F.col("keep_runs").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept).alias("_ln_kept"),
        F.size(lines).cast("long").alias("_ln_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_ln_dropped"))


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with the kept lines as their text; null texts stay null."""
    done = apply_bitmaps(documents, keep_bitmaps(documents, min_chars, min_docs))
    return done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("_ln_kept"))).select(*documents.columns)
