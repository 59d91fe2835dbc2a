"""Embedding drift between filings, and filing features on trading days.

A (cik, form) has a few filings a year, which bounds its windows and its range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine_distance
from tidemark.operators.asof import as_of

DRIFT = ["drift_qoq", "drift_yoy", "drift_peer"]


def drift_features(
    embeddings: DataFrame, section: str = "mda", sectors: DataFrame | str | None = None,
    nearest_days: int = 270, farthest_days: int = 395,
) -> DataFrame:
    """(cik, period, form, accession, drift_qoq, drift_yoy, drift_peer) for one section.

    Against the previous filing of the same form; against the latest one 270 to 395 days
    earlier; against the mean embedding of the sector (itself included) in that period.
    ``sectors`` is (cik, sector), or the name of a column in which each filing has its own; without
    it peer drift is null.
    """
    named = [F.col(sectors).alias("sector")] if isinstance(sectors, str) else []
    rows = embeddings.where(F.col("section_name") == section).select(
        "cik", "accession", "form", F.to_date("period").alias("period"), "embedding", *named)
    w = Window.partitionBy("cik", "form").orderBy("period", "accession")
    rows = rows.withColumn("_prev", F.lag("embedding").over(w))

    past = rows.select(
        "cik", "form", F.col("period").alias("_p"), F.col("accession").alias("_acc"), F.col("embedding").alias("_e"),
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("_step"))
    # years overlap: a filing is offered to its own and the following 'bin' of the window's width
    width = farthest_days
    past = past.withColumn("_bin", F.floor(F.datediff("_p", F.lit("1970-01-01").cast("date")) / width) + F.col("_step"))
    near = rows.select("cik", "form", "accession", "period",
                       F.floor(F.datediff("period", F.lit("1970-01-01").cast("date")) / width).alias("_bin"))
    pairs = near.join(past, ["cik", "form", "_bin"]).where(
        F.col("_p").between(F.date_sub("period", farthest_days), F.date_sub("period", nearest_days)))
    year_ago = pairs.groupBy("cik", "form", "accession", "period").agg(
        F.max_by("_e", F.struct("_p", "_acc")).alias("_year"))
    rows = rows.join(year_ago, ["cik", "form", "accession", "period"], "left")

    if sectors is not None:
        if not named:
            rows = rows.join(sectors.select("cik", "sector"), "cik", "left")
        centres = rows.where(F.col("sector").isNotNull()).groupBy("sector", "period").agg(
            vector_to_array(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))).alias("_peer"))
        rows = rows.join(centres, ["sector", "period"], "left")
        peer = cosine_distance("embedding", "_peer")
    else:
        peer = F.lit(None).cast("double")
    return rows.select(
        "cik", "period", "form", "accession", cosine_distance("embedding", "_prev").alias("drift_qoq"),
        cosine_distance("embedding", "_year").alias("drift_yoy"), peer.alias("drift_peer"))


def filing_features_daily(
    drift: DataFrame, sentiment: DataFrame, filings: DataFrame, cik_tickers: DataFrame, trading_days: DataFrame,
    effective: str = "filing_date", sentiment_columns: Sequence[str] = ("mean_score", "frac_negative"),
) -> DataFrame:
    """Filing features carried forward onto each ticker's trading days, never back.

    Drift and sentiment are outer-joined on (cik, period, form); companies without ticker drop;
    the latest filing at or before a day counts as a whole row. ``effective`` is the filing date;
    ``period`` reproduces the look-ahead of dating by fiscal period. Days before the first
    filing keep nulls. Of filings on one day the one of the latest period stays.
    """
    both = drift.select("cik", "period", "form", *DRIFT).join(
        sentiment.select("cik", "period", "form", *sentiment_columns), ["cik", "period", "form"], "full")
    if effective != "period":
        both = both.join(filings.select("cik", "period", "form", effective).distinct(), ["cik", "period", "form"])
    both = both.join(cik_tickers.select("cik", "ticker"), "cik")
    payload = [*DRIFT, *sentiment_columns]
    # the tie-break key is unique per ticker, so the result does not depend on row order
    rows = both.withColumn("_tie", F.struct("period", "form", "cik")).withColumn("_eff", F.col(effective))
    return as_of(trading_days.select("ticker", "date"), rows, ["ticker"], "date", "_eff", payload, tie="_tie")
