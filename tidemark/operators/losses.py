"""Ranking and regression losses of a score as plain metrics.

Pairwise sums never list pairs: they follow from running sums over sorted rows, in arrays for dates of
up to ``per_range`` rows and in ranges (``spread.py``) for larger ones.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import valid_rows
from tidemark.operators.spread import PER_RANGE, by_size, running_totals


def pearson_ic_loss(df: DataFrame, least: int = 3, eps: float = 1e-8) -> DataFrame:
    """One row: minus the mean Pearson correlation over dates with ``least`` valid rows."""
    x, y = F.col("score"), F.col("target")
    n = F.count(F.lit(1)).cast("double")
    per_date = valid_rows(df).groupBy("pred_date").agg(
        n.alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    ic = F.col("c") * F.col("n") / (
        F.sqrt(F.col("vx") * F.col("n")) * F.sqrt(F.col("vy") * F.col("n")) + eps)
    return per_date.where(F.col("n") >= least).agg((-F.avg(ic)).alias("loss"), F.count(F.lit(1)).alias("n_dates"))


def listmle_loss(df: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """One row: mean over dates of the mean of logsumexp(scores from this rank on) - score, ranks
    by target descending. Rows of equal target share their tail sums in name order."""
    rows = valid_rows(df)
    peak = rows.groupBy("pred_date").agg(F.max("score").alias("_max"))
    # descending by target: the tail of a row is everything at or below it
    rows = rows.join(peak, "pred_date").select(
        "pred_date", F.struct(F.col("target"), F.col("ticker")).alias("_key"),
        F.exp(F.col("score") - F.col("_max")).alias("_e"), (F.col("score") - F.col("_max")).alias("_s"))
    cells = running_totals(rows, ["pred_date"], "_key", ["_e", "_s"], per_range=per_range)
    term = F.ln(F.col("_e_before") + F.col("_e")) - F.col("_s")
    return cells.groupBy("pred_date").agg(F.avg(term).alias("_l")).agg(
        F.avg("_l").alias("loss"), F.count(F.lit(1)).alias("n_dates"))


def hinge_sums(score: np.ndarray, target: np.ndarray, margin: float) -> tuple[float, int]:
    """Sum of max(0, margin - (s_i - s_j)) over pairs with y_i > y_j, and their number.

    Two different dense ranks of the targets differ first at exactly one bit; there the greater one has
    the bit set. So at each bit the rows of one prefix are 'set' against 'unset', sorted together, and a
    running count and sum of the unset scores gives each set row all its pairs at once.
    """
    rank = np.unique(target, return_inverse=True)[1]
    total, pairs = 0.0, 0
    for level in range(int(rank.max(initial=0)).bit_length()):
        prefix, upper = rank >> (level + 1), ((rank >> level) & 1).astype(bool)
        key = np.where(upper, score - margin, score)
        order = np.lexsort((-key, prefix))
        prefix, upper, key = prefix[order], upper[order], key[order]
        first = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(prefix)]))
        count = np.r_[0, np.cumsum(~upper)]
        # running sums over all rows; what lay before the prefix is taken off
        scores = np.cumsum(np.where(upper, 0.0, key))
        base = np.r_[0.0, scores][first][of]
        below = count[:-1] - count[first][of]
        total += float((scores - base - key * below)[upper].sum())
        ends = np.r_[first[1:], len(prefix)]
        lower = count[ends] - count[first]
        pairs += int((lower * (ends - first - lower)).sum())
    return total, pairs


def pairwise_hinge_loss(
    df: DataFrame, margin: float = 0.0, per_range: int = PER_RANGE,
) -> DataFrame:
    """One row: mean of max(0, margin - (s_i - s_j)) over all pairs with y_i > y_j of one date,
    pooled over dates, and the number of pairs. A date of more than ``per_range`` rows has its rows
    once per bit of its highest rank, in ranges."""
    rows = valid_rows(df).select("pred_date", F.col("score").cast("double").alias("score"), F.col("target").cast("double").alias("target"))

    def whole(rows: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            total, pairs = hinge_sums(table["score"].to_numpy(), table["target"].to_numpy(), margin)
            return pa.table({"_h": [total], "_p": [pairs]})

        return rows.groupBy("pred_date").applyInArrow(run, "_h double, _p long")

    sums = by_size(rows, ["pred_date"], per_range, whole, lambda large: _hinge_in_ranges(large, margin, per_range))
    return sums.agg(F.sum("_h").alias("_h"), F.sum("_p").alias("n_pairs")).select(
        (F.col("_h") / F.nullif(F.col("n_pairs"), F.lit(0))).alias("loss"), "n_pairs")


def _hinge_in_ranges(rows: DataFrame, margin: float, per_range: int) -> DataFrame:
    """(_h, _p) by ``hinge_sums``' rule, with running totals instead of arrays."""
    distinct = rows.select("pred_date", "target", F.lit(1).cast("bigint").alias("_n")).distinct()
    places = running_totals(distinct, ["pred_date"], "target", ["_n"], per_range=per_range).select(
        "pred_date", "target", F.col("_n_before").cast("bigint").alias("_rank"))
    # a row meets at most one other group per bit of its date's highest rank
    tallest = places.groupBy("pred_date").agg(F.max("_rank").alias("_top"))
    ranked = rows.join(places, ["pred_date", "target"]).join(tallest, "pred_date")
    levels = F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(62)), lambda i: F.pow(F.lit(2.0), i) <= F.col("_top")))
    leveled = ranked.select("pred_date", "score", "_rank", levels.alias("level")).select(
        "pred_date", "level", F.expr("shiftright(_rank, level + 1)").alias("prefix"),
        F.expr("shiftright(_rank, level) & 1").alias("bit"), "score")
    high = F.col("bit") == 1
    # the greater row i meets every lesser row j with s_j > s_i - margin
    events = leveled.select(
        "pred_date", "level", "prefix",
        F.when(high, F.col("score") - margin).otherwise(F.col("score")).alias("_key"),
        F.when(high, 1.0).otherwise(0.0).alias("upper"),
        F.when(high, 0.0).otherwise(1.0).alias("lower"),
        F.when(high, 0.0).otherwise(F.col("score")).alias("lower_sum"))
    by = ["pred_date", "level", "prefix"]
    cells = running_totals(events, by, "_key", ["upper", "lower", "lower_sum"], descending=True, per_range=per_range)
    # rows with the very same key contribute zero, so strictly greater keys suffice
    hinge = F.sum(F.col("upper") * (F.col("lower_sum_before") - F.col("_key") * F.col("lower_before")))
    pairs = leveled.groupBy(*by).agg(F.sum(F.col("bit")).alias("_u"), F.sum(1 - F.col("bit")).alias("_l")).agg(
        F.sum(F.col("_u") * F.col("_l")).cast("long").alias("_p"))
    return cells.agg(hinge.alias("_h")).withColumn("_one", F.lit(1)).join(pairs.withColumn("_one", F.lit(1)), "_one").select("_h", "_p")


def masked_mse(df: DataFrame, prediction: str = "score", actual: str = "target") -> DataFrame:
    return valid_rows(df).agg(F.avg(F.pow(F.col(prediction) - F.col(actual), 2)).alias("loss"))


def weighted_loss(parts: Mapping[str, tuple[DataFrame, float]]) -> DataFrame:
    """One row: each named loss and their weighted sum, from single-row loss tables."""
    out = None
    for name, (frame, _) in parts.items():
        one = frame.select(F.lit(1).alias("_one"), F.col("loss").alias(name))
        out = one if out is None else out.join(one, "_one")
    total = sum((F.col(n) * w for n, (_, w) in parts.items()), F.lit(0.0))
    return out.select(*parts, total.alias("total"))
