"""Exponentially weighted means as window sums.

Spark windows cannot refer to their own previous output, but y_t = a x_t + (1-a) y_{t-1} is
(1-a)^t times a running sum of a x_i (1-a)^-i. To stay within double range rows are cut into
blocks; the block before contributes its end value, older ones less than 1e-20 of it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 600.0      # exponent kept within double range
_NEGLIGIBLE = 46.0  # e^-46 is 1e-20


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def block_rows(alphas: list[float]) -> int:
    """Rows per block that suit all factors together."""
    rates = [-math.log1p(-a) for a in alphas]
    rows = int(_RANGE / max(rates))
    if rows * min(rates) < _NEGLIGIBLE:
        raise ValueError("smoothing factors too far apart for one call; use separate calls")
    return rows


def add_ewm(
    df: DataFrame, specs: dict[str, tuple[str, float, int]], key: str = "ticker", order: str = "date",
    block: int | None = None,
) -> DataFrame:
    """Add recursive means: name -> (input column, factor, index of the first non-null row).

    Inputs must be non-null from that row on; the first value is taken whole. Output is null
    before it.
    """
    rows = block or block_rows([a for _, a, _ in specs.values()])
    whole = Window.partitionBy(key).orderBy(order)
    df = df.withColumn("_rn", F.row_number().over(whole) - 1)
    df = df.withColumn("_blk", F.floor(F.col("_rn") / F.lit(rows))).withColumn(
        "_o", (F.col("_rn") - F.col("_blk") * rows).cast("double"))
    inside = Window.partitionBy(key, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for out, (c, a, first) in specs.items():
        weight = F.when(F.col("_rn") == first, F.lit(1.0)).otherwise(F.lit(a))
        scaled = F.when(F.col("_rn") >= first, weight * F.col(c) * F.pow(F.lit(1.0 - a), -F.col("_o")))
        local[f"_l_{out}"] = F.pow(F.lit(1.0 - a), F.col("_o")) * F.sum(scaled).over(inside)
    df = df.withColumns(local)
    block_before = Window.partitionBy(key).orderBy("_blk").rangeBetween(-1, -1)
    ends = F.max_by(F.struct(*local), F.col("_rn")).over(block_before)
    df = df.withColumn("_end", ends)
    done = {}
    for out, (c, a, first) in specs.items():
        carry = F.coalesce(F.col(f"_end._l_{out}"), F.lit(0.0)) * F.pow(F.lit(1.0 - a), F.col("_o") + 1)
        done[out] = F.when(F.col("_rn") >= first, F.col(f"_l_{out}") + carry)
    return df.withColumns(done).drop(*local, "_end", "_rn", "_blk", "_o")
