"""Exact order statistics of groups of any size.

Groups of at most ``per_range`` rows are ordered whole, one task each, by plain windows: all columns of
such a group share one shuffle. Larger groups are cut: their keys are collapsed to distinct values with counts, written
once, and cut into ranges of about ``per_range`` keys; each range is accumulated on its own and the
totals of the lower ranges are added. Which groups are large is counted, group by group, and results
do not depend on it. Ordered groups lie in as many partitions as their rows call for, so a task's memory does not grow
with the table. Split points come from a sample of the keys, chosen by hash (hence the same after any
recomputation) and in proportion to the group's counted size; results are exact whatever the sample
holds. Null group keys are groups too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

PER_RANGE = 1_000_000   # distinct keys of one group that meet in one task, about
PER_PART = 250_000      # rows of a partition of whole groups, about
PER_SPLIT = 64          # sampled keys for each split point
HELD = 200_000          # values of one group that an aggregate holds in memory


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the key columns are those of ``left``."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(other[f"_same_{k}"])
    return left.join(other, match, how).drop(*[f"_same_{k}" for k in keys])


def in_parts(df: DataFrame, by: Sequence[str], rows: int | None = None, per_part: int = PER_PART) -> DataFrame:
    """``df`` with the rows of each group in one partition of about ``per_part`` rows, however many the session
    would make. ``rows`` is the size of ``df`` where it is known."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_part)), *by)


def by_size(
    df: DataFrame, by: Sequence[str], per_range: int, whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame],
    parts: bool = True,
) -> DataFrame:
    """``whole`` of the groups of at most ``per_range`` rows and ``cut`` of the others; the same columns from both.
    ``whole`` gets its groups ``in_parts``, unless it combines them before the shuffle."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    is_large = F.col("_rows") > per_range
    small_rows, any_large = sizes.agg(F.sum(F.when(~is_large, F.col("_rows"))), F.max(is_large)).first()

    def together(rows: DataFrame) -> DataFrame:
        return in_parts(rows, by, small_rows or 0) if parts else rows

    if not any_large:
        return whole(together(df))
    large = cut_lineage(sizes.where(is_large).select(*by))
    rest, big = (same_keys(df, large, by, how) for how in ("left_anti", "left_semi"))
    return whole(together(rest)).unionByName(cut(big))


def _split_points(cells: DataFrame, by: Sequence[str], order: str, per_range: int) -> DataFrame:
    large = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_range).drop("_n")
    rate = max(1, per_range // PER_SPLIT)
    sample = cells.where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(*by, order), F.lit(rate)) == 0)).select(*by, order)
    keys = same_keys(sample, large, by).groupBy(*by).agg(F.sort_array(F.collect_list(order)).alias("_keys"))
    step = max(1, per_range // rate)
    return keys.select(*by, F.filter("_keys", lambda _, i: (i % step) == 0).alias("_splits"))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    values: Sequence[str],
    descending: bool = False,
    per_range: int = PER_RANGE,
) -> DataFrame:
    """Per distinct (by, order): the sum of each value and the sum over all earlier keys.

    Output columns: by, order, each value, and ``<value>_before`` (strictly earlier keys).
    """
    by = list(by)

    def direction(c: str):
        return F.col(c).desc() if descending else F.col(c).asc()

    def before(v: str, w):
        return F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by, order).agg(*[F.sum(v).alias(v) for v in values])

    def whole(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(direction(order))
        return summed(rows).select(*by, order, *values, *[before(v, w).alias(f"{v}_before") for v in values])

    def cut(rows: DataFrame) -> DataFrame:
        cells = cut_lineage(summed(rows))
        below = F.size(F.filter("_splits", lambda s: s <= F.col(order)))
        cells = same_keys(cells, _split_points(cells, by, order, per_range), by, "left").withColumn(
            "_range", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(below)).drop("_splits")
        lower = Window.partitionBy(*by).orderBy(direction("_range"))
        inside = Window.partitionBy(*by, "_range").orderBy(direction(order))
        offsets = cells.groupBy(*by, "_range").agg(*[F.sum(v).alias(v) for v in values]).select(
            *by, "_range", *[before(v, lower).alias(f"_offset_{v}") for v in values])
        local = cells.select("*", *[before(v, inside).alias(f"_local_{v}") for v in values])
        return same_keys(local, offsets, [*by, "_range"]).select(
            *by, order, *values,
            *[(F.col(f"_local_{v}") + F.col(f"_offset_{v}")).alias(f"{v}_before") for v in values])

    return by_size(df, by, per_range, whole, cut)


def average_ranks(df: DataFrame, by: Sequence[str], keys: dict[str, str], per_range: int = PER_RANGE) -> DataFrame:
    """Add ranks from 1 within ``by`` as ``{key column: rank column}``; equal keys share the mean
    of their ranks. Keys must be non-null numbers."""
    by, names = list(by), [*df.columns, *keys.values()]

    def whole(rows: DataFrame) -> DataFrame:
        for key, out in keys.items():
            ties = F.count(F.lit(1)).over(Window.partitionBy(*by, key))
            rows = rows.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(key)) + (ties - 1) / F.lit(2.0))
        return rows.select(*names)

    def cut(rows: DataFrame) -> DataFrame:
        # all columns are ranked from one table of (group, column, key)
        long = rows.select(*by, F.posexplode(F.array(*[F.col(k).cast("double") for k in keys])).alias("_key", "_value"), F.lit(1).cast("bigint").alias("_n"))
        cells = running_totals(long, [*by, "_key"], "_value", ["_n"], per_range=per_range)
        cells = cut_lineage(cells.select(*by, "_key", "_value", (F.col("_n_before") + (F.col("_n") + 1) / F.lit(2.0)).alias("_rank")))
        for n, (key, out) in enumerate(keys.items()):
            own = cells.where(F.col("_key") == n).select(*by, F.col("_value").alias("_at"), F.col("_rank").alias(out))
            rows = same_keys(rows.withColumn("_at", F.col(key).cast("double")), own, [*by, "_at"]).drop("_at")
        return rows.select(*names)

    return by_size(df, by, per_range, whole, cut)


def row_position(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, per_range: int = PER_RANGE) -> DataFrame:
    """Position from 1 within ``by`` by a unique ordering of columns."""
    by, names = list(by), [*df.columns, out]

    def whole(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).select(*names)

    def cut(rows: DataFrame) -> DataFrame:
        keyed = rows.select(*by, F.struct(*order).alias("_key"), F.lit(1).cast("bigint").alias("_n"))
        cells = running_totals(keyed, by, "_key", ["_n"], per_range=per_range)
        place = cells.select(*by, *[F.col(f"_key.{c}").alias(c) for c in order],
                             (F.col("_n_before") + 1).cast("int").alias(out))
        return same_keys(rows, place, [*by, *order]).select(*names)

    return by_size(df, by, per_range, whole, cut)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], per_range: int = PER_RANGE,
) -> DataFrame:
    """Linear-interpolated quantiles per group, as columns named by the keys of ``quantiles``."""
    return column_quantiles(df, by, [value], quantiles, per_range).withColumnsRenamed({f"{value}_{n}": n for n in quantiles}).where(F.col(next(iter(quantiles))).isNotNull())


def column_quantiles(df: DataFrame, by: Sequence[str], values: Sequence[str], quantiles: dict[str, float], per_range: int = PER_RANGE) -> DataFrame:
    """Quantiles of several columns per group as ``<value>_<name>``, nulls left out; null for a column without a value.

    A group of up to ``HELD`` values is one wide aggregate, combined before the shuffle.
    """
    by, points = list(by), F.array(*[F.lit(float(q)) for q in quantiles.values()])
    names = [f"{v}_{n}" for v in values for n in quantiles]

    def whole(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*by).agg(*[F.percentile(F.col(v).cast("double"), points).alias(f"_q{k}") for k, v in enumerate(values)])
        return found.select(*by, *[F.get(f"_q{k}", F.lit(m)).alias(f"{v}_{n}") for k, v in enumerate(values) for m, n in enumerate(quantiles)])

    def cut(rows: DataFrame) -> DataFrame:
        long = rows.select(*by, F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_column", "_value"), F.lit(1).cast("bigint").alias("_n"))
        keys = [*by, "_column"]
        cells = running_totals(long.where(F.col("_value").isNotNull()), keys, "_value", ["_n"], per_range=per_range)
        cells = same_keys(cells, cells.groupBy(*keys).agg(F.sum("_n").alias("_size")), keys)
        picks = []
        for k, v in enumerate(values):
            for name, q in quantiles.items():
                place = (F.col("_size") - 1) * F.lit(float(q))

                def at(position, k=k):
                    inside = (F.col("_column") == k) & (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))
                    return F.max(F.when(inside, F.col("_value")))

                share = F.max(F.when(F.col("_column") == k, place - F.floor(place)))
                low, high = at(F.floor(place)), at(F.ceil(place))
                picks.append((low + (high - low) * share).alias(f"{v}_{name}"))
        # groups without any value are in no cell
        return same_keys(rows.select(*by).distinct(), cells.groupBy(*by).agg(*picks), by, "left").select(*by, *names)

    return by_size(df, by, min(per_range, HELD // max(1, len(values))), whole, cut, parts=False)


def top_rows(
    df: DataFrame, by: Sequence[str], order: Sequence, limit: int, out: str = "position",
) -> DataFrame:
    """The first ``limit`` rows of each group.

    Spark cuts every input partition to ``limit`` rows per group before the shuffle, so a
    large group never travels whole.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= limit)
