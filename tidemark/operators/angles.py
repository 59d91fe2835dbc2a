"""An index of vectors by angle, so that far blocks of a group are never compared.

Some rows of each group, chosen by hash in proportion to its size, are thinned to pivots far from
each other, which then move to the middle of the rows around them. A row belongs to the cell of its nearest pivot and to a ring of angles around it. Rings
are packed into blocks of bounded size (a large ring is cut by hash, small ones share a block), and
by the triangle inequality a row within ``reach`` of a partner in a ring can only have it there if
its own angle to the ring's pivot is at most ``reach`` outside the ring. Rows are sent to the blocks that hold
such a ring and to no others.

With ``folded`` a vector and its negative are the same line, as for absolute correlations. ``unit``
turns a matrix of vectors into directions; rows it makes NaN have none, lie in no block and go nowhere.
All steps are grouped: a task holds some rows of a group and its pivots, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

#: Pivots per block of a group, sampled rows per pivot, rows that are placed at once.
PER_BLOCK, SAMPLED, CHUNK = 16, 6, 4096
#: Inner borders of the rings.
RINGS = np.radians([*range(0, 60, 5), 60.0, 75, 90, 180.1])
SLACK = 1e-6

Unit = Callable[[np.ndarray], np.ndarray]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows; nulls inside are NaN."""
    flat = column.combine_chunks()
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def angles_to(units: np.ndarray, pivots: np.ndarray, folded: bool) -> np.ndarray:
    dots = units @ pivots.T
    return np.arccos(np.clip(np.abs(dots) if folded else dots, -1.0, 1.0))


def spread_out(units: np.ndarray, count: int, folded: bool) -> np.ndarray:
    """Rows of ``units``, each as far as possible from those before."""
    chosen = [0]
    nearest = angles_to(units, units[:1], folded)[:, 0]
    while len(chosen) < min(count, len(units)):
        far = int(nearest.argmax())
        if nearest[far] < 1e-6:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, angles_to(units, units[far:far + 1], folded)[:, 0])
    return units[chosen]


def centred(units: np.ndarray, pivots: np.ndarray, folded: bool, rounds: int = 3) -> np.ndarray:
    """Pivots moved to the mean direction of their nearest rows."""
    for _ in range(rounds):
        dots = units @ pivots.T
        own = (np.abs(dots) if folded else dots).argmax(axis=1)
        toward = units * np.sign(dots[np.arange(len(own)), own])[:, None] if folded else units
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, toward)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), pivots)
    return pivots


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _repeated(table: pa.Table, keys: Sequence[str], n: int) -> list[pa.ChunkedArray]:
    first = pa.array(np.zeros(n, dtype=np.int64))
    return [table[k].take(first) for k in keys]


def pivots_of(rows: DataFrame, keys: list[str], unit: Unit, block: int, folded: bool) -> DataFrame:
    """(keys, _cell, _pivot): a few directions per block of each group. ``rows`` has ``_n``, the group's size."""
    wanted = F.ceil(F.col("_n") / F.lit(float(block))) * PER_BLOCK
    share = F.pmod(F.xxhash64("ticker", F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(share <= F.greatest(wanted * SAMPLED, F.lit(64)) / F.col("_n")).select(*keys, "vec", wanted.cast("int").alias("_wanted"))
    schema = T.StructType([*_fields(rows, keys), T.StructField("_cell", T.IntegerType()), T.StructField("_pivot", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        # the same rows in any order give the same pivots
        units = unit(matrix(table["vec"]))
        units = units[~np.isnan(units).any(axis=1)]
        units = units[np.lexsort(units.T)] if len(units) else np.eye(1, units.shape[1])
        found = centred(units, spread_out(units, table["_wanted"][0].as_py(), folded), folded)
        return pa.table([*_repeated(table, keys, len(found)), pa.array(range(len(found)), pa.int32()), pa.array(list(found), pa.list_(pa.float64()))],
                        names=[*keys, "_cell", "_pivot"])

    return sample.groupBy(*keys).applyInArrow(run, schema)


def _beside(rows: DataFrame, pivots: DataFrame, keys: list[str]):
    """Chunks of rows, each with all pivots of its group."""
    chunks = F.ceil(F.col("_n") / F.lit(float(CHUNK)))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("ticker", F.lit(2)), chunks).cast("int"))
    sizes = rows.select(*keys, "_n").distinct()
    copies = pivots.join(sizes, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))).drop("_n")
    return rows.groupBy(*keys, "_salt").cogroup(copies.groupBy(*keys, "_salt"))


def place(rows: DataFrame, keys: Sequence[str], unit: Unit, block: int, folded: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their block ``_own``, and the rings (keys, _cell, _ring, _pivot, _first, _parts) of each group.

    ``rows`` has keys, ticker, vec, the group's size ``_n`` and columns of its own; those without a direction are left out.
    """
    keys = list(keys)
    pivots = cut_lineage(pivots_of(rows, keys, unit, block, folded))
    names = rows.columns
    schema = T.StructType([*_fields(rows, names), T.StructField("_cell", T.IntegerType()), T.StructField("_ring", T.IntegerType())])

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        units = unit(matrix(left["vec"]))
        there = ~np.isnan(units).any(axis=1)
        left, units = left.filter(pa.array(there)), units[there]
        if not left.num_rows:
            return schema_of(left, _cell=pa.int32(), _ring=pa.int32())
        at = angles_to(units, matrix(right["_pivot"]), folded)
        best = at.argmin(axis=1)
        ring = np.searchsorted(RINGS, at[np.arange(len(best)), best], side="right") - 1
        cells = right["_cell"].to_numpy()[best]
        return left.append_column("_cell", pa.array(cells, pa.int32())).append_column("_ring", pa.array(ring, pa.int32()))

    placed = cut_lineage(_beside(rows, pivots, keys).applyInArrow(nearest, schema))
    pieces = placed.groupBy(*keys, "_cell", "_ring").agg(F.count(F.lit(1)).alias("_size"))
    packed = T.StructType([*_fields(pieces, [*keys, "_cell", "_ring"]), T.StructField("_first", T.IntegerType()), T.StructField("_parts", T.IntegerType())])

    def pack(table: pa.Table) -> pa.Table:
        # near rings side by side, those far from every pivot at the end
        cell, ring, size = (table[c].to_numpy() for c in ("_cell", "_ring", "_size"))
        first, parts = np.zeros(len(size), dtype=np.int32), np.ones(len(size), dtype=np.int32)
        at, held = 0, 0
        for k in np.lexsort((ring, cell, RINGS[ring] >= np.radians(40))):
            if held and held + size[k] > block:
                at, held = at + 1, 0
            first[k], parts[k] = at, -(-size[k] // block)
            if parts[k] > 1:
                at, held = at + parts[k], 0
            else:
                held += size[k]
        return pa.table([*[table[c] for c in (*keys, "_cell", "_ring")], pa.array(first), pa.array(parts)], names=[*keys, "_cell", "_ring", "_first", "_parts"])

    rings = cut_lineage(pieces.groupBy(*keys).applyInArrow(pack, packed).join(pivots, [*keys, "_cell"]))
    own = F.col("_first") + F.pmod(F.xxhash64("ticker"), F.col("_parts")).cast("int")
    return placed.join(rings.drop("_pivot"), [*keys, "_cell", "_ring"]).select(*names, own.alias("_own")), rings


def schema_of(table: pa.Table, **added: pa.DataType) -> pa.Table:
    """The empty table with more columns."""
    for name, kind in added.items():
        table = table.append_column(name, pa.array([], kind))
    return table.slice(0, 0)


def route(placed: DataFrame, rings: DataFrame, keys: Sequence[str], unit: Unit, folded: bool) -> DataFrame:
    """Adds ``_to``, the blocks that may hold a row within the angle ``reach`` of this one."""
    keys, names = list(keys), placed.columns
    schema = T.StructType([*_fields(placed, names), T.StructField("_to", T.ArrayType(T.IntegerType()))])

    def admitted(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select(names)
        if not left.num_rows:
            return schema_of(left, _to=pa.list_(pa.int32()))
        cells, where = np.unique(right["_cell"].to_numpy(), return_index=True)
        at = angles_to(unit(matrix(left["vec"])), matrix(right["_pivot"])[where], folded)
        own = np.searchsorted(cells, right["_cell"].to_numpy())
        ring, first, parts = (right[c].to_numpy() for c in ("_ring", "_first", "_parts"))
        reach = left["reach"].to_numpy()[:, None] + SLACK
        outer, inner = RINGS[np.minimum(ring + 1, len(RINGS) - 1)], RINGS[ring]
        hit = np.zeros((left.num_rows, int((first + parts).max())), dtype=bool)
        for k in range(len(ring)):
            angle = at[:, own[k]]
            near = (angle - outer[k] <= reach[:, 0]) & (inner[k] - angle <= reach[:, 0])
            hit[:, first[k]:first[k] + parts[k]] |= near[:, None]
        rows, blocks = np.nonzero(hit)
        offsets = np.concatenate([[0], np.cumsum(hit.sum(axis=1))]).astype(np.int32)
        return left.append_column("_to", pa.ListArray.from_arrays(pa.array(offsets), pa.array(blocks, pa.int32())))

    return _beside(placed, rings, keys).applyInArrow(admitted, schema)
