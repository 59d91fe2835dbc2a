"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, ``floor(256 c)``. Their distinct vectors are written once in packed
blocks, and the covariance V is only ever applied: a pass over the blocks returns V Q for a basis Q
of a few columns, summed per cell from tasks' parts, of centred rows. A round multiplies Q by a
Chebyshev polynomial of V that stays below 1 over the unwanted part of the spectrum and grows beyond
it, one pass per degree; QR and Rayleigh-Ritz follow, and rounds go on until the residuals of the
wanted eigenvectors are certified. A round that does not gain a digit doubles the basis (the
spectrum is flat there), at last to all dimensions, where Rayleigh-Ritz is exact; so it always ends.
Only sums of (dimensions x basis) numbers reach the driver.

Rules for odd rows: a null vector, or one with a null, NaN or infinite entry, is left out; shorter
vectors end in zeros (an empty one is all zeros); entries beyond 2**53 after scaling are cut to that,
so that they stay exact; rows without an id and repeated rows stay, and repeated vectors weigh once in the fit. Directions
with less than 1e-12 of the variance have no component (a single distinct vector has none at all), so
there may be fewer than asked for; an empty table gives no rows. Input columns may have any
names; added ones start with ``_wh_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

SCALE = 256
MOST = 1 << 53
#: Vectors of a packed block; their sums of entries stay below 2**63.
ROWS = 512
#: Columns of the first basis besides the wanted ones: the further the spectrum falls off over them, the fewer rounds.
EXTRA = 16
#: What a round may grow the largest direction by, so that doubles keep the others.
GROWTH = 1e8
DEGREES = 12
#: Residuals relative to the largest eigenvalue: fine is at the rounding of a pass, enough if no further round helps.
FINE, ENOUGH = 2e-15, 1e-11
SEED = 11


@dataclass(frozen=True)
class Whitening:
    """``values`` are the eigenvalues, ``basis`` their unit vectors as columns, both of the fit list."""

    dim: int
    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray
    trace: float
    identity_error: float
    passes: int


def whole_vectors(vector: Column) -> Column:
    def whole(c: Column) -> Column:
        return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE)))

    return F.transform(vector, whole)


def usable(vector: Column) -> Column:
    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))

    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _padded(x: Column, dim: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), dim - F.size(x)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pack(vectors: DataFrame, dim: int) -> DataFrame:
    """``block``: the vectors of the one column, as doubles, up to ``ROWS`` in one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([x[i:i + ROWS].tobytes() for i in range(0, len(x), ROWS)], pa.binary())], ["block"])

    return vectors.mapInArrow(run, "block binary")


def _cells(blocks: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, object]:
    """Sums over all blocks of the numbers that ``part`` makes of a block, by their place.

    Every task adds up its blocks and emits one row per place; the rows are summed by place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                one = part(np.frombuffer(block.as_buffer(), "<f8").reshape(-1, dim))
                total = one if total is None else total + one
        if total is not None:
            values = pa.array(total.tolist(), pa.float64()) if kind == "double" else pa.array([str(int(v)) for v in total])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], ["i", "v"])

    rows = blocks.mapInArrow(run, f"i int, v {'double' if kind == 'double' else 'string'}")
    return {r.i: r.v for r in rows.groupBy("i").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()}


def column_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    def part(x: np.ndarray) -> np.ndarray:
        return np.array([len(x), *x.astype(np.int64).sum(axis=0).tolist()], dtype=object)

    found = _cells(blocks, dim, part, "decimal(38,0)")
    return int(found.get(0, 0)), [int(found.get(d + 1, 0)) for d in range(dim)]


class Covariance:
    """V as an operator; ``passes`` counts the scans of the fit list."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, mean: np.ndarray):
        self.blocks, self.dim, self.n, self.mean = blocks, dim, n, mean
        self.passes, self.trace = 0, 0.0

    def times(self, basis: np.ndarray) -> np.ndarray:
        mean = self.mean

        def part(x: np.ndarray) -> np.ndarray:
            z = x - mean
            return np.append((z.T @ (z @ basis)).ravel(), np.einsum("ij,ij->", z, z))

        found = _cells(self.blocks, self.dim, part, "double")
        self.passes += 1
        self.trace = found[basis.size] / self.n
        return np.array([found[k] for k in range(basis.size)]).reshape(basis.shape) / self.n


def leading(v: Covariance, k: int, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues and their unit vectors."""
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.standard_normal((v.dim, min(v.dim, k + extra))))[0]
    image, before = v.times(basis), np.inf
    while True:
        # Rayleigh-Ritz
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        worst = np.linalg.norm((image - basis * theta)[:, :k], axis=0).max() / max(theta[0], np.finfo(float).tiny)
        if basis.shape[1] == v.dim or worst <= FINE or (worst <= ENOUGH and 2 * worst > before):
            break
        if 10 * worst > before:
            fresh = rng.standard_normal((v.dim, min(v.dim - basis.shape[1], basis.shape[1])))
            basis, before = np.linalg.qr(np.hstack([basis, fresh]))[0], np.inf
        else:
            basis, before = _filtered(v, basis, image, theta), worst
        image = v.times(basis)
    kept = theta[:k] > 1e-12 * v.trace
    values, vectors = theta[:k][kept], basis[:, :k][:, kept]
    # either sign is right; this one is the same after every run
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def _filtered(v: Covariance, basis: np.ndarray, image: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Orthonormal columns of p(V) times the basis; p maps 0 .. the least Ritz value to -1 .. 1."""
    half = max(theta[-1], 1e-12 * theta[0]) / 2
    degree = int(np.clip(np.log(GROWTH) / np.arccosh(max(theta[0] / half - 1, 1.0001)), 1, DEGREES))
    last, now = basis, image / half - basis
    for _ in range(1, degree):
        last, now = now, 2 * (v.times(now) / half - now) - last
    return np.linalg.qr(now)[0]


def fit(df: DataFrame, k: int = 4, vector: str = "embedding", extra: int = EXTRA) -> Whitening | None:
    """Whitening by the ``k`` leading components; None for a table without a usable vector."""
    rows = df.where(usable(F.col(vector))).select(whole_vectors(F.col(vector)).alias("_wh_x"))
    dim = rows.agg(F.max(F.size("_wh_x"))).first()[0]
    if dim is None:
        return None
    if dim == 0:
        return Whitening(0, 1, [], np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    # copies are combined before they are shuffled
    blocks = cut_lineage(pack(rows.select(_padded(F.col("_wh_x"), dim).alias("_wh_x")).distinct(), dim))
    n, sums = column_sums(blocks, dim)
    mean = np.array([s / n for s in sums])
    v = Covariance(blocks, dim, n, mean)
    values, basis = leading(v, min(k, dim), extra)
    return Whitening(dim, n, sums, mean, values, basis, v.trace, _identity_error(blocks, mean, n, values, basis), v.passes)


def _identity_error(blocks: DataFrame, mean: np.ndarray, n: int, values: np.ndarray, basis: np.ndarray) -> float:
    k, dim = len(values), len(mean)
    if k == 0:
        return 0.0
    onto = basis / np.sqrt(values)

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ onto
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    found = _cells(blocks, dim, part, "double")
    second = np.array([found[i] for i in range(k * k)]).reshape(k, k) / n
    first = np.array([found[k * k + i] for i in range(k)]) / n
    return float(np.abs(second - np.outer(first, first) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row the sum of (n x - S)^2, exactly."""
    reach, high, dim = int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0), x.shape[1]
    if dim * reach * max(reach, high) < 1 << 62:
        squares, cross, rest = (x * x).sum(axis=1).tolist(), (x @ np.array(sums, dtype=np.int64)).tolist(), sum(s * s for s in sums)
        return [n * n * a - 2 * n * b + rest for a, b in zip(squares, cross, strict=True)]
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def transform(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``_wh_values`` (a whitened value per component) and ``_wh_deviation``
    (null beyond 38 digits)."""
    dim, n, sums, mean = model.dim, model.n, model.sums, model.mean
    onto = model.basis / np.sqrt(model.values)
    added = T.StructType([T.StructField("_wh_values", T.ArrayType(T.DoubleType())), T.StructField("_wh_deviation", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), dim) if dim else np.zeros((batch.num_rows, 0), dtype=np.int64)
            values = pa.array(list((x - mean) @ onto), pa.list_(pa.float64()))
            far = pa.array([Decimal(d) if d < 10**38 else None for d in deviations(x, n, sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values, far], names=[*batch.schema.names[:-1], "_wh_values", "_wh_deviation"])

    rows = df.where(usable(F.col(vector))).withColumn("_wh_x", _padded(whole_vectors(F.col(vector)), dim))
    return rows.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def components(df: DataFrame, k: int = 4, doc_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``, a row per usable row and component.

    ``deviation`` is null where it exceeds a long; ``transform`` has it as a decimal.
    """
    model = fit(df.select(vector), k, vector)
    schema = f"vec_id {df.schema[doc_id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = transform(df.select(F.col(doc_id).alias("vec_id"), F.col(vector).alias("_wh_in")), model, "_wh_in")
    rows = rows.select("vec_id", F.expr("try_cast(_wh_deviation as bigint)").alias("deviation"), F.posexplode("_wh_values").alias("_wh_k", "whitened"))
    return rows.select("vec_id", (F.col("_wh_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("_wh_k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
