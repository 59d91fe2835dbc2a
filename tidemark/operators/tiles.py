"""Two blocks of vectors, met a pair of tiles at a time, as arrays.

Weights are those of double precision. Whether one is above a threshold is asked of all pairs in single precision first,
whose error is bounded; pairs closer to the threshold than that, and those whose weight is wanted, are worked out in
double precision one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from copy import copy

import numpy as np
import pyarrow as pa

from tidemark.operators.angles import matrix

#: Rows of a tile.
TILE = 512
FLAT = 1e-12


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > FLAT)


class Side:
    """The rows of a block that have a weight with any other: no flat ones, none without a scale."""

    def __init__(self, table: pa.Table, kind: str, windows: Sequence[int]):
        x = matrix(table["vec"])
        if kind == "cosine":
            units = [np.nan_to_num(unit_rows(x))]
        else:
            lengths = sorted(windows) if windows else [x.shape[1]]
            units = [unit_rows(v - v.mean(axis=1, keepdims=True)) for v in (x[:, x.shape[1] - w:] for w in lengths)] if len(x) else [x]
        scale = table["scale"].to_numpy().astype(float)
        there = ~np.isnan(scale) & ~np.any([np.isnan(u).any(axis=1) for u in units], axis=0)
        self.table = table if there.all() else table.filter(pa.array(there))
        self.units, self.scale = [np.ascontiguousarray(u[there]) for u in units], scale[there]
        self.copies = self.table["copies"].to_numpy()
        self.plain = len(units) == 1 and bool((self.scale == 1).all())
        self.single = self.units[-1].astype(np.float32)

    def __len__(self) -> int:
        return len(self.scale)

    def some(self, rows: np.ndarray) -> Side:
        """Some of the rows, without the table."""
        part = copy(self)
        part.table, part.units, part.scale = None, [u[rows] for u in self.units], self.scale[rows]
        part.copies, part.single = self.copies[rows], self.single[rows]
        return part


class Meeting:
    """A block pair (the same block twice where ``right`` is None)."""

    def __init__(self, left: Side, right: Side | None, use_absolute: bool):
        self.left, self.right, self.same, self.use_absolute = left, left if right is None else right, right is None, use_absolute
        self.plain = self.left.plain and self.right.plain
        # both ends rounded, a sum of as many products and the threshold itself
        self.margin = (self.left.single.shape[1] + 8) * 2.0**-23
        self._space = np.empty(TILE * TILE, dtype=np.float32)

    def tiles(self) -> Iterator[tuple[slice, slice, bool]]:
        """Pairs of tiles, each once, and whether both are the same rows."""
        if not len(self.left) or not len(self.right):
            return
        for i in range(0, len(self.left), TILE):
            for j in range(i if self.same else 0, len(self.right), TILE):
                yield slice(i, min(i + TILE, len(self.left))), slice(j, min(j + TILE, len(self.right))), self.same and i == j

    def _alone(self, rows: slice) -> np.ndarray:
        """A row is no partner of itself, a class with more members is one of its own."""
        return np.flatnonzero(self.left.copies[rows] == 1)

    def weights(self, a: slice, b: slice, same: bool) -> np.ndarray:
        per_window = [x[a] @ y[b].T for x, y in zip(self.left.units, self.right.units, strict=True)]
        sim = per_window[-1]
        if len(per_window) > 1:
            weakest = np.abs(per_window[0])
            for m in per_window[1:]:
                np.minimum(weakest, np.abs(m), out=weakest)
            sim = np.sign(sim) * weakest
        if not self.plain:
            sim *= self.left.scale[a][:, None]
            sim *= self.right.scale[b][None, :]
        if self.use_absolute:
            np.abs(sim, out=sim)
        if same:
            alone = self._alone(a)
            sim[alone, alone] = -np.inf
        return sim

    def rough(self, a: slice, b: slice) -> np.ndarray:
        """Plain weights up to ``margin``; the next call overwrites them."""
        x, y = self.left.single[a], self.right.single[b]
        out = self._space[:len(x) * len(y)].reshape(len(x), len(y))
        np.matmul(x, y.T, out=out)
        return np.abs(out, out=out) if self.use_absolute else out

    def exact(self, a: slice, b: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Plain weights of some pairs of two tiles."""
        w = np.einsum("ij,ij->i", self.left.units[-1][a][i], self.right.units[-1][b][j])
        return np.abs(w) if self.use_absolute else w

    def over(self, a: slice, b: slice, same: bool, thresholds: Sequence[float]) -> list[np.ndarray]:
        """For each threshold, where the weight is above it."""
        if not self.plain:
            sim = self.weights(a, b, same)
            return [sim > t for t in thresholds]
        sim, found = self.rough(a, b), []
        for t in thresholds:
            mask, near = sim > np.float32(t + self.margin), sim > np.float32(t - self.margin)
            if np.count_nonzero(mask) != np.count_nonzero(near):
                i, j = _places(mask ^ near)
                mask[i, j] = self.exact(a, b, i, j) > t
            if same:
                alone = self._alone(a)
                mask[alone, alone] = False
            found.append(mask)
        return found

    def edges(self, a: slice, b: slice, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and weights of the pairs above the threshold."""
        if not self.plain:
            sim = self.weights(a, b, same)
            i, j = np.nonzero(sim > threshold)
            return i, j, sim[i, j]
        i, j = _places(self.over(a, b, same, [threshold])[0])
        return i, j, self.exact(a, b, i, j)

    def largest(self, a: slice, b: slice, same: bool, k: int, rows: np.ndarray, columns: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per row of the left tile, and per row of the right one where ``columns`` is given, its k largest weights and some more.
        ``rows`` and ``columns`` are weights that the k-th of each row reaches; they are raised."""
        if self.plain:
            sim, slack = self.rough(a, b), 2 * self.margin
        else:
            sim, slack = self.weights(a, b, False), 0.0
        alone = self._alone(a) if same else np.zeros(0, dtype=int)
        sim[alone, alone] = -np.inf
        found = []
        for s, bound, turned in ((sim, rows, False),) if columns is None else ((sim, rows, False), (sim.T, columns, True)):
            i, j = _strongest(s, k, bound, slack)
            if turned:
                i, j = j, i
            w = self.exact(a, b, i, j) if self.plain else sim[i, j]
            found.append((j, i, w) if turned else (i, j, w))
        return found


def handed_on(side: Side, threshold: float, use_absolute: bool, near: np.ndarray, far: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For the rows ``near``, the sums of ``x`` over those of the rows ``far`` with a weight above the threshold; others are zero."""
    met = Meeting(side.some(near), side.some(far), use_absolute)
    # sums of whole numbers that stay below 2^24 are exact in single precision
    whole = x[far].sum(axis=0).max(initial=0.0) < 2**24 and bool((x == np.floor(x)).all())
    handed = x[far].astype(np.float32 if whole else np.float64)
    sums, out = np.zeros((len(near), x.shape[1])), np.zeros(x.shape)
    for a, b, _ in met.tiles():
        sums[a] += met.over(a, b, False, [threshold])[0].astype(handed.dtype) @ handed[b]
    out[near] = sums
    return out


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _strongest(sim: np.ndarray, k: int, bound: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries that reach ``bound`` and may be among the k largest of their row."""
    over = (sim >= bound[:, None].astype(sim.dtype)) & (sim > -np.inf)
    i, j = _places(over)
    many = np.flatnonzero(np.bincount(i, minlength=len(sim)) >= k)
    if not len(many):
        return i, j
    some = sim[many]
    cut = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k].astype(float) - slack
    bound[many] = np.maximum(bound[many], cut)
    over[many] &= some >= bound[many][:, None].astype(sim.dtype)
    return _places(over)
