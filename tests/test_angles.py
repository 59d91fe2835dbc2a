"""Similarity graphs of large groups: the index by angle skips work, never results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panels import day
from tidemark.operators import pairs, relations
from tidemark.operators.angles import spread_out

D = day("2024-01-01")


def universe(n, groups, width, noise, seed, flat=2, twins=3):
    """Windows around common factors, some alone, some flat, some equal."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(groups, width))
    at = rng.integers(0, groups, n)
    x = factors[at] * rng.choice([-1.0, 1.0], n)[:, None] + noise * rng.normal(size=(n, width))
    x[: n // 20] = rng.normal(size=(n // 20, width))
    x[-flat:] = 3.5
    x[-flat - twins: -flat] = x[-flat - twins]
    return x


def frame(spark, x, scale=None, values=None):
    rows = [(D, f"T{k:05d}", v.tolist(), float(scale[k]) if scale is not None else 1.0, values[k] if values is not None else None) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "pred_date date, ticker string, vec array<double>, scale double, values array<double>")


def weights(x, kind, absolute, windows=(), scale=None):
    if kind == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        w = u @ u.T
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            per = [np.corrcoef(x[:, -k:]) for k in sorted(windows or [x.shape[1]])]
        w = np.sign(per[-1]) * np.minimum.reduce([np.abs(p) for p in per])
        w[np.ptp(x, axis=1) == 0] = np.nan
        w[:, np.ptp(x, axis=1) == 0] = np.nan
    if scale is not None:
        w = w * np.outer(scale, scale)
    w = np.abs(w) if absolute else w.copy()
    np.fill_diagonal(w, np.nan)
    return w


def listed(w, threshold):
    i, j = np.nonzero(np.nan_to_num(w, nan=-9) > threshold)
    return {(f"T{a:05d}", f"T{b:05d}"): w[a, b] for a, b in zip(i, j, strict=True)}


CASES = [("correlation", True, (), False, 0.6), ("correlation", False, (), False, 0.5), ("correlation", True, (8, 24), False, 0.5), ("correlation", False, (8, 24), True, 0.3),
         ("correlation", False, (), True, -0.2), ("cosine", False, (), False, 0.7), ("cosine", False, (), False, 0.0), ("cosine", False, (), False, -0.1)]


@pytest.mark.parametrize("kind,absolute,windows,scaled,threshold", CASES)
def test_indexed_edges_equal_all_pairs(spark, kind, absolute, windows, scaled, threshold):
    x = universe(260, 9, 24, 0.5, 1)
    if kind == "cosine":
        x[5] = 0.0
    scale = np.random.default_rng(2).uniform(0, 1, len(x)) if scaled else None
    if scaled:
        scale[7] = 0.0
    p = pairs.Similarity(frame(spark, x, scale), ["pred_date"], kind, absolute, windows, block=16)
    assert p.indexed
    w = weights(x, kind, absolute, windows, scale)
    got = {(r.src, r.dst): r.weight for r in p.edges(threshold).collect()}
    want = listed(w, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    counts = p.counts([threshold, threshold + 0.15]).first()
    assert (counts["_t0"], counts["_t1"]) == (len(want), len(listed(w, threshold + 0.15)))


@pytest.mark.parametrize("kind,absolute,k", [("correlation", True, 4), ("correlation", False, 20), ("cosine", False, 3)])
def test_indexed_top_k_equals_all_pairs(spark, kind, absolute, k):
    x = universe(260, 9, 24, 0.5, 3)
    if kind == "cosine":
        x[5] = 0.0
    got = pairs.Similarity(frame(spark, x), ["pred_date"], kind, absolute, block=16).top(k).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.src, []).append(r.weight)
    w = weights(x, kind, absolute)
    for a in range(len(x)):
        best = np.sort(w[a][~np.isnan(w[a])])[::-1][:k]
        assert np.allclose(sorted(mine.get(f"T{a:05d}", []), reverse=True), best, atol=1e-9)


@pytest.mark.parametrize("block", [512, 16])
def test_neighbour_sums_equal_those_of_listed_edges(spark, block):
    x = universe(200, 7, 20, 0.6, 4)
    rng = np.random.default_rng(5)
    values = [None if k % 11 == 0 else [float(rng.normal()), None if k % 3 == 0 else float(rng.normal())] for k in range(len(x))]
    p = pairs.Similarity(frame(spark, x, values=values), ["pred_date"], block=block)
    edges = p.edges(0.55)
    known = frame(spark, x, values=values).where("values is not null").select("pred_date", "ticker", F.col("values")[0].alias("a"), F.col("values")[1].alias("b"))

    def table(df):
        return {r.ticker: [round(v, 9) if v is not None else None for v in r[2:]] for r in df.collect()}

    assert table(relations.near_mean(p, 0.55, ["a", "b"])) == table(relations.neighbor_mean(edges, known, ["a", "b"]))
    assert table(relations.near_mean(p, 0.55, ["a", "b"], weighted=True)) == table(relations.neighbor_mean(edges, known, ["a", "b"], weighted=True))
    nodes = known.select("pred_date", "ticker")
    degrees = nodes.join(p.neighbor_sums(0.55).select("pred_date", "ticker", "degree"), ["pred_date", "ticker"], "left").na.fill(0, ["degree"])
    assert table(degrees) == table(relations.degree(edges, nodes))

    def build(some, columns):
        rows = frame(spark, x).drop("values")
        if some is not None:
            rows = rows.join(some.select("pred_date", "ticker", F.array(*columns).alias("values")), ["pred_date", "ticker"], "left")
        return pairs.Similarity(rows, ["pred_date"], block=block)

    assert table(relations.near_normalised_sum(build, 0.55, known, ["a", "b"])) == table(relations.normalised_neighbor_sum(edges, known, ["a", "b"]))


def test_a_universe_of_5000_is_mostly_skipped(spark):
    x = universe(5000, 60, 60, 0.4, 6)
    p = pairs.Similarity(frame(spark, x), ["pred_date"])
    assert p.indexed
    r = p.pair_counts(0.75).first()
    assert r.n == 5000 and r.multiplied < 0.2 * 5000 * 4999 / 2
    edges = p.counts([0.75]).first()["_t0"]
    assert edges == len(listed(weights(x, "correlation", True), 0.75))
    # a row visits few of the other blocks for its strongest partners
    v = p.visit_counts(5).first()
    assert v.blocks >= 10 and v.visited < 0.35 * v.n * (v.blocks - 1)


def test_one_direction_for_all_is_still_cut_into_blocks(spark):
    base = np.random.default_rng(7).normal(size=20)
    x = np.array([base * (k + 1) for k in range(150)])
    p = pairs.Similarity(frame(spark, x), ["pred_date"], block=16)
    widest = p.routed(0.9).groupBy("_a", "_b").count().agg(F.max("count")).first()[0]
    assert widest < 64 and p.counts([0.9]).first()["_t0"] == 150 * 149


def test_groups_of_any_size_side_by_side(spark):
    x = universe(120, 4, 16, 0.5, 8)
    rows = frame(spark, x).unionByName(frame(spark, x[:3]).withColumn("pred_date", F.date_add("pred_date", 1))).unionByName(
        frame(spark, x[-1:]).withColumn("pred_date", F.date_add("pred_date", 2)))
    got = {r.pred_date: r["_t0"] for r in pairs.Similarity(rows, ["pred_date"], block=16).counts([0.5]).collect()}
    assert got[D] == len(listed(weights(x, "correlation", True), 0.5))
    small = len(listed(weights(x[:3], "correlation", True), 0.5))
    assert got.get(day("2024-01-02"), 0) == small and got.get(day("2024-01-03"), 0) == 0
    assert pairs.Similarity(rows.limit(0), ["pred_date"], block=16).edges(0.5).count() == 0


def test_pivots_are_far_apart():
    u = np.array([[1.0, 0], [0.999, 0.04], [0, 1.0], [-1.0, 0], [1.0, 0]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert spread_out(u, 3, False)[:2].tolist() == [[1.0, 0.0], [-1.0, 0.0]]
    assert len(spread_out(u, 9, True)) == 3


def test_rows_of_a_wide_block_are_sent_once_and_met_in_tiles(spark):
    x = np.random.default_rng(5).normal(size=(1300, 12))
    weight = np.abs(np.corrcoef(x))
    np.fill_diagonal(weight, -1)
    p = pairs.Similarity(frame(spark, x), ["pred_date"], block=pairs.WIDE)
    assert p.routed(0.6).count() == 1300        # blocks of 512 rows took each of them three times
    degrees = {r.ticker: r.degree for r in p.neighbor_sums(0.6).collect()}
    assert sum(degrees.values()) == int((weight > 0.6).sum()) == p.counts([0.6]).first()["_t0"]
    assert sorted(degrees.values()) == sorted(int(n) for n in (weight > 0.6).sum(axis=1) if n)
    best = sorted(round(r.weight, 9) for r in p.top(3).collect())
    assert best == sorted(np.round(np.sort(weight, axis=1)[:, -3:], 9).ravel().tolist())
    # the largest block keeps a pair of vectors of any length in memory
    assert pairs.Similarity(frame(spark, np.ones((2, 8000))), ["pred_date"], block=pairs.WIDE).block == pairs.TILE
