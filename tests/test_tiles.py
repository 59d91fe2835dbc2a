"""Tiles of pairs against brute force in double precision, beside thresholds too."""

import numpy as np
import pyarrow as pa
import pytest

from tests.panels import day
from tidemark.operators import pairs, tiles


def side(x, windows=(), scale=None, copies=None):
    n = len(x)
    return tiles.Side(pa.table({"vec": pa.array(list(x), pa.list_(pa.float64())), "scale": np.ones(n) if scale is None else scale,
                                "copies": np.ones(n, dtype=np.int64) if copies is None else copies}), "correlation", windows)


@pytest.fixture
def block(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 8)) + 0.8 * rng.normal(size=8)
    return side(x), np.abs(np.corrcoef(x))


def test_pairs_beside_the_threshold_are_settled_in_double_precision(block):
    one, w = block
    off = ~np.eye(50, dtype=bool)
    for threshold in [*np.sort(w[off])[::97] - 1e-9, *np.sort(w[off])[::97] + 1e-9]:
        met, got = tiles.Meeting(one, None, True), np.zeros((50, 50), dtype=bool)
        for a, b, same in met.tiles():
            got[a, b] = met.over(a, b, same, [threshold])[0]
            i, j, weight = met.edges(a, b, same, threshold)
            assert (got[a, b].nonzero()[0] == i).all() and weight == pytest.approx(w[a, b][i, j], abs=1e-14)
        assert (got == np.triu((w > threshold) & off) | got & np.tril(got)).all() and (np.triu(got) == np.triu((w > threshold) & off)).all()


def test_largest_of_rows_from_single_precision(block):
    one, w = block
    np.fill_diagonal(w, -np.inf)
    met, bound, found = tiles.Meeting(one, None, True), np.full(50, -np.inf), [{} for _ in range(50)]
    listed = 0
    for a, b, same in met.tiles():
        for k, (i, j, x) in enumerate(met.largest(a, b, same, 3, bound[a], None if same else bound[b])):
            rows, others = (a, b) if k == 0 else (b, a)
            listed += len(i)
            for p, q, v in zip(i, j, x, strict=True):
                found[rows.start + p][others.start + q] = v
    assert listed < 50 * 49 / 3
    for k in range(50):
        best = sorted(found[k], key=lambda q: -found[k][q])[:3]
        assert best == list(np.argsort(-w[k])[:3]) and [found[k][q] for q in best] == pytest.approx(w[k, best], abs=1e-14)


def test_block_pairs_of_large_graphs_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HEAVY", 10)
    rng = np.random.default_rng(6)
    rows = [(day(f"2024-01-0{d}"), f"T{k}", rng.normal(size=6).tolist()) for d in (1, 2, 3) for k in range(20)]
    p = pairs.Similarity(spark.createDataFrame(rows, "pred_date date, ticker string, vec array<double>"), ["pred_date"])
    counts = p.counts([0.5])
    assert p.tasks == 6 and "RepartitionByExpression [pred_date" in counts._jdf.queryExecution().optimizedPlan().toString()
    degrees = p.neighbor_sums(0.5, only=())
    assert degrees.columns == ["pred_date", "ticker", "degree"]
    assert {r.pred_date: r._t0 for r in counts.collect()} == {r[0]: r[1] for r in degrees.groupBy("pred_date").sum("degree").collect()}


def test_an_empty_side_meets_nobody(block):
    one, _ = block
    assert not list(tiles.Meeting(one, one.some(np.zeros(0, dtype=int)), True).tiles())
