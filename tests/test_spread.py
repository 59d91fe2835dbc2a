"""The range-cut plans give what plain windows give."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import losses
from tidemark.operators.spread import average_ranks, exact_quantiles, row_position, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of it."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=400), np.zeros(200), rng.normal(size=60)])
    g = np.array(["hot"] * 600 + ["cold"] * 60)
    pdf = pd.DataFrame({"g": g, "id": np.arange(len(x)), "x": np.round(x, 2), "n": 1})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("per_range", [7, 1_000_000])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(skewed, per_range, descending):
    df, pdf = skewed
    out = running_totals(df, ["g"], "x", ["n", "id"], descending, per_range).toPandas()
    assert len(out) == pdf.groupby(["g", "x"]).ngroups
    for r in out.itertuples():
        group = pdf[pdf.g == r.g]
        earlier = group[group.x > r.x] if descending else group[group.x < r.x]
        assert (r.n_before, r.id_before) == (len(earlier), earlier.id.sum())


@pytest.mark.parametrize("per_range", [7, 1_000_000])
def test_average_ranks(skewed, per_range):
    df, pdf = skewed
    out = average_ranks(df, ["g"], {"x": "r"}, per_range).toPandas().sort_values("id")
    assert np.array_equal(out.r, pdf.groupby("g").x.rank())


@pytest.mark.parametrize("per_range", [7, 1_000_000])
def test_quantiles_and_positions(skewed, per_range):
    df, pdf = skewed
    out = exact_quantiles(df, ["g"], "x", {"a": 0.1, "m": 0.5, "b": 0.97}, per_range).toPandas().set_index("g")
    for name, q in (("a", 0.1), ("m", 0.5), ("b", 0.97)):
        for g in ("hot", "cold"):
            assert out.loc[g, name] == pytest.approx(np.quantile(pdf[pdf.g == g].x, q))
    placed = row_position(df, ["g"], ["x", "id"], "p", per_range).toPandas()
    placed = placed.sort_values(["g", "x", "id"])
    assert list(placed.p) == list(placed.groupby("g").cumcount() + 1)


@pytest.mark.parametrize("per_range", [1, 1_000_000])
def test_null_groups_are_kept(spark, per_range):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 3, 1.0), ("a", 4, 3.0)], "g string, id int, x double")
    ranks = average_ranks(df, ["g"], {"x": "r"}, per_range).collect()
    assert {r.id: r.r for r in ranks} == {1: 1.0, 2: 2.0, 3: 1.0, 4: 2.0}
    assert {r.id: r.p for r in row_position(df, ["g"], ["x", "id"], "p", per_range).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    assert {r.g: r.m for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}, per_range).collect()} == {None: 3.0, "a": 2.0}
    totals = running_totals(df, ["g"], "x", ["id"], per_range=per_range).collect()
    assert {r.x: r.id_before for r in totals} == {2.0: 0, 4.0: 1, 1.0: 0, 3.0: 3}


def _hinge(pdf, margin):
    total, pairs = 0.0, 0
    for _, d in pdf.groupby("pred_date"):
        for a in d.itertuples():
            for b in d.itertuples():
                if a.target > b.target:
                    total += max(0.0, margin - (a.score - b.score))
                    pairs += 1
    return total / pairs, pairs


@pytest.mark.parametrize("per_range", [7, 1_000_000])
@pytest.mark.parametrize("margin", [0.0, 0.3])
def test_pairwise_hinge_counts_every_pair_once(spark, per_range, margin):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({
        "pred_date": np.repeat(["a", "b", "c"], [40, 17, 1]), "ticker": [f"T{k}" for k in range(58)],
        "score": np.round(rng.normal(size=58), 1), "target": np.round(rng.normal(size=58), 1)})
    row = losses.pairwise_hinge_loss(spark.createDataFrame(pdf), margin, per_range=per_range).first()
    loss, pairs = _hinge(pdf, margin)
    assert row.n_pairs == pairs and row.loss == pytest.approx(loss)


@pytest.mark.parametrize("per_range", [7, 1_000_000])
def test_listmle(spark, per_range):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"pred_date": "a", "ticker": [f"T{k}" for k in range(30)], "score": rng.normal(size=30), "target": rng.normal(size=30)})
    row = losses.listmle_loss(spark.createDataFrame(pdf), per_range=per_range).first()
    s = pdf.sort_values("target", ascending=False).score.to_numpy()
    expected = np.mean([np.log(np.exp(s[k:]).sum()) - s[k] for k in range(30)])
    assert row.loss == pytest.approx(expected)


def test_groups_lie_in_as_many_partitions_as_their_rows_call_for(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.spread import in_parts

    df = spark.range(4000).select((F.col("id") % 300).alias("g"), F.col("id").cast("double").alias("x"))
    parts = in_parts(df, ["g"], per_part=100)
    assert parts.rdd.getNumPartitions() == 40
    assert parts.select("g", F.spark_partition_id().alias("p")).distinct().count() == 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        # one task ordered the whole table here
        assert average_ranks(df, ["g"], {"x": "r"}).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
