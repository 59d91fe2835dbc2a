"""Whitening, sharding and the filter audit against brute force on small tables with odd rows."""

import re
import zlib
from collections import Counter
from pathlib import Path
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, text
from tidemark.llm import filter_audit, sharding, toxicity, warc, whitening
from tidemark.session import new_path

# -- 11 whitening -----------------------------------------------------------------------------


def brute_whitening(vectors, k):
    dim = max(map(len, vectors))
    x = np.array([[int(np.floor(256 * float(c))) for c in v] + [0] * (dim - len(v)) for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in sums], dtype=float)
    z = fit.astype(float) - mean
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x.astype(float) - mean) @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), e[:k] * n


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, n int, component string")


def check_whitening(spark, rows, good, k, least_gap=1e-3):
    got = {}
    for r in whitening.components(embeddings(spark, rows).repartition(5), k).collect():
        got.setdefault(r.vec_id, []).append(r)
    n, far, white, share, _ = brute_whitening([v for _, v in good], k)
    assert sorted(got, key=str) == sorted({i for i, _ in good}, key=str)
    sign = None
    for at, (i, _) in enumerate(good):
        mine = sorted((r for r in got[i]), key=lambda r: r.component)[:k]
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == far[at] and r.identity_error < 1e-9 for r in mine)
        assert np.allclose([r.explained for r in mine], share, rtol=1e-9)
        values = np.array([r.whitened for r in mine])
        if sign is None and np.abs(white[at]).min() > 1e-3:
            sign = np.sign(values * white[at])
        if sign is not None:
            assert np.allclose(values, sign * white[at], atol=1e-8)
    assert sign is not None


def test_whitening_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 40)) * np.linspace(1.5, 0.4, 40)
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    good += [(1000 + i, good[5][1]) for i in range(300)] + [(2000, good[6][1][:7]), (2001, []), (2002, [-0.0] * 40)]
    odd = [(3000, None), (3001, [None] + [0.0] * 39), (3002, [float("nan")] * 40), (3003, [float("inf")] * 3)]
    check_whitening(spark, good + odd, good, 4)


def test_whitening_widens_where_the_spectrum_is_flat(spark):
    rng = np.random.default_rng(4)
    x = np.linalg.qr(rng.standard_normal((900, 60)))[0] * 30 * np.linspace(1.001, 1.0, 60)
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    model = whitening.fit(embeddings(spark, good), 3, extra=2)
    n, _, _, share, _ = brute_whitening([v for _, v in good], 3)
    assert model.n == n and model.identity_error < 1e-9
    assert np.allclose(model.values / model.trace, share, rtol=1e-9)
    assert 4 < model.passes < 120


@pytest.mark.parametrize("rows,per_row", [
    ([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [])], 0),
    ([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [2.0, 0.0])], 1), ([(1, [0.5]), (2, [0.25])], 1)])
def test_whitening_of_few_directions(spark, rows, per_row):
    got = whitening.components(embeddings(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, v in rows if v for _ in range(per_row))
    assert all(r.component == 1 and abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_deviations_are_exact_beyond_a_long():
    rng = np.random.default_rng(5)
    for high, n in ((50, 7), (1 << 30, 10**9), (1 << 53, 10**12)):
        x, sums = rng.integers(-high, high, (20, 9)), [int(s) * n for s in rng.integers(-high, high, 9)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_whitening_keeps_columns(spark):
    df = embeddings(spark, [(i, [float(i), float(i * i % 7), 1e30]) for i in range(20)])
    model = whitening.fit(df, 2)
    done = whitening.transform(df, model)
    assert done.columns == [*df.columns, "_wh_values", "_wh_deviation"]
    assert {(r.vec_id, r.n, r.component) for r in done.collect()} == {(i, 1, "x") for i in range(20)}


# -- 12 sharding ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 50, 101, 1000])
def test_permutation_and_its_inverse(spark, n):
    rows = sharding.shard(spark.range(n).withColumnRenamed("id", "_sh_number"), n, shards=4).collect()
    assert sorted(r._sh_slot * 4 + r._sh_shard for r in rows) == list(range(n))
    assert all(sharding.row_at(r._sh_shard, r._sh_slot, n, shards=4) == r._sh_number for r in rows)


def test_permutation_looks_random(spark):
    n = 20_000
    places = np.array([r._sh_place for r in sharding.permute(spark.range(n).withColumnRenamed("id", "_sh_number"), n).orderBy("_sh_number").collect()])
    assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.03
    assert abs(np.corrcoef(places[1:], places[:-1])[0, 1]) < 0.03
    neighbours = Counter(zip((places[1:] % 8).tolist(), (places[:-1] % 8).tolist(), strict=True))
    assert len(neighbours) == 64 and max(neighbours.values()) < 1.35 * n / 64 and min(neighbours.values()) > 0.65 * n / 64
    other = np.array([r._sh_place for r in sharding.permute(spark.range(n).withColumnRenamed("id", "_sh_number"), n, seed=99).orderBy("_sh_number").collect()])
    assert (other == places).mean() < 0.01


def test_long_walks_end_inside(spark, monkeypatch):
    # far more outside numbers than the network has by itself, so that walks are long
    monkeypatch.setattr(sharding, "sides", lambda n: (40, 40))
    rows = sharding.permute(spark.range(37).withColumnRenamed("id", "_sh_number"), 37).collect()
    assert sorted(r._sh_place for r in rows) == list(range(37))


def test_shards_of_odd_rows(spark):
    rows = [(i, text(i, 5), "s") for i in range(50)] + [(7, "same", "s")] * 30 + [(None, None, None)] * 20 + [(8, "x" * 200_000, "s"), (9, "é\x00", "s")]
    docs = documents(spark, rows).withColumn("shard", F.lit("mine")).withColumn("_metadata", F.lit(1)).repartition(6)
    numbered, n = sharding.stored(docs)
    assert n == len(rows) and sorted(r._sh_number for r in numbered.select("_sh_number").collect()) == list(range(n))
    placed = sharding.shard(numbered, n)
    assert placed.columns == [*docs.columns, "_sh_number", "_sh_shard", "_sh_slot"]
    got = placed.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    slots = {}
    for r in got:
        slots.setdefault(r._sh_shard, []).append(r._sh_slot)
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, (sharding.shard(numbered, n)).select("_sh_number", "_sh_shard", "_sh_slot").collect())) == sorted(
        (r._sh_number, r._sh_shard, r._sh_slot) for r in got)
    path = new_path(spark, "shards")
    sharding.write_shards(placed, path, files_per_shard=2)
    back = spark.read.parquet(path)
    assert sorted((r._sh_shard, r._sh_slot, r.text or "") for r in back.collect()) == sorted((r._sh_shard, r._sh_slot, r.text or "") for r in got)
    files = back.select("_sh_shard", "_sh_slot", F.input_file_name().alias("f")).collect()
    spans = {}
    for r in files:
        spans.setdefault((r._sh_shard, r.f), []).append(r._sh_slot)
    assert all(s == list(range(s[0], s[0] + len(s))) for s in spans.values())
    empty, none = sharding.stored(docs.limit(0))
    assert none == 0 and sharding.shard(empty, none).count() == 0


def test_shard_query_over_several_files(spark, tmp_path):
    from tidemark.llm.queries import feistel_shards

    documents(spark, [(i, None if i % 9 == 0 else text(i, 3), "s") for i in range(200)]).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = feistel_shards(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert Counter(r.shard for r in got) == Counter({k: 13 if k < 8 else 12 for k in range(16)})
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


# -- 13 audit ---------------------------------------------------------------------------------


def brute_audit(rows, labels):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > low[t]}
        parts.setdefault(lang or "", []).append((fails, *labels.get(i, (0, 0))))
    out = {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                here = [d for d in docs if not any(d[0][g] for g in order[:s])]
                gone = [d for d in here if d[0][f]]
                failing = sum(d[0][f] for d in docs)
                out[part, "".join(order), s + 1] = [
                    len(here) - len(gone), len(gone), failing - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return out


def test_audit_counts_every_order(spark):
    r = np.random.default_rng(6)
    kinds = [lambda i: text(i, 150), lambda i: text(i % 3, 40), lambda i: "AB cd " * 60, lambda i: text(i, 120) + " # $", lambda i: "the same words again " * 30,
             lambda i: None, lambda i: "", lambda i: "A" * (i % 4) + "b" * 30, lambda i: " ".join(f"{k}#Q" for k in range(130))]
    rows = [(i, kinds[int(r.integers(len(kinds)))](i), ["en", "de", None, ""][int(r.integers(4))]) for i in range(160)]
    rows += [(None, text(1, 40), "en"), (None, "new words", "de"), (None, "new words", "de"), (3, rows[3][1], "en"), (3, rows[3][1], rows[3][2]),
             (500, "w " * 60_000, "fr"), (501, "ÄÖ " * 400, "fr"), (502, text(1, 40), "fr")]
    labels = [(i, int(r.integers(2)), int(r.integers(2))) for i in range(0, 160, 2)] + [(4, 1, None), (None, 1, 1), (900, 1, 1), (6, None, 1)]
    best = {}
    for i, q, t in labels:
        if i is not None:
            best[i] = (max(q or 0, best.get(i, (0, 0))[0]), max(t or 0, best.get(i, (0, 0))[1]))
    docs = spark.createDataFrame([(*row, 1, "x", 0) for row in rows], "doc_id long, text string, lang string, n int, part string, pattern int").repartition(5)
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(a.part, a.filter_order, a.step): [a[f] for f in filter_audit.FIGURES] for a in got} == brute_audit(rows, best)
    assert len(got) == 4 * 600
    assert filter_audit.audit_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 0), ("p", 6, 3, 0, 2), ("q", 7, 4, 0, 0)], "part string, pattern int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(cells, "xyz").collect()}
    assert len(got) == 2 * 18
    assert [got["p", "yzx", s].removed for s in (1, 2, 3)] == [3, 0, 2] and got["p", "zyx", 2].redundant == 3
    assert got["p", "yzx", 1].shapley == 9 and got["q", "xyz", 1].kept == 0 and got["q", "xyz", 3].kept == 0
    with pytest.raises(ValueError, match="seven"):
        filter_audit.audit(cells, "abcdefgh")


# -- 4 the bytes of archives ------------------------------------------------------------------


def test_archives_are_records_of_the_format(spark):
    odd = "x" * 120 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/b c", odd), (2, None, odd), (3, "", ""), (4, "http://ä", None), (5, "http://c", "é" * 200_000)]
    path = new_path(spark, "warc-bytes")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, date="2024-05-06T07:08:09Z")
    seen = {}
    for file in Path(path).glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *fields = data[at:end].decode("ascii").split("\r\n")
            assert version == "WARC/1.0" and all(re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+: \S.*", f) for f in fields)
            head = dict(f.split(": ", 1) for f in fields)
            assert len(head) == len(fields)
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(head)
            assert re.fullmatch(r"<[a-z]+:\S+>", head["WARC-Record-ID"]) and head["WARC-Date"] == "2024-05-06T07:08:09Z"
            assert re.fullmatch(r"[a-z]+:\S+", head["WARC-Target-URI"]) and head["Content-Type"].startswith("text/html")
            assert ("WARC-Profile" in head) == ("WARC-Refers-To" in head) == (head["WARC-Type"] == "revisit")
            body = data[end + 4: end + 4 + int(head["Content-Length"])]
            at = end + 4 + len(body) + 4
            assert data[at - 4: at] == b"\r\n\r\n"
            seen[head["WARC-Record-ID"]] = head["WARC-Type"], body.decode()
    assert seen == {"<urn:page:1>": ("response", odd), "<urn:page:2>": ("revisit", ""), "<urn:page:3>": ("response", ""),
                    "<urn:page:4>": ("response", ""), "<urn:page:5>": ("response", "é" * 200_000)}


# -- 7 the likelihood of the ordinal model ----------------------------------------------------


def plain_loss(counts, grades, thresholds, weights, l2):
    """Mean negative log likelihood of grades, text by text, plus the penalty."""
    total = 0.0
    for x, y in zip(counts, grades, strict=True):
        z = sum(a * b for a, b in zip(x, weights, strict=True))
        upto = [0.0, *[1 / (1 + np.exp(-(t - z))) for t in thresholds], 1.0]
        total -= np.log(upto[y + 1] - upto[y])
    return total / len(grades) + l2 / 2 * sum(w * w for w in weights)


def test_ordinal_fit_is_the_maximum_of_the_likelihood():
    r = np.random.default_rng(13)
    grades = np.array([0] * 60 + [1] * 20 + [2] * 20 + [3] * 20)
    names = [11, 22, 33]
    counts = np.array([[r.poisson(rate) if g else int(r.uniform() < 0.05) for rate in (0.4 * g, 0.7 * g, 0.5)] for g in grades])
    rows = [np.array([f for f, n in zip(names, c, strict=True) for _ in range(n)] + [90 + k % 7], dtype=np.int64) for k, c in enumerate(counts)]
    l2 = 0.02
    model = toxicity.fit(rows, grades, 4, l2=l2, steps=5000)
    assert set(model.weights) <= set(names) and len(model.weights) == 3 and model.thresholds == sorted(model.thresholds)
    at = np.array([*model.thresholds, *[model.weights[f] for f in names]])

    def loss(p):
        return plain_loss(counts, grades, p[:3], p[3:], l2)

    slope = [(loss(at + 1e-5 * e) - loss(at - 1e-5 * e)) / 2e-5 for e in np.eye(6)]
    assert np.abs(slope).max() < 2e-3
    # another way down, by numeric slopes from elsewhere, ends at the same place
    p, step = np.array([0.0, 1.0, 2.0, 0.0, 0.0, 0.0]), 1.0
    for _ in range(400):
        g = np.array([(loss(p + 1e-5 * e) - loss(p - 1e-5 * e)) / 2e-5 for e in np.eye(6)])
        while step > 1e-6 and not (np.all(np.diff((p - step * g)[:3]) > 0) and loss(p - step * g) < loss(p)):
            step /= 2
        p, step = p - step * g, min(2 * step, 4.0)
    assert abs(loss(p) - loss(at)) < 1e-4 and np.abs(p - at).max() < 0.15


def test_severity_is_the_expected_grade(spark):
    weights = {f: 0.7 for f in toxicity.word_features("vile")} | {f: -0.2 for f in toxicity.word_features("kind")}
    model = toxicity.OrdinalModel([0.5, 1.0, 2.5], weights)
    texts = ["vile", "vile vile kind", "kind", "", None, "vile " * 30_000 + "other words"]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, y int, f string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for k, t in enumerate(texts):
        z = sum(weights.get(f, 0.0) for w in set((t or "").split()) for f in toxicity.word_features(w))
        upto = [0.0, *[1 / (1 + np.exp(-(x - z))) for x in model.thresholds], 1.0]
        chances = np.diff(upto)
        assert got[k]._tox_severity == pytest.approx(float(chances @ np.arange(4)))
        assert got[k]._tox_grade == sum(1 - u >= 0.5 for u in upto[1:4])
    assert {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()} == {k for k in got if got[k]._tox_grade == 0}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
