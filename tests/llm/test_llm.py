"""Operators against brute force on small tables with odd rows, and exact round trips."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import changed, documents, text
from tidemark.llm import bpe, lines, mixing, search, shingles, token_counts, token_records, toxicity, vectors, warc
from tidemark.llm.common import components
from tidemark.llm.queries import encoded_documents
from tidemark.session import new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "Hello  World", "it's I'LL <|endoftext|>x<|startoftext|>", "ΣΑΣ é é ﬁ İ", "日本語 한국어", "a\x00b\x7f", "x" * 3000, "ab " * 3000,
       "123 45.6 $%^ ----", " wide　space\x85", "ᾳ ǅ ß"]


# -- components -------------------------------------------------------------------------------


def brute_components(nodes, edges):
    label = {n: n for n in nodes}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in want.items() if n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 search ---------------------------------------------------------------------------------


def brute_top_k(rows, queries, k):
    out = {}
    for q, c in queries:
        near = {}
        for i, d in rows:
            if i is not None and d is not None and i != q:
                x = bin(c ^ d).count("1")
                near[i] = min(x, near.get(i, 99))
        out[q] = sorted((x, i) for i, x in near.items())[:k]
    return out


@pytest.mark.parametrize("n,k,bits", [(300, 5, 32), (40, 10, 16), (6, 10, 16)])
def test_search_is_exact(spark, n, k, bits):
    rng = np.random.default_rng(n)
    rows = [(i, int(c)) for i, c in enumerate(rng.integers(0, 1 << bits, n))]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [rows[1]]      # a very common code, a repeated row
    df = spark.createDataFrame([*rows, (None, 3), (5000, None)], "id long, code long").withColumn("seg", F.lit("clash"))
    queries = [rows[0], rows[1], rows[2], (1003, rows[0][1])]
    found = search.top_k(df, spark.createDataFrame([*queries, (None, 3), (7, None)], "id long, code long"), k, bits).collect()
    got = {q: sorted((r.distance, r.id) for r in found if r.query_id == q) for q, _ in queries}
    assert got == brute_top_k(rows, queries, k)
    assert all(r.rank == 1 + got[r.query_id].index((r.distance, r.id)) for r in found)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "id long, code long")
    assert search.top_k(none, none, 3, 16).count() == 0
    one = spark.createDataFrame([(1, 5)], "id long, code long")
    assert search.top_k(one, one, 3, 16).count() == 0


# -- 2 mixing ---------------------------------------------------------------------------------


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while True:
        level = left / max(1e-9, sum(w[s] for s in open_))
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full


def test_mixing(spark):
    rows = [(i, text(i, 5 + i % 30), f"s{i * i % 7}") for i in range(400)] + [(1000, None, "s1"), (1001, "", None), (1002, text(1, 9), None), (1003, "a b", "s9"), (None, "x y", "s2"), (5, text(5, 10), "s2")]
    docs = documents(spark, rows)
    got = mixing.mix(docs, [3, 1, 2]).collect()
    assert len(got) == len(rows)
    size = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, z in rows if z == s) for s in {z for *_, z in rows}}
    want = brute_targets(size, [3, 1, 2], 1.5, 2)
    by_source = {s: [r for r, (i, t, z) in zip(sorted(got, key=str), sorted(rows, key=str), strict=True)] for s in size}
    assert by_source
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in want.values()}
    totals, longest = Counter(), Counter()
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        totals[round(r.target, 6)] += r.taken
        longest[round(r.target, 6)] = max(longest[round(r.target, 6)], r.size)
    for t, taken in totals.items():
        assert abs(taken - t) <= 2 * longest[t]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), [3, 1, 2]).collect()))
    taken = mixing.take(docs, mixing.mix(docs, [3, 1, 2]))
    assert taken.columns == docs.columns
    assert mixing.mix(docs.limit(0), [3, 1, 2]).count() == 0


def test_mixed_documents_are_those_of_the_mix(spark):
    rows = [(i, text(i, 5 + i % 30), [f"s{i * i % 7}", None][i % 11 == 0]) for i in range(300)] + [(1000, None, "s1"), (None, "x y", "s2"), (7, "of two sources", "s9")]
    docs = documents(spark, rows)
    planned = Counter()
    for (i, t, s), r in zip(sorted(rows, key=str), sorted(mixing.mix(docs, [3, 1, 2]).collect(), key=str), strict=True):
        if i not in (7,):
            planned[i] += r.copies
    got = mixing.mixed(docs.repartition(3), [3, 1, 2])
    assert got.columns == docs.columns
    texts = Counter((r.doc_id, r.text, r.source) for r in got.collect())
    assert set(texts) <= set(rows) and {i: n for i, n in planned.items() if n} == {i: n for (i, *_), n in texts.items() if i != 7}
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert mixing.mixed(docs.limit(0), [3, 1, 2]).count() == 0


# -- 3 vectors --------------------------------------------------------------------------------


def brute_vectors(rows, threshold):
    fine = {k: np.array(v, dtype=np.float32).astype(float) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, n = [], Counter()
    for a in fine:
        for b in fine:
            x, y = fine[a], fine[b]
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                links.append((rows[a][0], rows[b][0]))
    return n, brute_components({i for i, _ in rows if i is not None}, links)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 40)
    monkeypatch.setattr(vectors, "SAMPLE", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(250)]
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + 0.04 * rng.normal(size=16)).tolist()) for i in range(150)]       # near copies
    rows += [(2000 + i, rows[3][1]) for i in range(60)] + [(3000, (2 * np.array(rows[4][1])).tolist())]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [float("inf")] * 16), (4004, [None] * 16), (4005, []), (4006, [1.0]), (4007, [2.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("vec", F.lit(1))
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    n, comp = brute_vectors(rows, 0.95)
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        if i is None:
            assert got[i].n_links == 0 and got[i].component_id is None
        else:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[k], comp[i], comp[i] == i)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_a_dense_ball(spark, monkeypatch):
    """400 vectors that link with their centre and at most four others, and 60 that link with just one of these."""
    monkeypatch.setattr(vectors, "LEAF", 40)
    monkeypatch.setattr(vectors, "PIVOTS", 4)
    rng = np.random.default_rng(7)
    centre = np.eye(64)[0]
    away = rng.normal(size=(400, 64)) * (1 - centre)
    away /= np.linalg.norm(away, axis=1)[:, None]
    rows = [(500, centre.tolist())] + [(i, (centre + 0.29 * v).tolist()) for i, v in enumerate(away)] + [(1000 + i, (centre + 0.6 * away[i]).tolist()) for i in range(60)]
    n, comp = brute_vectors(rows, 0.95)
    assert set(comp.values()) == {0} and n[0] == 400 and sorted(n.values())[-2] <= 5 and all(n[k] == 1 for k in range(401, 461))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: (n[k], 0, i == 0) for k, (i, _) in enumerate(rows)}


# -- 4 archives -------------------------------------------------------------------------------


def test_archives(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    same = "same payload " * 20
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", inner * 3), (3, None, None), (4, "u", ""), (9, "u", same), (5, "u", same), (7, "u", same),
            (8, "u", "short"), (10, "u", "short"), (11, "u", "WARC/1.0\r\n" * 200), (12, "u", inner + "tail WARC/1.0\r\n"), (None, "u", same), (20, "u", "\r\n\r\n"), (5, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1)).withColumn("id", F.lit(2))
    path = new_path(spark, "warc-test")
    warc.write_archives(pages.repartition(3), path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()), key=str)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == same and i in (7, 9)
        want.append((i, "revisit" if again else "response", 5 if again else None, len(body), hashlib.sha256(body).hexdigest()))
    assert got == sorted(want, key=str)
    payloads = Counter(bytes(r.payload).decode() for r in warc.read_archives(spark, path).where("record_type = 'response'").collect())
    assert payloads[inner * 3] == 1 and payloads["WARC/1.0\r\n" * 200] == 1
    # small splits: records and magics fall across borders
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        again = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == got
    empty = new_path(spark, "warc-test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_archives_of_repeated_ids(spark):
    """Rows that repeat an id with other payloads: copies are revisits, own payloads stay."""
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (9, a), (9, b)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path).collect()
    digest = {x: hashlib.sha256(x.encode()).hexdigest() for x in (a, b, c)}
    want = [(1, a, "response", None), (2, a, "revisit", 1), (2, b, "response", None), (3, b, "revisit", 2), (3, c, "response", None), (9, a, "revisit", 1), (9, b, "revisit", 2)]
    assert sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in found) == sorted((i, digest[h], t, r) for i, h, t, r in want)
    assert sorted(bytes(r.payload).decode() for r in found if r.record_type == "response") == [a, b, c]


# -- 5 and 9 token ids ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def test_bpe_equals_the_library(spark, library):
    rng = np.random.default_rng(3)
    letters = list("abcdeinrstoghluéäñ'")
    words = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 25, 4000)]
    texts = [*ODD, " ".join(words), "a" * 400 + " " + "ab" * 300]
    mine = bpe.Bpe(TOKENIZER)
    for t, packed in zip(texts, mine.encode([t.encode() for t in texts]), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(packed, dtype="<u4").tolist() == ids
        assert mine.decode(packed).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_merging_of_few_and_of_many_symbols_agrees():
    mine = bpe.Bpe(TOKENIZER)
    for word in ("hello", "thethethe", "aaaaaaaaaaaaaaaaaaaa", "internationalisation"):
        few = mine.merged(mine.symbols(word))
        assert few == mine.merged_by_heap(mine.symbols(word))


def test_bpe_over_rows(spark, library):
    docs = documents(spark, [*enumerate_texts(ODD), (None, None, "s"), (3, "Hello  World", "s")]).withColumn("ids", F.lit(1))
    ids = bpe.encode(docs.repartition(3), TOKENIZER)
    got = bpe.decode(ids, TOKENIZER).collect()
    want = [library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in [*ODD, None, "Hello  World"]]
    assert Counter(r.text for r in got) == Counter(want)
    assert bpe.encode(docs.limit(0), TOKENIZER).count() == 0


def enumerate_texts(texts):
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_token_records(spark, library):
    rows = [(100 - i, t, "s") for i, t in enumerate(ODD * 20)] + [(None, "no id", "s"), (None, None, "s"), (5, "twice", "s")]
    docs = documents(spark, rows).withColumn("shard", F.lit("clash"))
    path = new_path(spark, "records-test")
    token_records.write_records(docs.repartition(4), path, TOKENIZER)
    read = [token_records.read_records(spark, path, seed).collect() for seed in (None, 7)]
    assert Counter(map(str, read[0])) == Counter(map(str, read[1]))
    got = sorted(read[0], key=lambda r: r.start)
    order = [-1 << 63 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    want = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for i, t, _ in rows)
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    none = new_path(spark, "records-test")
    token_records.write_records(docs.limit(0), none, TOKENIZER)
    assert token_records.read_records(spark, none).count() == 0


def test_damaged_records_are_noticed(tmp_path):
    payload = b"\x01" + bytes(8) + b"ids"
    import struct

    length = struct.pack("<Q", len(payload))
    data = length + struct.pack("<I", token_records.masked(length)) + payload + struct.pack("<I", token_records.masked(payload))
    for k in range(len(data) + 1):
        with open(tmp_path / "f", "wb") as f:
            f.write(data[:k] + bytes([data[k] ^ 1]) + data[k + 1:] if k < len(data) else data)
        with open(tmp_path / "f", "rb") as f:
            if k < len(data):
                with pytest.raises(ValueError):
                    token_records.frame(f, 0)
            else:
                assert token_records.frame(f, 0) == payload


# -- 6 counts ---------------------------------------------------------------------------------


def test_token_counts(spark):
    schema = "op string, seq int, doc_id long, source string, lang string, version string, tokens long, docs int"
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup-test"))
    first = [("insert", 0, i, "a" if i % 3 else None, "en", "v1", i, 0) for i in range(30)] + [("insert", 0, None, "n", None, "v1", None, 0)]
    second = [("revise", 0, 1, "b", "en", "v1", 100, 0), ("revise", 1, 1, "b", "en", "v1", 7, 0), ("delete", 0, 2, None, None, "v1", None, 0),
              ("delete", 0, 999, None, None, "v1", None, 0), ("insert", 0, 4, "a", "en", "v2", 5, 0), ("revise", 0, 77, "c", "de", "v1", 3, 0), ("insert", 0, 5, "a", "en", "v1", 50, 0)]
    totals = lambda: {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}
    assert totals() == {}
    assert rollup.apply("one", spark.createDataFrame(first, schema))
    before = totals()
    assert not rollup.apply("one", spark.createDataFrame(second, schema)) and totals() == before
    assert rollup.apply("two", spark.createDataFrame(second, schema))
    assert rollup.apply("none", spark.createDataFrame([], schema))
    state = {(r[2], r[5]): (r[3], r[4], r[6] or 0) for r in first}
    state |= {(1, "v1"): ("b", "en", 7), (4, "v2"): ("a", "en", 5), (77, "v1"): ("c", "de", 3), (5, "v1"): ("a", "en", 50)}
    del state[2, "v1"]
    want = {}
    for (_, v), (s, lang, n) in state.items():
        d, t = want.get((s, lang, v), (0, 0))
        want[s, lang, v] = (d + 1, t + n)
    assert totals() == want
    # a batch that broke off before its commit has no effect until it is applied again
    spark.createDataFrame([("three", 1, "v1", "a", "en", 5, 5)], token_counts.LEDGER).write.parquet(f"{rollup.path}/ledger/batch=three")
    spark.createDataFrame([("three", "a", "en", "v1", 5, 5)], token_counts.DELTA).write.parquet(f"{rollup.path}/delta/batch=three")
    assert totals() == want
    assert rollup.apply("three", spark.createDataFrame([("delete", 0, 1, None, None, "v1", 0, 0)], schema))
    del want["b", "en", "v1"]
    assert totals() == want


# -- 7 toxicity -------------------------------------------------------------------------------


def test_toxicity(spark):
    bad = ["scumling", "scumlet", "scummo"]
    rows, labels = [], []
    for i in range(600):
        words = text(i, 60).split(" ")
        if i % 6 == 0:
            for k in range(1 + i % 4):
                words[7 * k] = bad[(i // 6 + k) % 3]
        rows.append((i, " ".join(words), "s"))
        if i < 400:
            labels.append((i, int(i % 6 == 0)))
    rows += [(900, None, "s"), (901, "", "s"), (None, text(1), "s"), (0, rows[0][1], "s")]
    docs = documents(spark, rows).withColumn("_y", F.lit(1))
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    unseen = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean([(r._tox_grade > 0) == (r.doc_id % 6 == 0) for r in unseen]) > 0.97
    more = [r._tox_severity for r in unseen if r.doc_id % 12 == 6], [r._tox_severity for r in unseen if r.doc_id % 12 == 0]
    assert np.mean(more[0]) > np.mean(more[1])       # three markers against one
    assert all(r._tox_grade == 0 for r in got if r.doc_id in (900, 901, None))
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    for none in ([], [(1, 0), (2, 0)]):
        flat = toxicity.fit_toxicity(docs, spark.createDataFrame(none, "doc_id long, toxic int"))
        assert toxicity.score(docs, flat).where("_tox_grade > 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


# -- 8 lines ----------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                held.setdefault(key(s), set()).add(-1 << 63 if i is None else i)
    out = []
    for i, t, _ in rows:
        mine = (t or "").split("\n")
        keep = [s for s in mine if len(held.get(key(s), ())) < 5 or max(held[key(s)]) == (-1 << 63 if i is None else i)]
        out.append((i, len(mine), len(mine) - len(keep), "\n".join(keep)))
    return out


def test_lines(spark):
    common = "A line that very many documents share, ÄÖ included"
    rare = "a line that only four of all the documents share here"
    rows = [(i, "\n".join([text(i, 12), ["  ", "\t", "\x0b"][i % 3] + (common.replace("A", "a") if i % 2 else common) + "\r", "short", common, ""]), "s") for i in range(40)]
    rows += [(100 + i, rare + "\n" + text(i, 3), "s") for i in range(4)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "\n\n", "s"), (None, common + "\nx", "s"), (7, common, "s"), (7, common, "s"), (300, " " + common, "s"), (301, "z\n" * 3000, "s")]
    rows += [(400 + i, ("ß" + "É" * 45) if i % 2 else ("ß" + "é" * 45), "s") for i in range(8)]
    docs = documents(spark, rows)
    done = lines.apply_bitmaps(docs.repartition(6), lines.keep_bitmaps(docs, salts=4)).collect()
    assert sorted(((r.doc_id, r._ln_lines, r._ln_dropped, r._ln_kept) for r in done), key=str) == sorted(brute_lines(rows), key=str)
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_ids_and_decoded_text_come_from_one_worker_a_task(spark):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate([None, *ODD])])
    encoded = encoded_documents(docs)
    assert encoded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER, keep=("doc_id", "ids"))
    want = {r.doc_id: (bytes(r.ids), r.text) for r in two.collect()}
    assert {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.round_trip(docs, TOKENIZER).collect()} == want


# -- 10 shingles ------------------------------------------------------------------------------


def shingle_words(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_shingles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "HOT", 3)      # salt shingles of a few documents
    base, passage = text(1, 120), text(2, 60)
    rows = [(i, changed(changed(base, 3 * i % 110), (7 * i + 40) % 110, f"v{i}"), "s") for i in range(40)]          # a group of near copies
    rows += [(100 + i, text(5, 80), "s") for i in range(15)] + [(120, text(5, 80).upper(), "s")]                     # exact copies
    rows += [(200 + i, passage + " " + text(300 + i, 8 + 2 * i), "s") for i in range(20)]                           # a passage and more or less of their own
    rows += [(300 + i, text(400 + i, 30), "s") for i in range(40)]
    rows += [(500, None, "s"), (501, "", "s"), (502, " \t\n", "s"), (503, "one two", "s"), (504, "One\ntwo", "s"), (505, "one", "s"), (506, "one two three four five", "s"),
             (None, base, "s"), (None, text(5, 80), "s"), (300, text(400, 30), "s"), (510, "a b c d e f", "s"), (511, "go " * 50, "s"), (512, "go " * 500, "s")]
    docs = documents(spark, rows)
    got = shingles.near_duplicates(docs.repartition(7)).collect()
    sets = [shingle_words(t) for _, t, _ in rows]
    at = list(range(len(rows)))
    links = [(a, b) for a in at for b in at if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = brute_components(at, links)
    want = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in at if group[j] == group[k] and rows[j][0] is not None]
        want.append((i, len(sets[k]), min(ids) if ids else None))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    kept = shingles.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 100, 500, 501, None}
    assert shingles.near_duplicates(docs.limit(0)).count() == 0


def test_words_of_many_texts_at_once(monkeypatch):
    long_word = "x" * 300
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "ONE", "onE two", "é É \x85 \xa0 中文", "abcdefgh abcdefghi abcdefghij abcdefgh", f"{long_word} {long_word}y {long_word.upper()}", "a\x00 a a\x00\x00",
             "the cat sat on the mat the cat sat on the mat", "  lead and trail  ", "x" * 64 + " " + "x" * 65, *(text(i, 3 * i) for i in range(30))]
    want = [len(shingle_words(t)) for t in texts]
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(shingles, "CHUNK", size)
        sets = list(shingles.shingle_sets([t.encode() if t is not None else None for t in texts]))
        assert [len(s) for s in sets] == want
        for a, s in zip(texts, sets, strict=True):
            for b, r in zip(texts, sets, strict=True):
                assert len(set(s.tolist()) & set(r.tolist())) == len(shingle_words(a) & shingle_words(b))


def test_marks_are_a_lower_bound():
    rng = np.random.default_rng(0)
    for n, m, common in [(1, 1, 1), (0, 5, 0), (64, 65, 60), (200, 150, 148), (900, 1100, 0), (3000, 100, 90)]:
        x = rng.integers(0, 1 << 63, n + m - common).astype(np.uint64)
        a, b = shingles.marks_of(x[:n]), shingles.marks_of(x[n - common:])
        assert shingles.unlike(a, b) == shingles.unlike(b, a) <= n + m - 2 * common
    assert shingles.unlike(shingles.marks_of(x[:900]), shingles.marks_of(x[900:1800])) > 1800 / 7


def test_common_slots_of_the_sketch_are_not_hot(spark):
    # in large tables every slot holds many shingles; only what stands out is frequent
    counts = np.full(1 << shingles.PART_BITS, 5000, dtype="<u4")
    counts[7] = 15000
    parts = [(k, t, bytearray(zlib.compress(counts.tobytes()))) for k in range(1 << shingles.SKETCH_BITS - shingles.PART_BITS) for t in range(2)]
    table = shingles.rarity(spark.createDataFrame(parts, "part int, task int, counts binary"))
    assert table[7] >= shingles.HOT and (np.delete(table.reshape(-1, 1 << shingles.PART_BITS), 7, axis=1) == 0).all()


def test_a_pair_is_listed_at_few_shingles(spark):
    # 100 shingles each, the two share all but one in seven
    grams = [[g if g % 7 else g + 1000 * k for g in range(1, 26)] for k in (1, 2)]
    rows = [(k, g, 100, p, *(grams[k][p - 1 - x] if p > x else None for x in range(shingles.LAGS))) for k in (0, 1) for p, g in enumerate(grams[k])]
    df = spark.createDataFrame(rows, "id int, gram long, n int, pos int, " + ", ".join(f"g{k} long" for k in range(shingles.LAGS)))
    x, y = (df.where(f"id = {k}").select("gram", *[F.col(c).alias(f"{a}_{c}") for c in df.columns if c != "gram"]) for k, a in ((0, "x"), (1, "y")))
    got = [r.gram for r in x.join(y, "gram").where(shingles.lengths_allow("x_", "y_") & shingles.first_shared("x_", "y_")).collect()]
    assert got == [1]


def test_only_texts_in_question_are_fetched(spark):
    docs = documents(spark, [(i, text(i, 12), "s") for i in range(500)] + [(None, "a b", "s"), (3, "other text", "s")])
    rows = shingles.rows_of(docs)
    wanted = rows.where("id in (3, 77) or id is null").select("id", "row")
    table = spark.sparkContext.broadcast(shingles.slots_of(wanted))
    got = {(r.id, r.row) for r in shingles.rows_in(docs, table).collect()}
    assert got >= {tuple(r) for r in wanted.collect()} and len(got) < 20


def test_keep_one_row_of_repeated_ids(spark):
    a, b, c = (text(k) for k in range(900, 903))
    rows = [(5, a, "u"), (3, changed(a, 9), "v"), (5, b, "u"),                 # 5 is a copy of 3, and unique
            (7, c, "u"), (7, changed(c, 9), "u"), (7, c, "v"), (8, c, "u"),    # 7 repeats itself
            (None, c, "u"), (None, text(905), "u"), (9, "", "u"), (9, None, "u"), (9, None, "u")]
    kept = shingles.keep_one(documents(spark, rows).repartition(5)).collect()
    of = lambda *texts: [(r.doc_id, r.text) for r in kept if r.text in texts]
    assert of(a, changed(a, 9), b) in ([(3, changed(a, 9)), (5, b)], [(5, b), (3, changed(a, 9))])
    assert sorted(i or 0 for i, _ in of(c, changed(c, 9))) == [0, 7]
    assert len(of(text(905))) == len(of("")) == 1 and len(of(None)) == 2 and len(kept) == 8


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_by_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
        docs = spark.read.parquet(*[p for p in [new_path(spark, "pipe")] if not stage(spark, docs, folder).write.parquet(p)])
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns, name
        ids = Counter(r.doc_id for r in after)
        if k == 0:
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            clean = [i for i, *_ in before if labels.get(i) == 0]
            assert np.mean([i in ids for i in clean]) > 0.98
            assert np.mean([i in ids for i, *_ in before if labels.get(i) == 1]) < 0.5
        elif k == 1:
            assert {r.doc_id: r.text for r in after} == {i: t for i, _, _, t in brute_lines(before)}
        elif k == 2:
            sets = {i: shingle_words(t) for i, t, _ in before}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert set(ids) == set(brute_components(sets, links).values())
        elif k == 3:
            assert set(ids) <= {i for i, *_ in before} and max(ids.values()) <= 2
        else:
            library = Tokenizer.from_file(TOKENIZER)
            texts = {i: t for i, t, _ in before}
            for r in after:
                packed = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, dtype="<u4").tobytes()
                assert r.ids_sha256 == hashlib.sha256(packed).hexdigest() and r.n_tokens == len(packed) // 4
    assert corpus_pipeline.ORACLE_SQL is None
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
