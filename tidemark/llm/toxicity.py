"""Severity of toxic texts by a cumulative-link ordinal regression over sparse word features.

Grades 0 .. K-1 are ordered; P(grade <= j) = sigmoid(theta_j - w.x) with one weight vector for all
thresholds. Features are hashed words and word beginnings, as insults are inflected; their value is
the number of distinct words of the text that have them. Only features that are more frequent in
higher grades are weighed. The model is fitted on a bounded sample of labelled rows (the smallest
hashes of the id, so reruns agree); every document is scored, whole.

Rules for odd rows: a null or empty text has no features and gets the severity of the thresholds
alone; rows without a label take no part in fitting; labels of one grade only, or none, give a
model that calls every document grade 0; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices
from tidemark.session import cut_lineage

#: Most labelled rows that a fit uses, bits of the hashed features, toxic rows that a feature must
#: occur in, how much more frequent than in other rows it must be, lengths of word beginnings.
SAMPLE, BITS, LEAST_ROWS, LEAST_RATIO, BEGINNINGS = 8_000, 30, 4, 5.0, range(4, 9)
#: Remembered words of a scoring process.
KNOWN = 200_000
WORDS = regex.compile(r"[\p{L}\p{M}]+")


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings; those of a whole word and of a beginning differ."""
    parts = [word + " ", *(word[:n] for n in BEGINNINGS if n <= len(word))]
    return [xxhash.xxh3_64_intdigest(p.encode()) >> (64 - BITS) for p in parts]


class _Known(dict):
    """Bounded memory of a function of words."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, word):
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = self.fn(word)
        return value


def distinct_words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


@dataclass
class OrdinalModel:
    """Thresholds and the weights of the features that matter."""

    thresholds: list[float]
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self, texts: list[str], known: _Known) -> np.ndarray:
        return np.array([sum(map(known.__getitem__, distinct_words(t))) for t in texts])

    def beyond(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -60, 60)))


def marker_features(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Features that rows above grade 0 have at least ``LEAST_RATIO`` times as often as others."""
    yes, no = np.flatnonzero(grades > 0), np.flatnonzero(grades == 0)

    def counted(which):
        found = [np.unique(rows[i]) for i in which]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))

    (bad, bad_n), (good, good_n) = counted(yes), counted(no)
    among = np.zeros(len(bad))
    if len(good):
        at = np.minimum(np.searchsorted(good, bad), len(good) - 1)
        among = np.where(good[at] == bad, good_n[at], 0)
    ratio = (bad_n / max(1, len(yes))) / ((among + 1) / max(1, len(no)))
    return bad[(ratio >= LEAST_RATIO) & (bad_n >= min(LEAST_ROWS, max(2, len(yes) // 4)))]


def fit(rows: list[np.ndarray], grades: np.ndarray, grades_count: int, l2: float = 2e-5, steps: int = 600) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam on the whole sample.

    ``rows`` holds the feature of each word and text, with repeats. Thresholds are kept in order by
    fitting the logarithms of their gaps.
    """
    k = grades_count - 1
    if len(rows) == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel([60.0] * k)
    features = marker_features(rows, grades)
    row, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    col = np.minimum(np.searchsorted(features, flat), max(0, len(features) - 1))
    stay = features[col] == flat if len(features) else np.zeros(len(flat), dtype=bool)
    row, col = row[stay], col[stay]
    base = np.array([np.clip(np.mean(grades > j), 1e-3, 1 - 1e-3) for j in range(k)])
    theta = np.log((1 - base) / base)
    p = np.concatenate([np.zeros(len(features)), theta[:1], np.log(np.maximum(np.diff(theta), 0.05))])
    m, v, nf, n = np.zeros_like(p), np.zeros_like(p), len(features), len(rows)
    for step in range(1, steps + 1):
        w, gaps = p[:nf], np.exp(p[nf + 1:])
        th = np.concatenate([p[nf:nf + 1], p[nf] + np.cumsum(gaps)])
        z = np.bincount(row, weights=w[col], minlength=n) if len(col) else np.zeros(n)
        below = 1 / (1 + np.exp(np.clip(z[:, None] - th[None, :], -60, 60)))
        cum = np.column_stack([np.zeros(n), below, np.ones(n)])
        hi, lo = cum[np.arange(n), grades + 1], cum[np.arange(n), grades]
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dz = (dhi - dlo) / prob / n  # of the negative log likelihood
        dth = np.zeros(k)
        for j in range(k):
            dth[j] = np.sum(np.where(grades == j, -dhi / prob, 0) + np.where(grades == j + 1, dlo / prob, 0)) / n
        dw = (np.bincount(col, weights=dz[row], minlength=nf) if len(col) else np.zeros(nf)) + l2 * w
        tail = np.cumsum(dth[::-1])[::-1]
        g = np.concatenate([dw, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    gaps = np.exp(p[nf + 1:])
    heavy = np.abs(p[:nf]) > 0.01
    return OrdinalModel([float(x) for x in np.concatenate([p[nf:nf + 1], p[nf] + np.cumsum(gaps)])],
                        dict(zip(features[heavy].tolist(), p[:nf][heavy].tolist(), strict=True)))


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 .. 3 from a yes-or-no label.

    Toxic rows are cut into thirds by how often they hold marker features; others are 0.
    """
    grades = (toxic > 0).astype(np.int64)
    yes = np.flatnonzero(grades)
    if len(yes):
        markers = marker_features(rows, grades)
        hits = np.array([int(np.isin(rows[i], markers).sum()) for i in yes])
        low, high = np.quantile(hits, [1 / 3, 2 / 3])
        grades[yes] = 1 + (hits > low) + (hits > high)
    return grades


def sample_features(documents: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Marker features and labels of at most ``sample`` labelled documents.

    Features are counted by Spark; only the markers, and what the sample has of them, reach the driver.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("long").alias("_tox_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "_tox_y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [[f for w in distinct_words(t or "") for f in word_features(w)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "y", "f"])

    rows = cut_lineage(texts.mapInArrow(run, "doc_id long, y long, f array<int>"))
    bad, good = F.count_if(F.col("y") > 0), F.count_if(F.col("y") == 0)
    n_bad, n_good = rows.agg(bad, good).first()
    counts = rows.select("y", F.explode(F.array_distinct("f")).alias("f")).groupBy("f").agg(bad.alias("bad"), good.alias("good"))
    least = min(LEAST_ROWS, max(2, n_bad // 4))
    ratio = (F.col("bad") / max(1, n_bad)) / ((F.col("good") + 1) / max(1, n_good))
    markers = np.sort(counts.where((ratio >= LEAST_RATIO) & (F.col("bad") >= least)).select("f").toPandas()["f"].to_numpy(dtype=np.int32))

    def only_markers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [[] if f is None else np.asarray(f, dtype=np.int32)[np.isin(f, markers)].tolist() for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "f"])

    got = rows.mapInArrow(only_markers, "doc_id long, y long, f array<int>").toPandas().sort_values("doc_id", kind="stable")
    return [np.asarray(f, dtype=np.int64) for f in got["f"]], got["y"].to_numpy(dtype=np.int64)


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    rows, toxic = sample_features(documents, labels, "toxic", sample)
    return fit(rows, severity_grades(rows, toxic), 4)


def score(documents: DataFrame, model: OrdinalModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, the expected severity and the grade: the number of thresholds likelier passed than not."""
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("_tox_severity", T.DoubleType()), T.StructField("_tox_grade", T.IntegerType())])
    names, width = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lambda w: sum(model.weights.get(f, 0.0) for f in word_features(w)))
        for b in slices(batches):
            beyond = model.beyond(model.scores([t or "" for t in b.column(width).to_pylist()], known))
            made = [pa.array(beyond.sum(axis=1)), pa.array((beyond >= 0.5).sum(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], names=names)

    return documents.select(*keep, text).mapInArrow(run, schema)


def drop_toxic(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents of grade 0, with their own columns. Texts pass Python once and are not shuffled."""
    keep = tuple(c for c in documents.columns)
    return score(documents.select("*", F.col("text").alias("_tox_text")), model, keep, "_tox_text").where("_tox_grade = 0").select(*documents.columns)
