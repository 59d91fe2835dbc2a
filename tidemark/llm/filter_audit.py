"""What filters of documents remove alone, together and in every order.

Each document gets one bit per filter it fails. Documents are counted by part and pattern of bits,
so what is left of a part is a tensor of 2 x 2 x 2 x 2 x 2 counts (all, good and toxic documents).
Every figure of every step of every order is a contraction of that tensor: along each axis a filter
that ran before selects "pass", the filter of the step "fail" or "pass", the others "all"; one einsum
evaluates all orders and steps of a batch of parts.

Copies of a text are found by two 64-bit hashes. Counts per (text, part) are combined before they are
shuffled, and the smallest id is compared per (text, part), so a text that a third of all documents
share is no large group.

Rules for odd rows: a null text is an empty one; a null part is the empty string; a row without an id
is no earlier copy of any other and never a later one, nor are rows that repeat the smallest id of a text;
several labels of a document count as good or toxic if one says so; an empty table has no parts and
gives no rows. Input columns may have any names; helper columns start with ``_fa_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.session import cut_lineage

#: Parts of one contraction; each gives a row per order and step.
PARTS = 64


def content_failures(text: Column) -> dict[str, Column]:
    """Filters that look at one document, as the condition of failing."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def patterns(documents: DataFrame, labels: DataFrame, failures: dict[str, Column], doc_id: str, text: str, part: str) -> DataFrame:
    """``(part, pattern, n, good, toxic)``: documents by bits of failed filters; those of ``failures``
    come first, the last bit is that of copies of a text with a smaller id."""
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(0) for k, c in enumerate(failures.values())), F.lit(0))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.xxhash64(body).alias("_fa_h1"), F.xxhash64(F.lit(1), body).alias("_fa_h2"), F.coalesce(F.col(part), F.lit("")).alias("_fa_part"),
        bits.alias("_fa_bits"), F.col(doc_id).alias("_fa_id"))
    # a row per document; all keys take part in the shuffle, so copies spread
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_fa_n"))
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_fa_doc")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("_fa_good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("_fa_toxic"))
    rows = rows.join(flags, F.col("_fa_id") == F.col("_fa_doc"), "left").na.fill(0, ["_fa_good", "_fa_toxic"])
    # at most a row per text, part and flags from here on
    hashes = ["_fa_h1", "_fa_h2"]
    texts = rows.groupBy(*hashes, "_fa_part", "_fa_bits", "_fa_good", "_fa_toxic").agg(
        F.sum("_fa_n").alias("_fa_n"), F.min("_fa_id").alias("_fa_low"), F.min_by("_fa_n", "_fa_id").alias("_fa_at_low"),
        F.sum(F.when(F.col("_fa_id").isNull(), F.col("_fa_n")).otherwise(0)).alias("_fa_nameless"))
    first = F.min("_fa_low").over(Window.partitionBy(*hashes))
    passing = F.col("_fa_nameless") + F.when(F.col("_fa_low") == first, F.col("_fa_at_low")).otherwise(0)
    split = texts.withColumn("_fa_pass", passing).select(
        "_fa_part", "_fa_good", "_fa_toxic", F.inline(F.array(
            F.struct(F.col("_fa_bits").alias("pattern"), F.col("_fa_pass").alias("n")),
            F.struct((F.col("_fa_bits") + (1 << len(failures))).alias("pattern"), (F.col("_fa_n") - F.col("_fa_pass")).alias("n")))))
    return split.groupBy(F.col("_fa_part").alias("part"), "pattern").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_fa_good")).alias("good"), F.sum(F.col("n") * F.col("_fa_toxic")).alias("toxic"))


PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def contracted(tensor: np.ndarray, names: Sequence[str]) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Orders and steps, and per figure an array (parts, steps) from a tensor (parts, measures, 2, ..., 2).

    Axes follow ``names``; measures are all, good and toxic documents.
    """
    m = len(names)
    orders = list(permutations(range(m)))
    steps = [("".join(names[f] for f in order), s + 1) for order in orders for s in range(m)]
    at = [order[s] for order in orders for s in range(m)]

    def contract(selectors: list[list[tuple[int, int]]]) -> np.ndarray:
        chosen = np.array(selectors, dtype=np.int64)       # steps, axes, 2
        operands: list = [tensor, [0, 1, *range(3, 3 + m)]]
        for axis in range(m):
            operands += [chosen[:, axis], [2, 3 + axis]]
        return np.einsum(*operands, [0, 1, 2])

    def each(before, own, rest) -> list[list[tuple[int, int]]]:
        return [[before if f in order[:s] else own if f == order[s] else rest for f in range(m)] for order in orders for s in range(m)]

    removed, kept = contract(each(PASS, FAIL, ALL)), contract(each(PASS, PASS, ALL))
    failing, alone = contract(each(ALL, FAIL, ALL)), contract(each(PASS, FAIL, PASS))
    filters = np.array(at)
    shapley = np.stack([removed[:, 0, filters == f].sum(axis=1) for f in range(m)], axis=1)[:, filters]
    return steps, {
        "kept": kept[:, 0], "removed": removed[:, 0], "redundant": failing[:, 0] - removed[:, 0], "unique_fails": alone[:, 0],
        "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shapley}


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(part, filter_order, step, <figures>)`` from ``counts(part, pattern, n, good, toxic)``.

    Bit k of a pattern says that filter ``names[k]`` fails. Names are single letters; orders are all
    permutations, so filters should be few. Parts are independent of each other.
    """
    m = len(names)
    if m > 7 or any(len(n) != 1 for n in names):
        raise ValueError("at most seven filters of one letter each")
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells"))
    step_count = math.factorial(m) * m

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), PARTS):
                some = frame.iloc[i:i + PARTS]
                flat = np.zeros((len(some), 3, 1 << m), dtype=np.int64)
                for p, cells in enumerate(some["cells"]):
                    for c in cells:
                        flat[p, :, c["pattern"]] = c["n"], c["good"], c["toxic"]
                # the highest bit is the first axis
                tensor = flat.reshape(len(some), 3, *[2] * m).transpose(0, 1, *range(m + 1, 1, -1))
                steps, figures = contracted(tensor, names)
                out = {"part": np.repeat(some["part"].to_numpy(), step_count), "filter_order": [o for o, _ in steps] * len(some),
                       "step": np.array([s for _, s in steps] * len(some), dtype=np.int32)}
                yield pd.DataFrame(out | {f: figures[f].ravel() for f in FIGURES})

    return rows.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES))


def audit_documents(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of the four content filters and of E, copies of a text with a smaller id."""
    failures = content_failures(F.coalesce(F.col(text), F.lit("")))
    return audit(cut_lineage(patterns(documents, labels, failures, doc_id, text, part)), [*failures, "E"])
