"""Exact top-k search in Hamming space by incremental multi-index hashing.

Codes are cut into segments, each with an index of its values. A query looks up the values within a
radius of its own segments; once all m segments were searched to radius s, every code within
m (s + 1) - 1 bits is found. The radius grows, round by round for all open queries at once, until
the k-th verified distance lies within that bound, so the result is exact.

Equal codes are one entry that keeps the k + 1 smallest ids, as no query can return more of them;
a code that very many rows have costs no more than others. A code is verified in the first round
and segment that finds it, and only if it may still enter the query's best k.

Rules for odd rows: rows without an id or a code are neither queries nor results; a query does not
find itself, but rows with its id and its code count once; ties go to the smaller id; with fewer
than k other rows all are returned.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def sign_codes(vector: Column, bits: int) -> Column:
    """Bit b of a code tells whether components b, b + bits, b + 2 bits, ... add up to at least 0."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.aggregate(
        F.filter(vector, lambda x, i: i % bits == b), F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: F.when(a >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    return F.when(F.size(vector) >= bits, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x))


def segments(bits: int, rows: int) -> list[tuple[int, int]]:
    """Offsets and widths of the segments: as wide as the logarithm of the number of codes, so that a value has about one."""
    m = max(1, min(bits, round(bits / max(1.0, log2(max(2, rows))))))
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, weight: int) -> Column:
    """All values of ``width`` bits with ``weight`` ones, as one constant array."""
    values = ",".join(str(sum(1 << i for i in c)) for c in combinations(range(width), weight))
    return F.split(F.lit(values), ",").cast("array<long>")


def top_k(codes: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """``query_id, rank, id, distance`` for ``codes(id, code)`` and ``queries(id, code)``; codes are longs of ``bits`` <= 63 bits."""
    rows = codes.where("id is not null and code is not null").select("id", "code").distinct()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries = cut_lineage(rows.withColumn("r", first).where(F.col("r") <= k + 1).drop("r"))
    held = cut_lineage(entries.select("code").distinct())
    total = entries.count()  # no query can find more than these
    parts = segments(bits, held.count())
    m = len(parts)
    index = held.select("code", F.posexplode(F.array(*[_segment(F.col("code"), a, w) for a, w in parts])).alias("seg", "value"))
    index = cut_lineage(index)
    open_ = cut_lineage(queries.where("id is not null and code is not null").select(F.col("id").alias("qid"), F.col("code").alias("qcode")).distinct()
                        .withColumn("bound", F.lit(bits)))
    best, finished = None, None
    per_query = Window.partitionBy("qid", "qcode").orderBy("distance", "id")
    for s in range(max(w for _, w in parts) + 1):
        probes = None
        for j, (a, w) in enumerate(parts):
            if s <= w:
                own = open_.select("qid", "qcode", "bound", F.lit(j).alias("seg"), F.explode(_masks(w, s)).alias("mask"))
                own = own.select("qid", "qcode", "bound", "seg", _segment(F.col("qcode"), a, w).bitwiseXOR(F.col("mask")).alias("value"))
                probes = own if probes is None else probes.unionByName(own)
        differs = F.col("code").bitwiseXOR(F.col("qcode"))
        # found here first: no segment lies nearer, and none before this one as near
        away = [F.bit_count(_segment(differs, a, w)) for a, w in parts]
        new = F.lit(True)
        for j, d in enumerate(away):
            new = new & (d >= F.when(F.col("seg") > j, F.lit(s + 1)).otherwise(F.lit(s)))
        distance = F.bit_count(differs)
        # merged: Spark cannot know how many values a query is exploded to, and must not broadcast them
        hits = probes.hint("merge").join(index, ["seg", "value"]).where(new & (distance <= F.col("bound"))).select("qid", "qcode", "code", distance.alias("distance"))
        found = hits.join(entries, "code").where(F.col("id") != F.col("qid")).select("qid", "qcode", "id", "distance")
        if best is not None:
            found = best.join(open_.select("qid", "qcode"), ["qid", "qcode"]).unionByName(found)
        # an id with several codes counts once, at its nearest
        nearest = found.groupBy("qid", "qcode", "id").agg(F.min("distance").alias("distance"))
        best = cut_lineage(nearest.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k).drop("rank"))
        covered = m * (s + 1) - 1
        state = best.groupBy("qid", "qcode").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        state = open_.select("qid", "qcode").join(state, ["qid", "qcode"], "left")
        full = F.col("n") >= min(k, max(0, total - 1))
        state = cut_lineage(state.withColumn("done", F.coalesce(full & (F.col("far") <= covered), F.lit(total <= 1))).withColumn(
            "bound", F.when(F.coalesce(F.col("n") >= k, F.lit(False)), F.col("far")).otherwise(F.lit(bits))))
        closed = cut_lineage(best.join(state.where("done").select("qid", "qcode"), ["qid", "qcode"]))
        finished = closed if finished is None else finished.unionByName(closed)
        open_ = cut_lineage(state.where("not done").select("qid", "qcode", "bound"))
        if open_.isEmpty():
            break
    else:  # every value of every segment was looked up
        finished = finished.unionByName(best.join(open_.select("qid", "qcode"), ["qid", "qcode"]))
    return finished.select(F.col("qid").alias("query_id"), F.row_number().over(per_query).alias("rank"), "id", F.col("distance").cast("long").alias("distance"))
