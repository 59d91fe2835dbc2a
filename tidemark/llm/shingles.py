"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

A document's set holds its distinct 5-word shingles. Two sets are similar at threshold t only if
they share one of the first n - ceil(t n) + 1 shingles of each in any common order; with rare
shingles first few documents meet. The order comes from a bounded sketch of how many documents hold
each shingle. Pairs that meet pass a length, a positional and a parity filter and are then compared
once, on their whole sets.

The result is a class per document, so a pair is skipped, without loss, where both are known to be
in one class: a node is a distinct set, named by its 64-bit digest; each set is first compared with
the pivot of the shingles it shares, and what is left to compare are pairs from different classes.
A group of copies of any size thus costs a multiple of its members. Such a pair is listed at the
first shingle it shares and at few others. (Digests are checked to be distinct for distinct sets;
if two were equal, another digest would be taken.)

Rules for odd rows: texts without words have empty sets and are linked with nothing; a text of fewer
words than the shingle is one shingle; rows that repeat an id are compared like other rows; rows
without an id are compared too, and their class is the smallest id in it, or null if it has none.
Input columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, components, slices
from tidemark.session import cut_lineage, let_go

WIDTH = 5
#: Threshold t = PART / WHOLE.
PART, WHOLE = 3, 4
#: Size of the sketch of shingle counts, and of its parts.
SKETCH_BITS, PART_BITS = 22, 16
#: Slots that say which rows' texts are asked for.
SLOT_BITS = 24
#: Shingles in at least 2**HOT more documents (by the sketch) than the median one have their documents dealt over SALTS groups.
HOT, SALTS = 12, 64
KNOWN = 100_000
#: Most rounds of comparing with one more pivot before the rest is compared pair by pair.
ROUNDS = 2
#: Of a set's shingles that meet others, so many are looked at in these rounds, and so many before a shingle when pairs are listed.
HEADS, LAGS = 8, 4
#: Bytes of text that are cut into words at once; words of more bytes than LONG are hashed one by one.
CHUNK, LONG = 1 << 20, 64
SPACES = bytes(int(c == 32 or 9 <= c <= 13) for c in range(256))
TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """64-bit hashes of the words of all texts, one after the other, and where each text's begin (and the last's end).

    Words are taken up eight bytes at a time, for all words at once.
    """
    joined = (b" ".join(texts) + b" " * 9).translate(ASCII_LOWER)
    space = np.frombuffer(joined.translate(SPACES), np.uint8)
    edge = np.flatnonzero(np.diff(space, prepend=1))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    h = mixed((eight[start] & TAIL[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * ODD[4]))
    left, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(left):
        h[left] = mixed((h[left] + ODD[0]) ^ ((eight[start[left] + k] & TAIL[np.minimum(size[left] - k, 8)]) * ODD[1]))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(joined[start[i]:start[i] + size[i]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, [0, *np.searchsorted(start, ends).tolist()]


def chunks(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Runs of the texts of CHUNK bytes or little more, or one text; null counts as empty."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t or b"") > CHUNK:
            yield some
            some, size = [], 0
        some.append(t or b"")
        size += len(some[-1])
    if some:
        yield some


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles, over the whole text."""
    for some in chunks(texts):
        h, at = word_hashes(some)
        n = max(len(h) - WIDTH + 1, 0)
        made = h[:n] * ODD[0]
        for k in range(1, WIDTH):
            made += h[k:n + k] * ODD[k]
        made = mixed(made)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= WIDTH:
                yield np.unique(made[a:b - WIDTH + 1])
            elif b > a:
                s = np.uint64(b - a)
                for k in range(b - a):
                    s = s + h[a + k:a + k + 1] * (ODD[k] ^ np.uint64(0xFFFF))
                yield mixed(s)
            else:
                yield h[:0]


def prefix_length(n: int) -> int:
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def similar(common: int, n: int, m: int) -> bool:
    return common > 0 and WHOLE * common >= PART * (n + m - common)


# -- first pass: sizes, digests and counts ----------------------------------------------------


def digest(s: np.ndarray, turn: int) -> tuple[int, int]:
    d = blake2b(s.tobytes(), digest_size=16, salt=bytes([turn])).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def rows_of(documents: DataFrame) -> DataFrame:
    """``id, row, text``; id and ``row``, a hash of the text, name a row's text."""
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))


def digests(documents: DataFrame, turn: int = 0) -> DataFrame:
    """Per row ``id, row, n, node, check`` (digest of its set), ``marks`` and, per task, parts of the sketch of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
        for b in slices(batches):
            sizes, nodes, checks, marks = [], [], [], []
            for s in shingle_sets(b.column(2).to_pylist()):
                node, check = digest(s, turn)
                sizes.append(len(s))
                nodes.append(node)
                checks.append(check)
                marks.append(marks_of(s))
                at = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                counts[at] += (counts[at] < 65535).astype(np.uint16)
            none = pa.nulls(b.num_rows, pa.int32())
            made = [pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(marks, pa.binary()), none, none, pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=names)
        task, parts = TaskContext.get().partitionId(), counts.reshape(-1, 1 << PART_BITS)
        for k, part in enumerate(parts):
            if part.any():
                row = [None, None, None, None, None, None, k, task, zlib.compress(part.astype("<u4").tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    names = ["id", "row", "n", "node", "check", "marks", "part", "task", "counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    return cut_lineage(rows_of(documents).mapInArrow(
        run, "id long, row long, n int, node long, check long, marks binary, part int, task int, counts binary"))


def rarity(parts: DataFrame, fan: int = 64) -> np.ndarray:
    """For each slot of the sketch the logarithm of its count, a table of fixed size.

    Slots hold more shingles in larger tables, so the count of the median slot is taken off first.
    The parts of ``fan`` tasks at most are added up in one group, level by level.
    """

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << PART_BITS, dtype=np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype="<u4")
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes(), 1)
        return pd.DataFrame({"part": [key[0]], "task": [key[1]], "counts": [packed]})

    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // fan)
        summed = parts.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("part", "task").applyInPandas(add, "part int, task int, counts binary")
        if tasks == 1:
            break
        parts = cut_lineage(summed)
    table = np.zeros((1 << SKETCH_BITS - PART_BITS, 1 << PART_BITS), dtype=np.int64)
    for row in summed.select("part", "counts").collect():  # 64 parts, whatever the input
        table[row[0]] = np.frombuffer(zlib.decompress(row[1]), dtype="<u4")
    return np.floor(np.log2(1 + np.maximum(table.reshape(-1) - int(np.median(table)), 0))).astype(np.uint8)


# -- second pass: prefixes --------------------------------------------------------------------


def prefixes(documents: DataFrame, table, turn: int) -> DataFrame:
    """A row per prefix shingle and set: ``gram, salt, id, n, pos``; ``id`` is the set's node, ``pos`` counts from 0.

    A task passes on a set once, as far as a bounded memory of digests reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, seen = table.value, set()
        for b in slices(batches):
            grams, salts, ids, ns, ps = [], [], [], [], []
            for s in shingle_sets(b.column(2).to_pylist()):
                node, _ = digest(s, turn)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= KNOWN:
                    seen.clear()
                seen.add(node)
                level = rare[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((s, level))[:prefix_length(len(s))]
                grams.append(s[order].view(np.int64))
                salts.append(np.where(level[order] >= HOT, 1 + node % SALTS, 0))
                ids.append(np.full(len(order), node))
                ns.append(np.full(len(order), len(s)))
                ps.append(np.arange(len(order)))
            if ids:
                made = [pa.array(np.concatenate(v).astype(t)) for v, t in zip((grams, salts, ids, ns, ps), (np.int64, np.int32, np.int64, np.int32, np.int32), strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=["gram", "salt", "id", "n", "pos"])

    return rows_of(documents).mapInArrow(run, "gram long, salt int, id long, n int, pos int")


def lengths_allow(a: str, b: str):
    """Length filter for sets of sizes ``n``."""
    n, m = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long")
    return (WHOLE * n >= PART * m) & (WHOLE * m >= PART * n)


def first_shared(a: str, b: str):
    """Whether a shingle at positions ``pos`` may be the first one that two similar sets share; for the first one it is always true.

    The sets then share at most what either has left. It is not the first where one of the few before it is shared.
    """
    n, m, i, j = F.col(f"{a}n").cast("long"), F.col(f"{b}n").cast("long"), F.col(f"{a}pos"), F.col(f"{b}pos")
    before = F.coalesce(reduce(or_, (F.col(f"{a}g{x}") == F.col(f"{b}g{y}") for x in range(LAGS) for y in range(LAGS))), F.lit(False))
    return ((PART + WHOLE) * F.least(n - i, m - j) >= PART * (n + m)) & ~before


def meetings(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of shingles that several documents have, each with the pivot of its shingle, and further pivots.

    The pivot is the set of the smallest digest, so a typical one. A frequent shingle has a pivot in each of its salted groups, and
    these have one of their own; both windows stream and keep no group in memory. A set that several
    tasks passed on has equal rows side by side, of which the last stays.
    """
    w = Window.partitionBy("gram", "salt").orderBy("id")
    first = {c: F.first(c).over(w).alias(f"p_{c}") for c in ("id", "n", "pos")}
    rows = posts.select("gram", "salt", "id", "n", "pos", *first.values(), F.lead("id").over(w).alias("next"))
    rows = rows.where("next is null or next <> id")
    # alone in its group: kept only where other groups of the shingle may hold partners
    rows = cut_lineage(rows.where("id <> p_id or next is not null or salt > 0").drop("next"))
    w = Window.partitionBy("gram").orderBy("id")
    top = rows.where("salt > 0 and id = p_id").select("gram", "salt", "id", "n", "pos")
    top = top.select("gram", "salt", "id", "n", "pos", *[F.first(c).over(w).alias(f"p_{c}") for c in ("id", "n", "pos")])
    return rows, cut_lineage(top.where("id <> p_id"))


# -- comparing --------------------------------------------------------------------------------


def slot():
    return F.pmod(F.xxhash64("id", "row"), F.lit(1 << SLOT_BITS)).cast("int")


def slots_of(wanted: DataFrame) -> np.ndarray:
    """The slots that rows named by ``id, row`` hash to, as a table of bits of fixed size."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << PART_BITS, dtype=np.uint8)
        bits[pdf["slot"] & (1 << PART_BITS) - 1] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    slots = wanted.select(slot().alias("slot")).distinct()
    table = np.zeros((1 << SLOT_BITS - PART_BITS, 1 << PART_BITS - 3), dtype=np.uint8)
    for row in slots.groupBy(F.shiftright("slot", PART_BITS).alias("part")).applyInPandas(pack, "part int, bits binary").collect():  # 256 parts, whatever the input
        table[row[0]] = np.frombuffer(row[1], dtype=np.uint8)
    return table.reshape(-1)


def rows_in(documents: DataFrame, table) -> DataFrame:
    """``id, row, text`` of the rows that hash to one of the slots: all that are wanted and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for b in slices(batches):
            at = b.column(3).to_numpy()
            yield b.select(["id", "row", "text"]).filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return rows_of(documents).withColumn("slot", slot()).mapInArrow(run, "id long, row long, text binary")


def compare(pairs: DataFrame, sets: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar, each compared once.

    The texts of all partners of ``a`` stream past the set of ``a``. A node with many partners is
    dealt over several tasks. Only texts of rows in question are shuffled.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = pairs.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("tail"))
    wanted = heads.unionByName(pairs.select("a", "salt", F.col("b").alias("node"), F.lit(1).alias("tail")))
    wanted = cut_lineage(wanted.join(sets.select("node", "id", "row"), "node"))
    shared = documents.sparkSession.sparkContext.broadcast(slots_of(wanted))
    # merged, so that no plan depends on how many there are
    at = wanted.select("a", "salt", "node", "tail", F.col("id").alias("w_id"), F.col("row").alias("w_row")).hint("merge")
    rows = rows_in(documents, shared).join(at, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row")))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "tail").select("a", "salt", F.col("node").alias("id"), "tail", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sets = None, []
        for b in slices(batches):
            found = []
            *keys, texts_ = (b.column(k).to_pylist() for k in range(5))
            for a, salt, i, tail, s in zip(*keys, shingle_sets(texts_), strict=True):
                if head != (a, salt):
                    head, sets = (a, salt), []
                if not tail:
                    sets.append(s)
                elif any(similar(len(np.intersect1d(h, s, assume_unique=True)), len(h), len(s)) for h in sets):
                    found.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cut_lineage(rows.mapInArrow(run, "a long, b long").distinct())


def marks_of(s: np.ndarray) -> bytes:
    """For each of many hash ranges, a bit or two per shingle, whether the set has an odd number of shingles there."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """Ranges of unlike parity. Two sets differ in at least as many shingles."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & (1 << bits) - 1)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def probable(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets may differ in as few shingles as similar sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(k).to_pylist() for k in range(2, 6))
            keep = [(PART + WHOLE) * unlike(p, q) <= (WHOLE - PART) * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"), F.col("marks").alias(f"{c}m")), c)
    return cut_lineage(pairs.select("a", "b", "an", "bn", "am", "bm").mapInArrow(run, "a long, b long"))


def links(documents: DataFrame, rows: DataFrame, table, turn: int) -> DataFrame:
    """Links ``(a, b)`` that connect all similar sets; ``rows`` names a row for each of them."""
    shared = documents.sparkSession.sparkContext.broadcast(table)
    rows_met, top = meetings(prefixes(documents, shared, turn))
    let_go(documents.sparkSession)
    met = rows_met.unionByName(top)
    # one row of each set that meets another
    ends = met.select("id").unionByName(met.select(F.col("p_id").alias("id"))).distinct().withColumnRenamed("id", "node")
    sets = rows.join(ends, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "row", "n", "marks")).alias("at"))
    sets = cut_lineage(sets.select("node", "at.*"))

    # 1. each set with the pivot with which it shares most shingles
    pivots = met.where(lengths_allow("", "p_") & (F.col("id") != F.col("p_id"))).groupBy("id", "p_id").agg(F.count("*").alias("k"))
    best = pivots.groupBy("id").agg(F.max(F.struct("k", "p_id")).alias("p"))
    done = cut_lineage(best.select(F.least("id", "p.p_id").alias("a"), F.greatest("id", "p.p_id").alias("b")).distinct())
    found = compare(probable(done, sets), sets, documents)
    # 2. sets out of a shingle's largest class with pivots of that class, as long as that brings much
    posts = rows_met.select("gram", "id", "n", "pos")
    heads = cut_lineage(posts.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("r") <= HEADS).drop("r"))
    for turn in range(ROUNDS):
        named = cut_lineage(_mixed(heads, _classes(found)))
        pivot = named.where("class = home").groupBy("gram").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id", "n")).alias("p"))
        pivot = pivot.select("gram", F.col("p.id").alias("p_id"), F.col("p.n").alias("p_n"))
        near = named.where("class <> home").join(pivot, "gram").where(lengths_allow("", "p_")).groupBy("id", "p_id").agg(F.count("*").alias("k"))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("k"), "p_id"))).where("r <= 2")
        near = cut_lineage(near.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        if near.isEmpty():
            break
        found, done = cut_lineage(found.unionByName(compare(probable(near, sets), sets, documents))), done.unionByName(near)
    # 3. all that are left: those out of the largest class with all of other classes
    named, w = _mixed(posts, _classes(found)), Window.partitionBy("id").orderBy("pos")
    named = cut_lineage(named.withColumns({f"g{k}": F.lag("gram", k + 1).over(w) for k in range(LAGS)}))
    names = ["id", "n", "pos", "class", *(f"g{k}" for k in range(LAGS))]
    strays = named.where("class <> home").select("gram", *[F.col(c).alias(f"x_{c}") for c in names])
    all_ = named.select("gram", *[F.col(c).alias(f"y_{c}") for c in names], (F.col("class") == F.col("home")).alias("at_home"))
    cross = strays.join(all_, "gram").where((F.col("x_class") != F.col("y_class")) & (F.col("at_home") | (F.col("x_id") < F.col("y_id"))) & lengths_allow("x_", "y_") & first_shared("x_", "y_"))
    cross = cross.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    cross = probable(cross.join(done, ["a", "b"], "left_anti"), sets)
    if not cross.isEmpty():
        found = found.unionByName(compare(cross, sets, documents))
    return found


def _classes(found: DataFrame) -> DataFrame:
    return cut_lineage(components(found))


def _mixed(posts: DataFrame, group: DataFrame) -> DataFrame:
    """Postings of shingles that sets of several classes have, with their class and the shingle's largest."""
    named = posts.join(group.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    by_class = named.groupBy("gram", "class").agg(F.count("*").alias("k"))
    homes = by_class.groupBy("gram").agg(F.max_by("class", "k").alias("home"), F.count("*").alias("classes")).where("classes > 1")
    return named.join(homes.select("gram", "home"), "gram")


def classes_of(documents: DataFrame) -> DataFrame:
    """Per row ``id, row, n, class, component_id``; the class is null where no other row is in it."""
    turn = 0
    while True:
        first = digests(documents, turn)
        rows = first.where("part is null").select("id", "row", "n", "node", "check", "marks")
        if rows.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").isEmpty():
            break
        turn += 1
    filled = rows.where("n > 0")
    found = links(documents, filled, rarity(first.where("part is not null").select("part", "task", "counts")), turn)
    # the class of a set that is linked or repeats is looked up; others are their own
    group = _classes(found)
    sets = filled.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("k")).join(group, "node", "left").where("k > 1 or component is not null")
    sets = cut_lineage(sets.select("node", F.coalesce("component", "node").alias("component"), "least"))
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut_lineage(sets.join(least, "component").select("node", F.col("component").alias("class"), "component_id"))
    rows = rows.drop("marks").join(named, "node", "left")
    linked = F.col("class").isNotNull() & (F.col("n") > 0)
    return rows.select("id", "row", "n", F.when(linked, F.col("class")).alias("class"), F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``documents(doc_id, text)``."""
    return classes_of(documents).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class, of the smallest id (then hash of the text); rows in none and rows without an id stay."""
    rows = cut_lineage(classes_of(documents.select("doc_id", "text")).where("class is not null and id is not null").groupBy("class", "id", "row").agg(F.count("*").alias("k")))
    first = cut_lineage(rows.groupBy("class").agg(F.min(F.struct("id", "row")).alias("first")))
    rows = rows.join(first, "class").withColumn("kept", (F.col("id") == F.col("first.id")) & (F.col("row") == F.col("first.row")))
    rows = cut_lineage(rows.select(F.col("id").alias("_sh_id"), F.col("row").alias("_sh_row"), "kept", "k"))
    row = F.xxhash64("text")
    same = (F.col("doc_id").cast("long") == F.col("_sh_id")) & (row == F.col("_sh_row"))
    left = documents.join(rows.where("not kept").select("_sh_id", "_sh_row"), same, "left_anti").select(*documents.columns)
    # the kept row itself may come several times
    again = cut_lineage(rows.where("kept and k > 1").select("_sh_id", "_sh_row"))
    if again.isEmpty():
        return left
    one = left.join(again, same, "left_semi").withColumn("_sh_row", row).dropDuplicates(["doc_id", "_sh_row"]).drop("_sh_row")
    return left.join(again, same, "left_anti").unionByName(one)
