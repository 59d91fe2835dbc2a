"""Sharding by a Feistel permutation of row numbers, with cycle walking; DataFrame functions only.

Rows are numbered by their place in the table: files in order of their paths, rows in order within
them. So numbers need no shuffle and do not depend on how Spark cuts the scan; only a count per file
is gathered. A Feistel network permutes 0 .. a*b - 1, where a is the square root of the number of
rows, rounded up, and b is as small as a*b allows. Fewer than a of those numbers lie beyond the table; what lands
there is permuted again until it lies inside. The permuted place, dealt round robin, is the shard,
and its quotient the slot; both follow from row number, seed and row count alone, and ``row_at`` goes the other way without
looking at the table.

Counts of two shards differ by one at most and slots have no gaps, whatever the rows hold: equal ids,
null ids and repeated rows have places of their own; a null text has size 1 and checksum 0; an empty
table gives no rows. Input columns may have any names; added ones start with ``_sh_``.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SHARDS = 16
SEED = 12
#: Half rounds; an even number.
ROUNDS = 8
#: Round functions work below this prime, so that squares stay within a long.
PRIME = (1 << 31) - 1
#: Bytes of file offsets that may be broadcast.
BROADCAST = 64 << 20


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME), r.randrange(PRIME)) for _ in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """a and b with n <= a*b < n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """A Parquet table as it was read, with ``_sh_number`` from 0, and its number of rows.

    The table must not have been filtered or changed since (``stored`` does for such frames). Files
    are few against rows; their offsets are broadcast if that is at most ``BROADCAST`` bytes.
    """
    meta = table.metadataColumn("_metadata")
    rows = table.select("*", meta["file_path"].alias("_sh_file"), meta["row_index"].alias("_sh_row"))
    files = cut_lineage(rows.groupBy("_sh_file").agg(F.count(F.lit(1)).alias("_sh_n")))
    n, size = files.agg(F.coalesce(F.sum("_sh_n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("_sh_file") + 40), F.lit(0))).first()
    before = Window.orderBy("_sh_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(files.withColumnRenamed("_sh_file", "_sh_path").select(
        "_sh_path", F.coalesce(F.sum("_sh_n").over(before), F.lit(0)).alias("_sh_offset")))
    joined = rows.join(F.broadcast(offsets) if size <= BROADCAST else offsets, F.col("_sh_file") == F.col("_sh_path"))
    return joined.withColumn("_sh_number", F.col("_sh_offset") + F.col("_sh_row")).drop("_sh_file", "_sh_row", "_sh_path", "_sh_offset"), n


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """``numbered`` for any frame: its rows are written first. Numbers follow the written files."""
    return numbered(cut_lineage(df))


def _mixed(t: Column, c: Column | int) -> Column:
    return (t * t + c) % PRIME


def _permuted(x: Column, a: int, b: int, seed: int) -> Column:
    """The permutation as one expression, for lambdas; each half round is a step over the keys."""
    keys = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q"), F.lit(c).cast("long").alias("c"),
                              F.lit(b if k % 2 else a).cast("long").alias("m")) for k, (p, q, c) in enumerate(round_keys(seed))])

    def half(s: Column, k: Column) -> Column:
        f = _mixed(_mixed((s["r"] * k["p"] + k["q"]) % PRIME, k["c"]), k["p"])
        return F.struct(s["r"].alias("l"), ((s["l"] + f) % k["m"]).alias("r"))

    start = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))
    return F.aggregate(keys, start, half, lambda s: s["l"] * b + s["r"])


def permute(rows: DataFrame, n: int, seed: int = SEED, number: str = "_sh_number", out: str = "_sh_place") -> DataFrame:
    """Adds the permuted number, a long from 0 to n - 1.

    A walk passes through no outside number twice, so it takes at most a*b - n steps; only the few
    rows that land outside take any.
    """
    a, b = sides(n)
    rows = rows.withColumns({"_sh_l": F.call_function("div", F.col(number), F.lit(b)), "_sh_r": F.col(number) % b})
    for k, (p, q, c) in enumerate(round_keys(seed)):
        # a projection per use of a value, so that none is computed twice
        rows = rows.withColumn("_sh_f", (F.col("_sh_r") * p + q) % PRIME)
        rows = rows.withColumn("_sh_f", _mixed(F.col("_sh_f"), c)).withColumn("_sh_f", _mixed(F.col("_sh_f"), p))
        rows = rows.withColumns({"_sh_l": F.col("_sh_r"), "_sh_r": (F.col("_sh_l") + F.col("_sh_f")) % (b if k % 2 else a)})
    rows = rows.withColumn(out, F.col("_sh_l") * b + F.col("_sh_r")).drop("_sh_l", "_sh_r", "_sh_f")
    outside = a * b - n
    for most in sorted({min(16, outside), outside} - {0}):
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.col(out), lambda x, _: F.when(x < n, x).otherwise(_permuted(x, a, b, seed)))
        rows = rows.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walked))
    return rows


def shard(rows: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Numbered rows with ``_sh_shard`` and ``_sh_slot``."""
    placed = permute(rows, n, seed)
    return placed.select(*rows.columns, (F.col("_sh_place") % shards).cast("int").alias("_sh_shard"),
                         F.call_function("div", F.col("_sh_place"), F.lit(shards)).cast("long").alias("_sh_slot"))


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that has this shard and slot; the inverse of ``shard``."""
    a, b = sides(n)
    x, keys = slot * shards + shard, list(enumerate(round_keys(seed)))
    if not 0 <= x < n or not 0 <= shard < shards:
        raise ValueError(f"no slot {slot} in shard {shard} of {n} rows")
    while True:
        l, r = divmod(x, b)
        for k, (p, q, c) in reversed(keys):
            f = (l * p + q) % PRIME
            for add in (c, p):
                f = (f * f + add) % PRIME
            l, r = (r - f) % (b if k % 2 else a), l
        x = l * b + r
        if x < n:
            return x


def write_shards(rows: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Sharded rows as Parquet under ``_sh_shard=k``, by slot within each file and over the files of a shard."""
    last, shards = rows.agg(F.coalesce(F.max("_sh_slot"), F.lit(0)), F.count_distinct("_sh_shard")).first()
    span = F.lit(last // files_per_shard + 1)
    cut = rows.withColumn("_sh_cut", F.call_function("div", F.col("_sh_slot"), span))
    cut = cut.repartitionByRange(max(1, shards * files_per_shard), "_sh_shard", "_sh_cut").sortWithinPartitions("_sh_shard", "_sh_slot")
    cut.drop("_sh_cut").write.partitionBy("_sh_shard").parquet(path)
