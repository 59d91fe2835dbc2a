"""Mixing sources to target weights by hash thresholds; DataFrame functions only.

Every document has a hash of its id. A source's budget becomes a threshold below which its
documents are taken, so a larger budget takes a superset (nested), reruns agree and nothing is
sorted: sizes are summed by (source, hash bucket), the bucket in which the running sum crosses
the budget is found, and only the documents of that bucket are summed again by finer buckets,
until a bucket is one hash value.

Rules for odd rows: a null text has size 0; a null source is a source of its own, last in order;
documents with equal (or null) ids share a hash and are taken together; an empty table gives no
rows. Input columns may have any names; helper columns start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count
from tidemark.session import cut_lineage

#: Bits of the hash that each histogram resolves; they add up to the hash's 60 bits.
LEVELS = (12, 14, 14, 20)
BITS = sum(LEVELS)


def id_hash(c: Column) -> Column:
    """60 bits of the md5 of the id's decimal digits, so that SQL elsewhere can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Targets of ``sizes(_mix_source, _mix_total)``, one row per source.

    ``share`` of all sizes is dealt out by weight; a source stops at ``most`` times its size and
    what it cannot take is dealt out again among the rest. Ordered by cap per weight, the sources
    that stop come first, so running sums over the sources give the answer at once.
    """
    order = Window.orderBy(F.col("_mix_source").asc_nulls_last())
    w = F.element_at(F.lit(weights), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_mix_w", w.cast("double")).withColumn("_mix_cap", most * F.col("_mix_total").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    by_cap = Window.orderBy(F.col("_mix_cap") / F.col("_mix_w"), F.col("_mix_source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (share * F.sum("_mix_total").over(everything) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))).alias("_mix_rest"),
        (F.sum("_mix_w").over(everything) - F.coalesce(F.sum("_mix_w").over(before), F.lit(0.0))).alias("_mix_open"))
    rows = rows.withColumn("_mix_stops", F.col("_mix_cap") * F.col("_mix_open") <= F.col("_mix_w") * F.col("_mix_rest"))
    # the first source that does not stop has the level of all that follow it
    level = F.min(F.when(~F.col("_mix_stops"), F.struct(
        (F.col("_mix_cap") / F.col("_mix_w")).alias("at"), (F.col("_mix_rest") / F.col("_mix_open")).alias("level")))).over(everything)["level"]
    return rows.withColumn("_mix_level", level).select(
        "_mix_source", "_mix_total",
        F.when(F.col("_mix_stops"), F.col("_mix_cap")).otherwise(F.col("_mix_w") * F.col("_mix_level")).alias("_mix_target"))


def _crossing(histogram: DataFrame, width: int) -> DataFrame:
    """Per source and pass the bucket in which the running sum crosses the budget.

    ``histogram`` has ``_mix_source, _mix_pass, _mix_budget, _mix_low, _mix_base, _mix_bucket,
    _mix_sum``: what lies below ``_mix_low`` sums to ``_mix_base``.
    """
    w = Window.partitionBy("_mix_source", "_mix_pass").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram.withColumn("_mix_upto", F.col("_mix_base") + F.sum("_mix_sum").over(w))
    h = h.where("_mix_upto > _mix_budget and _mix_upto - _mix_sum <= _mix_budget")
    return h.select(
        "_mix_source", "_mix_pass", "_mix_budget",
        (F.col("_mix_low") + F.shiftleft(F.col("_mix_bucket"), width)).alias("_mix_low"),
        (F.col("_mix_upto") - F.col("_mix_sum")).alias("_mix_base"), F.col("_mix_sum").alias("_mix_at"))


def thresholds(docs: DataFrame, targets: DataFrame, passes: int) -> DataFrame:
    """``(_mix_source, _mix_t1 .. _mix_t<passes>)``: in pass p a document is taken if its hash is below t<p>.

    Pass p takes what the target has beyond p - 1 times the source. The document at the crossing
    is taken if that brings the sum nearer to the budget. Buckets per source are bounded, so no
    window here grows with the documents.
    """
    left = BITS - LEVELS[0]
    first = docs.groupBy("_mix_source", F.shiftright("_mix_hash", left).alias("_mix_bucket")).agg(F.sum("_mix_size").alias("_mix_sum"))
    budgets = targets.select("_mix_source", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("_mix_pass"), "_mix_total", "_mix_target").select(
        F.col("_mix_source").alias("_mix_s"), "_mix_pass",
        F.greatest(F.lit(0.0), F.least(F.col("_mix_total").cast("double"), F.col("_mix_target") - (F.col("_mix_pass") - 1) * F.col("_mix_total"))).alias("_mix_budget"))
    found = first.join(budgets, F.col("_mix_source").eqNullSafe(F.col("_mix_s"))).drop("_mix_s").withColumns(
        {"_mix_low": F.lit(0).cast("long"), "_mix_base": F.lit(0).cast("long")})
    found = cut_lineage(_crossing(found, left))
    for bits in LEVELS[1:]:
        span, left = left, left - bits
        bounds = found.withColumnsRenamed({"_mix_source": "_mix_s"}).drop("_mix_at")
        inside = docs.join(bounds, F.col("_mix_source").eqNullSafe(F.col("_mix_s"))
                           & (F.shiftright("_mix_hash", span) == F.shiftright("_mix_low", span)))
        finer = inside.groupBy("_mix_source", "_mix_pass", "_mix_budget", "_mix_low", "_mix_base",
                               F.shiftright(F.col("_mix_hash") - F.col("_mix_low"), left).alias("_mix_bucket")).agg(F.sum("_mix_size").alias("_mix_sum"))
        found = cut_lineage(_crossing(finer, left))
    nearer = (F.col("_mix_base") + F.col("_mix_at") - F.col("_mix_budget")) < (F.col("_mix_budget") - F.col("_mix_base"))
    cuts = found.select("_mix_source", "_mix_pass", (F.col("_mix_low") + nearer.cast("long")).alias("_mix_cut"))
    # a budget of the whole source or more is crossed nowhere
    whole = F.lit(1 << BITS)
    cut = {p: F.coalesce(F.max(F.when(F.col("_mix_pass") == p, F.col("_mix_cut"))), whole) for p in range(1, passes + 1)}
    found = budgets.select(F.col("_mix_s"), F.col("_mix_pass").alias("_mix_p")).join(
        cuts, F.col("_mix_s").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_p") == F.col("_mix_pass")), "left")
    return found.groupBy("_mix_s").agg(*[c.alias(f"_mix_t{p}") for p, c in cut.items()])


def _hashed(documents: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return cut_lineage(documents.select(
        F.col(doc_id).alias("_mix_id"), F.col(source).alias("_mix_source"), id_hash(F.col(doc_id)).alias("_mix_hash"),
        word_count(F.col(text)).alias("_mix_size")))


def _per_source(docs: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """Size, target and thresholds of each source."""
    sizes = docs.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_total"))
    targets = cut_lineage(source_targets(sizes, weights, share, float(most)))
    cuts = cut_lineage(thresholds(docs, targets, most))
    return cut_lineage(cuts.join(targets, F.col("_mix_s").eqNullSafe(F.col("_mix_source"))).drop("_mix_source"))


def _copies(hash_: Column, most: int) -> Column:
    return sum((hash_ < F.col(f"_mix_t{p}")).cast("int") for p in range(1, most + 1))


def mix(documents: DataFrame, weights: list[int], share: float = 1.5, most: int = 2, doc_id: str = "doc_id",
        text: str = "text", source: str = "source") -> DataFrame:
    """Per document, in place of its text, how often the mix takes it.

    Adds ``size, source_size, target, copies, taken`` to ``doc_id``. ``copies`` is 0 .. ``most``.
    """
    docs = _hashed(documents, doc_id, text, source)
    # sources are few against documents; Spark broadcasts this side only if its size allows
    rows = docs.join(_per_source(docs, weights, share, most), F.col("_mix_source").eqNullSafe(F.col("_mix_s")), "left")
    rows = rows.withColumn("_mix_copies", _copies(F.col("_mix_hash"), most))
    return rows.select(
        F.col("_mix_id").alias("doc_id"), F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"),
        F.col("_mix_target").alias("target"), F.col("_mix_copies").alias("copies"), (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"))


def mixed(documents: DataFrame, weights: list[int], share: float = 1.5, most: int = 2, doc_id: str = "doc_id",
          text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    A row's own hash and its source's thresholds decide, so texts are not shuffled.
    """
    cuts = _per_source(_hashed(documents, doc_id, text, source), weights, share, most)
    rows = documents.join(cuts, F.col(source).eqNullSafe(F.col("_mix_s")))
    rows = rows.withColumn("_mix_copies", _copies(id_hash(F.col(doc_id)), most)).where("_mix_copies > 0")
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[documents[c] for c in documents.columns])


def take(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns.

    Rows that repeat an id, though of another source, are taken as often as the most taken of them.
    """
    copies = mixed.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.max("copies").alias("_mix_copies"))
    rows = documents.join(copies, F.col("doc_id").eqNullSafe(F.col("_mix_id"))).where("_mix_copies > 0")
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*documents.columns)
