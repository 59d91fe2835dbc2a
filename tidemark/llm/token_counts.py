"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is turned into signed ledger rows: what a document counted so far is taken back,
what it counts now is added. Their sums by (source, language, version) are the batch's delta, and
totals are sums of deltas, so nothing is counted again when documents come, go, move or are
re-tokenised. A batch takes effect when its commit is written, after its ledger and its delta; a
batch that is committed is skipped when it comes again, one that broke off is written anew.

Changes have ``op`` (insert, revise or delete), ``seq``, ``doc_id``, ``source``, ``lang``,
``version`` and ``tokens``. Of several changes of one document and version in a batch the last
``seq`` counts. Rules for odd rows: an insert of a known document revises it, a revision of an
unknown one inserts it, a delete of an unknown one does nothing; null sources and languages are
groups of their own; null ids are one document; null token counts are 0; empty batches commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

GROUP = ["source", "lang", "version"]
LEDGER = "batch string, doc_id long, version string, source string, lang string, docs long, tokens long"
DELTA = "batch string, source string, lang string, version string, docs long, tokens long"


class Rollup:
    """Totals in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("ledger", LEDGER), ("delta", DELTA), ("commit", "batch string")):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/first")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def committed(self) -> DataFrame:
        return self._read("commit", "batch string").distinct()

    def ledger(self) -> DataFrame:
        """What each document counts now; batches that are not committed don't exist."""
        rows = self._read("ledger", LEDGER).join(self.committed(), "batch", "left_semi")
        return rows.groupBy("doc_id", "version", "source", "lang").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        last = F.struct(F.col("seq"), F.col("op"), F.col("source"), F.col("lang"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        new = cut_lineage(changes.groupBy("doc_id", "version").agg(F.max(last).alias("last")).select("doc_id", "version", "last.*"))
        added = new.where("op <> 'delete'").select("doc_id", "version", "source", "lang", F.lit(1).cast("long").alias("docs"), "tokens")
        touched = new.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"))
        old = self.ledger().join(touched, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("version").eqNullSafe(F.col("_v")), "left_semi")
        taken = old.select("doc_id", "version", "source", "lang", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        signed = added.unionByName(taken).select(F.lit(batch).alias("batch"), "doc_id", "version", "source", "lang", "docs", "tokens")
        folder = f"batch={batch}"
        signed.write.mode("overwrite").parquet(f"{self.path}/ledger/{folder}")
        signed = self.spark.read.schema(LEDGER).option("basePath", f"{self.path}/ledger/{folder}").parquet(f"{self.path}/ledger/{folder}")
        delta = signed.groupBy("batch", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/delta/{folder}")
        self.spark.createDataFrame([(batch,)], "batch string").write.mode("overwrite").parquet(f"{self.path}/commit/{folder}")
        return True

    def totals(self) -> DataFrame:
        rows = self._read("delta", DELTA).join(self.committed(), "batch", "left_semi")
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")
