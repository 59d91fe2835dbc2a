"""A training corpus from raw documents: five stages, each working on all that the one before kept.

Toxic documents go, repeated lines go, one document of each group of near copies stays, sources are
mixed to target weights (a document may then come twice), and texts become token ids.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lines, mixing, shingles, toxicity
from tidemark.llm.common import table
from tidemark.llm.queries import encoded_documents
from tidemark.session import drop_steps, keep_steps, new_path, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0, by a model fitted on the labelled documents."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of larger id has too, if five or more have them."""
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs, weights=[3, 1, 2])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of the text decoded from them."""
    return encoded_documents(docs)


def _alone(stage):
    """The stage before has been written when this one begins, so what it left on the way goes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_steps(spark)
        keep_steps(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources", mix_sources), ("BPE encoding", encode)]
STAGES = [(name, _alone(stage)) for name, stage in STAGES]

#: SQL cannot fit the classifier of the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), new_path(spark, "stage"))
    return docs
