"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, mixture, shards.

Every stage takes the session, the documents that its predecessor kept and the folder of tables,
and gives documents with all their columns; the last gives every document's place in the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekloom.llm import decontamination, jaccard, mixing, quality, sharding, shipped
from weekloom.llm.queries import mix_weights, source_domain, table
from weekloom.session import settled


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled ones among them, takes for good."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.accepted(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, similarity 0.8 or more."""
    shipped(spark)
    return jaccard.one_of_each(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch in which their source's budget takes them."""
    return mixing.mixed_documents(docs, mixing.mixture(docs, mix_weights(), domain=source_domain()))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.hilbert_shards(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixture", mixed_to_weights),
    ("shards", sharded),
]

#: The classifier and what follows from it have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each stage's documents are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
