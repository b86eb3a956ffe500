"""A corpus run from raw documents to shards: quality, near-duplicates, benchmark passages, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, decontam, mixing, neardup, quality, sharding

SHARDS = 8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest doc_id stays."""
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's passage go."""
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard and slot that they go to."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, signatures and minimax cuts have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each writes Parquet to the shared folder and the next rereads it."""
    before, docs = None, common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = common.stash(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs = kept
    return docs
