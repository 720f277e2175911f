"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's documents to the shared folder
and reads them again for the next. All stages but the last return the columns of documents.

Defined cases, for all stages: rows are judged each, so a row never goes because another has its id; null ids are ids
like any other; other columns pass through as they are, whatever their names (sharding replaces one named shard); empty
tables give empty results; texts of any length are read whole. What a null or empty text, a tie or a repeated row means is
said at each stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, mixing, neardup, sharding, toxicity
from tessera.llm.common import materialise, small_batches, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression grades 1 or more go. Null and empty texts stay; repeated rows go or stay alike."""
    small_batches(spark)
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays (five-word shingles, similarity 0.8).

    Of rows with one id and copies of one text the one with the smallest hash stays, of equal rows one; texts without words all stay.
    """
    small_batches(spark)
    return neardup.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover by a twentieth or more go; texts without words stay."""
    small_batches(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; texts without words are not taken, equal rows alike."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard; shards have near-equal bytes and equal texts share one, so do null texts."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Trained weights, MinHash and differencing are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
