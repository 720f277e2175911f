"""The queries of this subpackage: the thin forms that apply each operator to whole tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import codebooks, decontamination, langid, media, mixing, neardup, pii, quality, sharding, tokens, toxicity, urlfilter
from .common import small_batches, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; the model is fitted on labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_severity(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("r")).select("doc_id", "r.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and whether the document is contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.judge_documents(docs, table(spark, sf_dir, "benchmark"), "r").select("doc_id", "r.*")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; profiles are learned from the documents that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    profiles = langid.fit_profiles(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predict_language(profiles, F.col("text")).alias("r")).select("doc_id", "held_out", "r.*")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's WAV form, and its spectral fingerprint as a time-coded array."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", media.media_features(F.col("text")).alias("r")).select("doc_id", "r.*")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; shards have near-equal bytes and equal texts share one."""
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-duplicates of each document, on four-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page's URL."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens.token_count(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of each vector under codebooks learned from all of them."""
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document; the rules are learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.quality(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict:
    own = (
        op1_toxicity, op2_decontamination, op3_pii, op4_language_id, op5_media, op6_sharding, op7_minhash_neardup, op8_url_filter, op9_mixing, op10_token_counts,
        op11_vector_codes, op12_quality,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": codebooks.ORACLE_SQL, "op2_decontamination": decontamination.ORACLE_SQL, "op7_minhash_neardup": neardup.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL}
