"""Structured Streaming: watching folders, upserting ledgers, windows, sessions, deduplication, late rows."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import urls as U
from ..operators import evolve


def watched_files(spark: SparkSession, folder: str, pattern: str = "*.md", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, each path once by the query's checkpoint: path, modified, content."""
    own = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return own.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))


def parquet_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Rows of a parquet folder (or one file's folder and name) as a stream."""
    head, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.option("pathGlobFilter", name).parquet(head) if name.endswith(".parquet") else reader.parquet(path)


def run_once(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """All rows there are now, batch by batch, then stop."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row of each URL under path/v=N; a batch that is run again writes the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else evolve.ledger_upsert(spark.read.parquet(f"{path}/v={number - 1}"), batch)
        (evolve.ledger_upsert(rows.limit(0), rows) if number == 0 else rows).write.mode("overwrite").parquet(f"{path}/v={number}")

    return apply


def quarantine_into(good: str, bad: str, reason: str = "reason") -> Callable[[DataFrame, int], None]:
    """A batch function that parts accepted from refused rows."""

    def apply(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{good}/batch={number}")
        kept.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        kept.unpersist()

    return apply


def new_urls(stream: DataFrame, known: DataFrame, horizon: str = "30 days", ts: str = "ts") -> DataFrame:
    """URLs not in a known table and not seen within the horizon."""
    own = stream.withColumn("canonical", U.canonical_url("url", U.LEDGER_TRACKING)).withWatermark(ts, horizon)
    return own.join(known.select(U.canonical_url("url", U.LEDGER_TRACKING).alias("canonical")).distinct(), "canonical", "left_anti").dropDuplicatesWithinWatermark(["canonical"])


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need times with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fresh(files: DataFrame, within: str, now) -> DataFrame:
    """Files modified within an interval of a time."""
    return files.where(F.col("modified") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {within}"))


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total after each batch: state kept by key, with Arrow batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def latest_session(logs: DataFrame) -> DataFrame:
    """The newest session log's summary and open threads."""
    return logs.orderBy(F.desc("filename")).limit(1).select("filename", F.element_at("sections", F.lit("Summary")).alias("summary"), F.element_at("sections", F.lit("Open Threads")).alias("open_threads"))
