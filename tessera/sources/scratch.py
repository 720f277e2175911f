"""Scratch tables in the folder that all executors share: they cut lineage, and executors may be lost."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own checkpoint folder. Only a local master may use a folder of this machine."""
    own = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
