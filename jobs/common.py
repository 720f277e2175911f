"""What the jobs share: settings out of a file and the command line, a session, a log."""
from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tessera.jobs")


def settings(name: str, about: str, options: dict[str, str], argv: list[str] | None = None) -> argparse.Namespace:
    """The command line over the config file beside the job (or the one given); an option of the command line wins."""
    parser = argparse.ArgumentParser(prog=name, description=about)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON with any of the other options")
    for key, told in options.items():
        parser.add_argument(f"--{key.replace('_', '-')}", dest=key, help=told)
    found = parser.parse_args(argv)
    held = json.loads(Path(found.config).read_text())
    if unknown := set(held) - set(options):
        parser.error(f"{found.config}: no such option: {', '.join(sorted(unknown))}")
    for key in options:
        if getattr(found, key) is None:
            setattr(found, key, held.get(key))
    return found


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def laid_out(spark: SparkSession, path: str, schema: str, *partitions: str) -> None:
    """Makes an empty table where there is none, so that it can be read; rows that are there stay."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces the partitions that df has rows in, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
