"""What the corpus operators share: tables, scratch tables, batch sizes, joins by keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ship
from ..functions.ship import BATCH_BYTES, BATCH_ROWS
from ..sources.scratch import materialise
from ..sources.tables import table

#: Rows that may be broadcast as bare long keys (16 bytes each); beyond it a shuffle join is used.
BROADCAST_KEYS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, and sends this package to the executors, once for each context."""
    ship.small_batches(spark)
    ship.send(spark.sparkContext)


def key_join(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join against one column of long keys, broadcast only if their number is within BROADCAST_KEYS.

    keys must be cheap to count (a materialised table).
    """
    return df.join(small(keys), on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, whatever the case; underscores are added until that holds."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(df: DataFrame) -> list[Column]:
    """df's own columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are within BROADCAST_KEYS. df must be cheap to count and hold a few numbers a row."""
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def utf8(col) -> F.Column:
    return F.col(col).cast("binary") if isinstance(col, str) else col.cast("binary")


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_KEYS", "fresh", "key_join", "materialise", "quoted", "small", "small_batches", "table", "utf8"]
