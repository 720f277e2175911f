"""Mixing sources to target weights with hash-threshold histograms; built-in functions only.

Sizes are words. All sources share the whole of all sizes by weight; a source stops at CAP times its own size and what
it leaves is shared among the others by weight until none is above. A source of size S and target T takes each of its
documents T div S times, and once more those whose hash lies below the source's threshold.

Thresholds come from histograms: sizes are summed by source and the first DIGITS of the hash, the bucket in which the
running sum passes the rest of the target is found, and only that bucket is divided by the next digits, LEVELS times.
Nothing is sorted or ranked by document. Documents that share all digits go together, and go in if this brings the
source nearer to its target. The hash is of the document's id and its size, so reruns agree.

Defined cases: a null or empty text has size 0 and is never taken; null sources are one source, the last; with no
words at all every target is 0; equal ids share their hash; repeated rows are separate documents with equal fates;
sources of equal size to weight are taken in the order of their names; texts of any length are counted whole; an empty
table gives an empty result; other columns pass through mixed_documents as they are, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh, materialise, quoted, small

WEIGHTS, CAP = (5, 2, 1), 3
#: Sources up to which one task orders them (about 100 bytes each); more are ordered by ranges.
SOURCES_AT_ONCE = 100_000
#: Hexadecimal digits of each level, and levels.
DIGITS, LEVELS = 3, 4


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, size, one row a document. Returns a row a source: source, source_size, target.

    Sources reach their caps in the order of size to weight, so the water level has a closed form over that order.
    """
    own = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ways = _at_once if own.limit(SOURCES_AT_ONCE + 1).count() <= SOURCES_AT_ONCE else _by_ranges
    place, before = ways(own, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(before, F.lit(len(weights))) + 1).cast("int"))
    own = place.select("source", "source_size", weight.alias("weight"))
    every = own.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    place, _ = ways(own, order, {"size_before": "source_size", "weight_before": "weight"})
    own = place.crossJoin(F.broadcast(every))  # one row
    # the level if all sources before this one stop at their caps; the first source that stays below its cap sets it
    own = own.withColumn("level", (F.col("all_size") - F.col("size_before") * cap) / (F.col("all_weight") - F.col("weight_before")))
    own = materialise(own, "mix-levels")
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    water = own.agg(F.coalesce(F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "level")))["level"], F.lit(0.0)).alias("water"))
    return own.crossJoin(F.broadcast(water)).select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.col("water") * F.col("weight")).alias("target"))


def _at_once(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, Column]:
    """rows with the sums (name: column) over the rows before each, and how many rows those are; in one task."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = {k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in sums.items()}
    return rows.withColumns(named | {"before": F.row_number().over(Window.orderBy(*order)) - 1}), F.col("before")


def _by_ranges(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> tuple[DataFrame, Column]:
    """As _at_once, by ranges of the order: sums inside each range, and those of the ranges before, a row a range."""
    rows = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    inner = Window.partitionBy("part").orderBy(*order)
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    totals = totals.select(F.col("part"), *(F.coalesce(F.sum(k).over(ranges), F.lit(0)).alias(f"{k}_0") for k in ("n", *sums)))
    rows = rows.withColumns({k: F.coalesce(F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k, c in sums.items()} | {"n": F.row_number().over(inner) - 1})
    rows = rows.join(F.broadcast(totals), "part")  # as many rows as shuffle partitions
    return rows.withColumns({k: F.col(k) + F.col(f"{k}_0") for k in sums} | {"before": F.col("n") + F.col("n_0")}).drop("part", "n", *(f"{k}_0" for k in ("n", *sums))), F.col("before")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(sized: DataFrame, targets: DataFrame, digits: int = DIGITS, levels: int = LEVELS) -> DataFrame:
    """A row a source: source, source_size, target, copies, threshold (documents with a smaller hash go once more).

    sized: source, size, hash (hexadecimal, of digits * levels characters).
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    bounds = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(""))
    bounds = bounds.select(F.col("source").alias("b_source"), "source_size", "target", "copies", "rest", "prefix")
    for level in range(levels):
        at, n = level * digits, digits * (level + 1)
        inside = sized.where(F.col("size") > 0) if not level else (
            sized.where(F.col("size") > 0).join(bounds.select("b_source", F.col("prefix").alias("b_prefix")), _same("source", "b_source") & (F.substring("hash", 1, at) == F.col("b_prefix"))).drop("b_source", "b_prefix"))
        histogram = inside.groupBy("source", F.substring("hash", 1, n).alias("bucket")).agg(F.sum("size").alias("held"))
        running = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("held").over(running))
        found = histogram.join(bounds.select("b_source", "rest"), _same("source", "b_source")).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("held")).alias("below"), "held"))).alias("edge"))
        found = found.select(F.col("source").alias("f_source"), "edge")
        bounds = bounds.join(found, F.col("b_source").eqNullSafe(F.col("f_source")), "left").select(
            "b_source", "source_size", "target", "copies",
            (F.col("rest") - F.coalesce(F.col("edge.below"), F.lit(0))).alias("rest"),
            # no bucket passes the rest: nothing is left to divide ('~' is above all digits)
            F.coalesce(F.col("edge.bucket"), F.when(F.col("prefix") == "", F.lit("~" if not level else "")).otherwise(F.concat("prefix", F.lit("~")))).alias("prefix"),
            F.coalesce(F.col("edge.held"), F.lit(0)).alias("held"),
        )
        bounds = materialise(bounds, "mix-bounds")
    nearer = F.col("held") - F.col("rest") < F.col("rest")
    return bounds.select(F.col("b_source").alias("source"), "source_size", "target", "copies", F.when(nearer, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("threshold"))


def _hash(doc_id: Column, size: Column, digits: int = DIGITS * LEVELS) -> Column:
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))
    return F.substring(F.md5(key.cast("binary")), 1, digits)


def hashed(docs: DataFrame, *keep: str, digits: int = DIGITS, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, size and hash of each document, and the columns to keep."""
    sized = docs.select("doc_id", "source", *keep, words(F.col("text")).alias("size"))
    return sized.withColumn("hash", _hash(F.col("doc_id"), F.col("size"), digits * levels))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document."""
    sized = materialise(hashed(docs), "mix-sizes")
    bounds = thresholds(sized, source_targets(sized, weights, cap))
    bounds = bounds.withColumnRenamed("source", "b_source")
    taken = F.col("size") * (F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long"))
    return sized.join(small(bounds), _same("source", "b_source")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with each document as many times as the mix takes it."""
    own = quoted(docs)
    of, again, below, key, size, times = fresh(docs, "of", "again", "below", "key", "size", "times")
    sized = materialise(hashed(docs).drop("doc_id"), "mix-sizes")
    bounds = thresholds(sized, source_targets(sized, weights, cap)).select(F.col("source").alias(of), F.col("copies").alias(again), F.col("threshold").alias(below))
    wide = docs.withColumn(size, words(F.col("text"))).withColumn(key, _hash(F.col("doc_id"), F.col(size)))
    wide = wide.join(small(bounds), F.col("source").eqNullSafe(F.col(of)))
    taken = F.when(F.col(size) > 0, F.col(again) + (F.col(key) < F.col(below)).cast("long")).otherwise(F.lit(0)).cast("int")
    return wide.withColumn(times, F.explode(F.array_repeat(F.lit(1), taken))).select(*own)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)), 1, 12) AS h
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)),
own AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM own),
levels AS (
  SELECT *, (sum(s) OVER () - 3 * coalesce(sum(s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT coalesce(arg_min(level, s / w), 0) AS water FROM levels WHERE level * w <= 3 * s),
targets AS (SELECT source, CAST(s AS BIGINT) AS source_size, least(3 * s, water * w) AS target, CASE WHEN s > 0 THEN CAST(floor(least(3 * s, water * w) / s) AS BIGINT) ELSE 0 END AS copies FROM levels, water),
ranked AS (
  SELECT z.*, t.source_size, t.target, t.copies, t.target - t.copies * t.source_size AS rest,
    sum(z.size) OVER (PARTITION BY z.source ORDER BY z.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(z.size) OVER (PARTITION BY z.source, z.h) AS held
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN upto <= rest THEN 1 WHEN upto - held <= rest AND upto - rest < rest - (upto - held) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
