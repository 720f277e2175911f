"""Counts and statistics over metadata: by field, by type, by status, for charts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls as U


def count_by_field(df: DataFrame, field: str, order: str | None = None) -> DataFrame:
    """value, n: rows of each value, of each element if the field is an array; most frequent first, ties by first seen (order) or value."""
    array = dict(df.dtypes)[field].startswith("array")
    own = df.select((F.explode(field) if array else F.col(field)).alias("value"), F.col(order).alias("_o") if order else F.lit(0).alias("_o")).where("value is not null and value != ''")
    return own.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("_first")).orderBy(F.desc("n"), "_first", "value").drop("_first")


def matching(df: DataFrame, predicate: Column) -> DataFrame:
    """Metadata rows by any column expression."""
    return df.where(predicate)


def corpus_stats(pages: DataFrame, raws: DataFrame, ledger: DataFrame, pending: DataFrame) -> DataFrame:
    """metric, n: raws by category, pages by type, totals, orphans, ledger rows by status, pending URLs."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    grouped = lambda prefix, df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(prefix), F.coalesce(F.col(key), F.lit("none"))).alias("metric"), "n")
    orphan = raws.join(pages.select(F.col("raw_path").alias("path")), "path", "left_anti")
    parts = [grouped("raw:", raws, "category"), grouped("page:", pages, "source_type"), one("raws", raws), one("pages", pages), one("orphans", orphan), grouped("ledger:", ledger, "status"), one("pending", pending)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("metric")


def numeric_columns(table: DataFrame, rows: str = "rows", sample: int = 3) -> DataFrame:
    """column: of tables as arrays of maps, columns whose first cells are all digits."""
    first = table.select(F.explode(F.slice(rows, 1, sample)).alias("r")).select(F.explode("r").alias("column", "cell"))
    digits = F.trim(F.regexp_replace("cell", ",", "")).rlike("^[0-9]+$")
    return first.groupBy("column").agg(F.min(digits).alias("all")).where("all").select("column").orderBy("column")


def distinct_links(links: DataFrame, group: str, order: str = "pos") -> DataFrame:
    """Links of each group once by canonical URL, the first form kept."""
    own = links.withColumn("canonical", U.canonical_url("url"))
    return own.groupBy(group, "canonical").agg(F.min_by("url", order).alias("url"), F.min(order).alias(order)).orderBy(group, order)


def followed_links(links: DataFrame, group: str, skipped: tuple[str, ...], most: int = 5) -> DataFrame:
    """The first links of each group that no pattern skips."""
    own = links.where(~F.col("url").rlike("(?i)" + "|".join(f"(?:{p})" for p in skipped)))
    return own.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy("pos", "url"))).where(F.col("_p") <= most).drop("_p")


def queued(found: DataFrame, queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """References (source_url, url) that are neither queued, resolved nor the source itself, each once."""
    keyed = found.withColumns({"_k": U.canonical_url("url"), "_s": U.canonical_url("source_url")}).where("_k != _s")
    for df in (queue, resolved):
        keyed = keyed.join(df.select(U.canonical_url("url").alias("_k")), "_k", "left_anti")
    return keyed.groupBy("_k").agg(F.min("url").alias("url"), F.min("source_url").alias("source_url")).drop("_k")


def page_of_url(urls: DataFrame, ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """url, page_id through the ledger: rows that are dead don't count, the page must be there."""
    alive = ledger.where(~F.col("status").isin("dead", "removed")).select(U.canonical_url("url").alias("_k"), F.col("title"))
    return urls.withColumn("_k", U.canonical_url("url")).join(alive, "_k").join(pages.select("title", "page_id"), "title").groupBy("url").agg(F.min("page_id").alias("page_id"))


def page_of_raw(raw_paths: DataFrame, pages: DataFrame) -> DataFrame:
    return raw_paths.join(pages.select("raw_path", "page_id", "rel_path"), "raw_path")


def refreshed(pages: DataFrame, raws: DataFrame) -> DataFrame:
    """Pages made again from their raws: title, summary, tags and related stay, the raw's source wins over the page's URL."""
    own = raws.select(F.col("path").alias("raw_path"), F.col("source").alias("_s"), F.col("body").alias("_b"))
    return pages.join(own, "raw_path", "left").withColumns({"url": F.coalesce("_s", "url"), "body": F.coalesce("_b", "body")}).drop("_s", "_b")


def touched(pages: DataFrame, captured: DataFrame) -> DataFrame:
    """last_updated moved on by later captures (url, ts) of a page's URL."""
    last = captured.groupBy(U.canonical_url("url").alias("_k")).agg(F.max(F.substring("ts", 1, 10)).alias("_t"))
    keyed = pages.withColumn("_k", U.canonical_url("url")).join(last, "_k", "left")
    return keyed.withColumn("last_updated", F.greatest("last_updated", "_t")).drop("_k", "_t")


def remote_assets(pages: DataFrame) -> DataFrame:
    """page_id, n of pages with images that lie elsewhere or inline."""
    return pages.select("page_id", F.regexp_count("body", F.lit(r"!\[[^\]]*\]\((?:https?://|data:image)")).alias("n")).where("n > 0")
