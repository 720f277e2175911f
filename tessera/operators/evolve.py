"""Changes to a corpus as new versions: merging, renaming, membership, ledgers, snapshots. Nothing is updated in place."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import urls as U

#: Source types, best first: a merged page keeps the best one's type and summary.
TYPE_RANK = ("paper", "repo", "video", "webpage", "image", "insight", "topic", "entity")


def merge_pages(pages: DataFrame, key: str) -> DataFrame:
    """One page for each key: tags, urls and raw paths in first-seen order (by place), the earliest date, the best type and its summary.

    pages: key, place, tags, urls, raw_paths (arrays), date_added, source_type, summary.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TYPE_RANK)), F.col("source_type")), F.lit(99))
    rank = F.when(rank == 0, 99).otherwise(rank)

    def union(name: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("v"))))
        return F.array_distinct(F.filter(F.flatten(F.transform(parts, lambda x: F.coalesce(x["v"], F.array().cast("array<string>")))), lambda x: F.trim(x) != ""))

    best = F.min(F.struct(rank.alias("r"), "place", "source_type", "summary"))
    return pages.groupBy(key).agg(union("tags").alias("tags"), union("urls").alias("urls"), union("raw_paths").alias("raw_paths"), F.min(F.coalesce(F.nullif("date_added", F.lit("")), F.lit("9999"))).alias("date_added"), best["source_type"].alias("source_type"), best["summary"].alias("summary"), F.count(F.lit(1)).alias("merged"))


def winners(pages: DataFrame, key: str) -> DataFrame:
    """The key of pages, winner_id and n (how many share it): the longer original URL wins, then the larger file, then the earlier page.

    A sum by key, so a key that many pages share is brought together before anything moves.
    """
    first = F.min(F.struct((-F.length("url")).alias("l"), (-F.col("size")).alias("s"), "page_id"))
    return pages.groupBy(key).agg(first.alias("_f"), F.count(F.lit(1)).alias("n")).select(key, F.col("_f.page_id").alias("winner_id"), "n")


def url_winners(pages: DataFrame) -> DataFrame:
    """page_id, canonical, winner_id of pages that share a canonical URL."""
    own = pages.select("page_id", "url", "size", U.canonical_url("url").alias("canonical")).where("canonical != ''")
    shared = winners(own, "canonical").where("n > 1")
    return own.join(shared, "canonical").select("page_id", "canonical", "winner_id", (F.col("page_id") == F.col("winner_id")).alias("wins"))


def renamed(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """pages with links in body and related rewritten: renames has old and new.

    Only pages that hold a link are joined; links are found once, looked up, and put back by one fold a page.
    """
    link = r"\[\[([^\]|#]+)"
    own = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(link), 1))).alias("old"))
    per_page = own.join(renames, "old").groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("old", "new"))).alias("_renames"))

    def put(text: Column, r: Column) -> Column:
        once = F.replace(text, F.concat(F.lit("[["), r["old"], F.lit("]]")), F.concat(F.lit("[["), r["new"], F.lit("]]")))
        twice = F.replace(once, F.concat(F.lit("[["), r["old"], F.lit("|")), F.concat(F.lit("[["), r["new"], F.lit("|")))
        return F.replace(twice, F.concat(F.lit("[["), r["old"], F.lit("#")), F.concat(F.lit("[["), r["new"], F.lit("#")))

    joined = pages.join(per_page, "page_id", "left")
    return joined.withColumn("body", F.when(F.col("_renames").isNotNull(), F.aggregate("_renames", F.col("body"), put)).otherwise(F.col("body"))).drop("_renames")


def redirect_stubs(renames: DataFrame) -> DataFrame:
    """A stub for each old name that can be clicked."""
    return renames.where(~F.col("old").rlike(r"[\[\]#^|]")).select(F.col("old").alias("title"), F.lit(True).alias("redirect"), F.col("new").alias("redirect_to"))


def attach(memberships: DataFrame, new: DataFrame) -> DataFrame:
    return memberships.unionByName(new).distinct()


def detach(memberships: DataFrame, gone: DataFrame) -> DataFrame:
    return memberships.join(gone, ["hub", "member"], "left_anti")


def move(memberships: DataFrame, members: DataFrame, hub: str) -> DataFrame:
    """members leave all hubs for one."""
    return memberships.join(members, "member", "left_anti").unionByName(members.select(F.lit(hub).alias("hub"), "member")).distinct()


def ungroup(memberships: DataFrame, hub: str) -> DataFrame:
    return memberships.where(F.col("hub") != hub)


def removed(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """pages without those of gone (page_id), and without links to them in related; the order of the others stays."""
    left = pages.join(gone.select("page_id"), "page_id", "left_anti")
    if "related" not in pages.columns:
        return left
    names = pages.join(gone.select("page_id"), "page_id", "left_semi").select(F.col("title").alias("name")).distinct()
    links = left.select("page_id", F.posexplode("related").alias("place", "link")).withColumn("name", F.regexp_replace("link", r"^\[\[|\]\]$", ""))
    kept = links.join(names, "name", "left_anti").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "link"))), lambda x: x["link"]).alias("_kept"))
    related = F.when(F.col("related").isNotNull(), F.coalesce("_kept", F.array().cast("array<string>")))
    return left.join(kept, "page_id", "left").withColumn("related", related).drop("_kept")


def ledger_upsert(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The latest row (by ts, rows over ledger) of each canonical URL."""
    both = ledger.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True).withColumn("_key", U.canonical_url("url", U.LEDGER_TRACKING))
    w = Window.partitionBy("_key").orderBy(F.desc("_new"), F.col("ts").desc_nulls_last(), "status")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new", "_key")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as reconciliation keeps it."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def resurrected(dead: DataFrame, captured: DataFrame) -> DataFrame:
    """Dead records whose URL, in canonical form, was captured."""
    keyed = lambda df: df.withColumn("_key", U.canonical_url("url", U.LEDGER_TRACKING))
    return keyed(dead).join(keyed(captured).select("_key").distinct(), "_key", "left_semi").drop("_key")


def still_dead(dead: DataFrame, captured: DataFrame) -> DataFrame:
    keyed = lambda df: df.withColumn("_key", U.canonical_url("url", U.LEDGER_TRACKING))
    return keyed(dead).join(keyed(captured).select("_key").distinct(), "_key", "left_anti").drop("_key")


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, change: added, changed (by content_hash), removed or same."""
    o, n = old.select("page_id", F.col("content_hash").alias("o")), new.select("page_id", F.col("content_hash").alias("n"))
    return o.join(n, "page_id", "full_outer").select("page_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("same").alias("change"))


def incremental(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows of derived tables that need no work: of pages that are the same."""
    same = index_changes(old, new).where("change = 'same'").select("page_id")
    return old.join(same, key, "left_semi")


def registry_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """path, status: new, resolved or remaining."""
    b, n = before.select("path", F.lit(1).alias("b")), now.select("path", F.lit(1).alias("n"))
    return b.join(n, "path", "full_outer").select("path", F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "resolved").otherwise("remaining").alias("status"))


class Versions:
    """A dataset kept as numbered versions under one path, with a manifest of each: snapshot, restore, list, purge.

    Files are reached through Spark's own file system layer, so the path may be any store.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> list[dict]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        return sorted((json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/_versions").collect()), key=lambda m: m["version"])

    def write(self, df: DataFrame, operation: str, at: str) -> int:
        version = max((m["version"] for m in self._manifests()), default=-1) + 1
        df.write.parquet(f"{self.path}/v={version}")
        manifest = json.dumps({"version": version, "operation": operation, "timestamp": at, "status": "complete"})
        self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_versions")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        kept = [m["version"] for m in self._manifests()]
        return self.spark.read.parquet(f"{self.path}/v={kept[-1] if version is None else version}")

    def restore(self, at: str) -> int:
        """The version before the last one, written as a new version."""
        return self.write(self.read(self._manifests()[-2]["version"]), "restore", at)

    def listed(self) -> DataFrame:
        return self.spark.createDataFrame([(m["version"], m["operation"], m["timestamp"]) for m in self._manifests()], "version int, operation string, timestamp string")

    def purge(self, before: str) -> list[int]:
        """Deletes the data of versions older than a time; the last stays."""
        gone = [m["version"] for m in self._manifests()[:-1] if m["timestamp"] < before]
        for v in gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return gone
