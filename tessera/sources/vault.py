"""Readers of markdown vaults, ledgers, journals and rule files. Every reader is lazy; filters on paths prune files."""
from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import frontmatter as FM, text as T, urls as U

LIST_SKIPPED = ("dashboards", "exports", "sessions", "journal", "topics", "insights", "entities")
CLAIM_SKIPPED = ("dashboards", "exports", "sessions", "journal")
CATEGORIES = ("webpages", "papers", "repos", "videos", "images")
HEAD = 4000
FILE_CLASSES = {
    "text": ("md", "txt", "rst", "csv", "log"), "code": ("py", "js", "ts", "java", "go", "rs", "c", "cpp", "sh", "sql"),
    "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "gif", "webp"), "office": ("docx", "pptx", "xlsx"),
}


def files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (under root), name, stem, modified, size and content of each file; folders are read recursively."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    full = F.col("_metadata.file_path")
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.url_decode(F.replace(full, F.lit("+"), F.lit("%2B"))), rf"^.*?\Q{base}\E/", "")
    return raw.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "").alias("stem"),
                      F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))


def in_folder(name: str) -> Column:
    return F.concat(F.lit("/"), F.col("path")).contains(f"/{name}/")


def wiki_files(spark: SparkSession, root: str, skipped: tuple[str, ...] = ("dashboards",)) -> DataFrame:
    """Markdown files outside skipped folders whose names do not start with an underscore."""
    own = files(spark, root)
    for s in skipped:
        own = own.where(~in_folder(s))
    return own.where(~F.col("name").startswith("_") & F.col("name").endswith(".md"))


def pages(spark: SparkSession, root: str, vault: str = "local", flavour: str = "index") -> DataFrame:
    """The search index' pages: ids, front matter columns, body and plain text."""
    return pages_of(wiki_files(spark, root), vault, flavour)


def pages_of(own: DataFrame, vault: str = "local", flavour: str = "index") -> DataFrame:
    """As pages, of files (path, name, stem, modified, size, content) from anywhere."""
    own = own.withColumn("fm", FM.front_matter(F.col("content"), flavour))
    value = lambda k, d="": F.coalesce(F.element_at("fm.values", F.lit(k)), F.lit(d))
    listed = lambda k: F.coalesce(F.element_at("fm.lists", F.lit(k)), F.when(value(k) != "", F.array(value(k))).otherwise(F.array().cast("array<string>")))
    return own.select(
        T.page_id(F.lit(vault), F.col("path")).alias("page_id"), F.lit(vault).alias("vault_id"), F.col("path").alias("rel_path"),
        F.coalesce(F.nullif(value("title"), F.lit("")), F.col("stem")).alias("title"), value("summary").alias("summary"), value("source_type").alias("source_type"),
        listed("tags").alias("tags"), listed("related").alias("related"), value("url").alias("url"), value("date_added").alias("date_added"), value("last_updated").alias("last_updated"),
        value("raw_path").alias("raw_path"), F.col("fm.body").alias("body"), T.strip_markdown(F.col("fm.body")).alias("plain"), T.content_hash(F.col("content")).alias("content_hash"),
        F.col("fm.values").alias("values"), F.col("fm.lists").alias("lists"), "modified", "size", "name", "stem", "content",
    )


def claim_pages(spark: SparkSession, root: str) -> DataFrame:
    """Titled pages outside generated folders, one-line values of front matter only."""
    own = wiki_files(spark, root, CLAIM_SKIPPED).withColumn("fm", FM.front_matter(F.col("content")))
    value = lambda k: F.coalesce(F.element_at("fm.values", F.lit(k)), F.lit(""))
    return own.select(F.col("path").alias("page_id"), value("title").alias("title"), value("source_type").alias("source_type"), value("url").alias("url"), F.col("fm.body").alias("body")).where("title != ''")


def append_entry(spark: SparkSession, path: str, date: str, time: str, text: str) -> None:
    """Appends a journal entry to a table of entries."""
    spark.createDataFrame([(date, time, text)], "date string, time string, text string").write.mode("append").partitionBy("date").parquet(path)


def listing(spark: SparkSession, root: str, source_type: str | None = None, recent: int | None = None) -> DataFrame:
    """title, source_type, date_added and path from one-line keys in the first HEAD characters."""
    head = F.substring("content", 1, HEAD)
    key = lambda k: F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1), r"""^["']|["']$""", "")
    own = wiki_files(spark, root, LIST_SKIPPED).select(F.coalesce(F.nullif(key("title"), F.lit("")), F.col("stem")).alias("title"), key("source_type").alias("source_type"), key("date_added").alias("date_added"), "path")
    if source_type:
        own = own.where(F.col("source_type") == source_type)
    if recent:
        return own.orderBy(F.nullif("date_added", F.lit("")).desc_nulls_last(), "path").limit(recent)
    return own.orderBy(F.lower("title"), "path")


def raw_files(spark: SparkSession, root: str, flavour: str = "schema") -> DataFrame:
    """Raw captures of the known categories: category, slug, front matter (or legacy header) and body."""
    return raws_of(files(spark, root), flavour)


def raws_of(own: DataFrame, flavour: str = "schema") -> DataFrame:
    """As raw_files, of files from anywhere."""
    own = own.where(F.col("path").rlike(rf"(?:^|/)raw/(?:{'|'.join(CATEGORIES)})/artifacts/[^/]+\.md$"))
    own = own.withColumns({"fm": FM.front_matter(F.col("content"), flavour), "legacy": FM.legacy_header(F.col("content"))})
    values = F.when(F.col("fm.found"), F.col("fm.values")).otherwise(F.col("legacy"))
    return own.select("path", F.regexp_extract("path", r"raw/([^/]+)/", 1).alias("category"), F.col("stem").alias("slug"), values.alias("values"), F.col("fm.lists").alias("lists"),
                      FM.source_url(values).alias("source"), F.col("fm.body").alias("body"), "content", "size", "modified", F.col("fm.found").alias("has_front_matter"))


def names_and_raws(pages_: DataFrame, raws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name to path (of equal names the last path), and raw path to source URL."""
    return pages_.groupBy("stem").agg(F.max("rel_path").alias("path")), raws.select(F.col("path").alias("raw_path"), "source")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """URL ledgers of either shape: status, title, url, resolved_url, type, ts.

    Four columns: status, title, url, time. Five: status, title, source URL, resolved URL, type. They are told apart by
    whether the fourth looks like a date.
    """
    own = spark.read.option("sep", "\t").option("quote", "").schema("c0 string, c1 string, c2 string, c3 string, c4 string").csv(path)
    dated = F.col("c3").rlike(r"^\d{4}-\d\d-\d\d")
    return own.select(F.col("c0").alias("status"), F.col("c1").alias("title"), F.col("c2").alias("url"), F.when(~dated, F.col("c3")).alias("resolved_url"), F.when(~dated, F.col("c4")).alias("type"), F.when(dated, F.col("c3")).alias("ts"))


def pending_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("http")).select(F.trim("value").alias("url"))


def tsv(spark: SparkSession, path: str, columns: str, header: bool = False) -> DataFrame:
    """Dead-URL lists, embed maps and retry lists."""
    return spark.read.option("sep", "\t").option("quote", "").option("header", header).schema(columns).csv(path)


def journal_entries(days: DataFrame) -> DataFrame:
    """days: files. date, time, text and path of each entry under a heading of hours and minutes, newest first."""
    parts = F.filter(F.split("content", r"(?m)^(?=### \d{2}:\d{2}\n\n)"), lambda x: x.rlike(r"^### \d{2}:\d{2}\n\n"))
    own = days.select("path", F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1).alias("date"), F.explode(parts).alias("p"))
    text = F.regexp_replace(F.regexp_replace(F.substr("p", F.lit(12)), r"^\s+|\s+$", ""), r"[-\s]+$", "")
    return own.select("date", F.substring("p", 5, 5).alias("time"), text.alias("text"), "path").where("text != ''").orderBy(F.desc("date"), F.desc("time"), "path")


def journal(spark: SparkSession, root: str, since: str, until: str = "9999-12-31", project: str | None = None) -> DataFrame:
    """Entries of a date range; of one project's folder if given."""
    own = files(spark, f"{root}/wiki/journal/{project}" if project else f"{root}/wiki/journal")
    if not project:
        own = own.where(~F.col("path").contains("/"))
    return journal_entries(own.where(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1).between(since, until)))


def session_logs(spark: SparkSession, root: str, since: str) -> DataFrame:
    """filename, sections (heading to text; of equal headings the last), newest first."""
    own = files(spark, f"{root}/wiki/sessions").where(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1) >= since)
    body = F.regexp_replace("content", r"(?s)^---\n.*?\n---\n", "")
    parts = F.filter(F.split(body, r"(?m)^(?=## )"), lambda x: x.startswith("## "))
    entry = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^## (.+)", 1)).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^## .*", ""), r"^\s+|\s+$", "").alias("v")))
    last = F.aggregate(entry, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))
    return own.select(F.col("stem").alias("filename"), last.alias("sections"), "path").orderBy(F.desc("filename"))


def recently_changed(own: DataFrame, since) -> DataFrame:
    """Files modified at or after a time."""
    return own.where(F.col("modified") >= F.lit(since).cast("timestamp")).orderBy(F.desc("modified"), "path")


def projects(spark: SparkSession, root: str) -> DataFrame:
    own = files(spark, f"{root}/projects").where(F.col("path").rlike(r"^[^/]+/index\.md$"))
    return own.select(F.substring_index("path", "/", 1).alias("project"), F.regexp_extract("content", r"(?m)^title:\s*\"?([^\"\n]*)", 1).alias("title"), F.regexp_extract("content", r"(?m)^status:\s*\"?([^\"\n]*)", 1).alias("status")).orderBy("project")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """section, position and rule of a rules file, comments removed."""
    own = spark.read.text(path, wholetext=True)
    clean = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    sections = F.filter(F.split(clean, r"(?m)^(?=## )"), lambda x: x.startswith("## "))
    one = own.select(F.explode(sections).alias("s")).select(F.trim(F.regexp_extract("s", r"^## (.+)", 1)).alias("section"), F.posexplode(F.regexp_extract_all("s", F.lit(r"(?m)^[-*]\s+(.+)$"), 1)).alias("position", "rule"))
    return one.orderBy("section", "position")


def file_class(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("other")
    for name, endings in FILE_CLASSES.items():
        out = F.when(ext.isin(*endings), name).otherwise(out)
    return out


def looks_binary(content: Column) -> Column:
    """A PDF's mark, or more than 200 control characters in a text of more than 1,000."""
    control = F.regexp_count(content, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]"))
    return content.startswith("%PDF-") | ((F.length(content) > 1000) & (control > 200))


def inside(root: str, path: str) -> bool:
    """Whether a relative path stays under root, dots resolved."""
    depth = 0
    for part in PurePosixPath(path).parts:
        depth += -1 if part == ".." else 0 if part == "." else 1
        if depth < 0 or part.startswith("/"):
            return False
    return bool(root)


def config(default: dict, overlay: str | dict | None) -> dict:
    """Defaults under an overlay (JSON text or dict): dicts are merged, lists and values replaced."""
    over = json.loads(overlay) if isinstance(overlay, str) else overlay or {}

    def merged(a, b):
        return {k: merged(a[k], b[k]) if k in a and k in b and isinstance(a[k], dict) and isinstance(b[k], dict) else b.get(k, a.get(k)) for k in {**a, **b}}

    return merged(default, over)


def vault_chunks(pages_: DataFrame) -> DataFrame:
    """chunk_id, page_id, chunk_index, heading, chunk_text and token_count of each section."""
    own = pages_.select("page_id", F.posexplode(T.chunks(F.col("body"))).alias("chunk_index", "c"))
    return own.select(T.chunk_id(F.col("page_id"), F.col("chunk_index")).alias("chunk_id"), "page_id", "chunk_index", F.col("c.heading").alias("heading"), F.col("c.text").alias("chunk_text"), T.token_estimate(F.col("c.text")).alias("token_count"))


def canonical_ledger(own: DataFrame) -> DataFrame:
    return own.withColumn("canonical", U.canonical_url(F.coalesce("url", F.lit("")), U.LEDGER_TRACKING))
