"""The engine's tables out of the driver's tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ship, text as T, urls as U
from ..functions.text import term_counts  # noqa: F401 (tests take it from here)
from ..sources.scratch import materialise
from ..sources.tables import table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: title is the first 60 characters, summary the source, type the language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("page_id"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("summary"), F.col("lang").alias("source_type"), F.col("text").alias("body"))


def keywords(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The ten terms of four letters or more of each document with the highest term frequency * ln(documents / df)."""
    from ..operators import terms

    best = terms.best_terms(pages(spark, sf_dir), F.regexp_extract_all(F.lower("body"), F.lit("[a-z]{4,}"), 0), k)
    return materialise(best.select("*", (F.col("rank") <= 3).alias("is_top")), "keywords")


KEYWORDS_SQL = """
tf AS (SELECT page_id, keyword, count(*) AS tf FROM (SELECT doc_id AS page_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS keyword FROM documents) WHERE length(keyword) >= 4 GROUP BY ALL),
df AS (SELECT keyword, count(*) AS df FROM tf GROUP BY ALL),
kscored AS (SELECT page_id, keyword, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS score FROM tf JOIN df USING (keyword)),
kw AS (SELECT * FROM (SELECT page_id, keyword, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, keyword) AS rank FROM kscored) WHERE rank <= 10)"""


def neighbour_edges(spark: SparkSession, sf_dir: str, k: int = 3, every: int = 1) -> DataFrame:
    """Directed links from each page to its nearest by embedding; every: only from pages whose id it divides."""
    from ..operators import graph

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    queries = None if every == 1 else v.where(F.col("page_id") % every == 0).select("page_id")
    return materialise(graph.nearest_edges(v, queries, k).select("source_id", "target_id"), "neighbours")


def shared_keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import graph

    edges = graph.cooccurrence(keywords(spark, sf_dir), 2).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit(1.0).alias("weight"))
    return materialise(edges, "keyword-edges")  # walks read them several times


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.octet_length("html").cast("long").alias("size"), "html")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger: the type is the status, the user the key."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("status"), "ts", "event_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "line"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as journal entries."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), "text")


#: A vault made of documents: expressions that mean the same to Spark and DuckDB, in layers that build on each other.
VAULT = (
    {
        "page_id": "doc_id", "title": "'Page ' || doc_id", "folder": "CASE WHEN doc_id % 8 < 2 THEN 'papers' WHEN doc_id % 8 < 4 THEN 'repos' WHEN doc_id % 8 < 6 THEN 'webpages' ELSE 'videos' END",
        "source_type": "CASE doc_id % 7 WHEN 0 THEN 'topic' WHEN 1 THEN 'repo' WHEN 2 THEN 'webpage' WHEN 3 THEN 'paper' WHEN 4 THEN 'video' WHEN 5 THEN 'insight' ELSE 'gadget' END",
        "url": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://site' || (doc_id % 10) || '.org/a/' || (doc_id % 40) || CASE WHEN doc_id % 2 = 0 THEN '?utm_source=x' ELSE '' END END",
        "canonical": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'https://site' || (doc_id % 10) || '.org/a/' || (doc_id % 40) END",
        "slug": "CASE WHEN doc_id % 12 = 1 THEN 'gone' || doc_id ELSE 'r' || (doc_id - doc_id % 2) END", "summary": "'About ' || lang || ' from ' || source",
        "tag1": "CASE doc_id % 3 WHEN 0 THEN 'rag' ELSE 'odd-tag' END", "tag2": "CASE WHEN doc_id % 2 = 0 THEN 'paper' ELSE 'cooking' END",
        "rel1": "CASE WHEN doc_id % 10 = 3 THEN 'Nobody ' || doc_id ELSE 'Page ' || (doc_id * 7 % 25 * 10) END", "rel2": "CASE WHEN doc_id % 10 = 3 THEN 'Noone ' || doc_id ELSE 'Page ' || ((doc_id + 5) % 20 * 10 + 1) END",
        "link": "CASE WHEN doc_id % 10 = 3 THEN 'Lost ' || doc_id ELSE 'Page ' || (doc_id * 3 % 22 * 10 + 2) END",
        "date_added": "'2024-0' || (1 + doc_id % 9) || '-1' || (doc_id % 10)", "stars": "doc_id % 30", "volumes": "1000 + doc_id * 17 % 90", "prose": "replace(text, chr(10), ' ')",
    },
    {
        "rel_path": "'wiki/format/' || folder || '/p' || doc_id || '.md'",
        "raw_path": "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'raw/' || CASE WHEN doc_id % 13 = 0 THEN 'images' ELSE folder END || '/artifacts/' || slug || '.md' END",
        "body": "'# ' || title || chr(10) || chr(10) || 'See [[' || link || ']] and [[Nowhere ' || (doc_id % 5) || '|there]]. It has ' || stars || ' stars and ' || volumes || ' pages.' || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || prose || chr(10) || chr(10) || '### More' || chr(10) || chr(10) || 'Last words of ' || title || '.'",
    },
    {
        "content": """'---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'source_type: ' || source_type || chr(10) || 'url: ' || url || chr(10) || 'summary: ' || chr(39) || summary || chr(39) || chr(10)
        || 'quoted: "' || chr(39) || 'x' || doc_id || chr(39) || '"' || chr(10) || 'empty:' || chr(10) || 'tags: [' || tag1 || ', "' || tag2 || '"]' || chr(10) || 'related:' || chr(10) || '  - "[[' || rel1 || ']]"' || chr(10) || '- "[[' || rel2 || ']]"' || chr(10)
        || 'date_added: ' || date_added || chr(10) || 'raw_path: ' || raw_path || chr(10) || '---' || chr(10) || chr(10) || body""",
    },
)
#: Raw captures of a vault: one a document.
RAWS = (
    {
        "folder": "CASE WHEN doc_id % 8 < 2 THEN 'papers' WHEN doc_id % 8 < 4 THEN 'repos' WHEN doc_id % 8 < 6 THEN 'webpages' ELSE 'videos' END", "raw_title": "'Raw ' || doc_id",
        "source_url": "'https://site' || (doc_id % 10) || '.org/a/' || (doc_id % CASE WHEN doc_id % 11 = 0 THEN 41 ELSE 40 END)", "via": "CASE WHEN doc_id % 5 = 0 THEN 'browser-capture' ELSE 'api' END",
        "merged": "CASE WHEN doc_id % 17 = 0 THEN 'merged_into: p1' || chr(10) ELSE '' END", "raw_body": "'# Raw ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), ' ') || ' end'",
    },
    {
        "path": "'raw/' || folder || '/artifacts/r' || doc_id || '.md'",
        "content": "'---' || chr(10) || 'title: \"' || raw_title || '\"' || chr(10) || 'source: ' || source_url || chr(10) || 'clipped_via: ' || via || chr(10) || merged || 'captured_at: 2024-01-01' || chr(10) || '---' || chr(10) || chr(10) || raw_body",
    },
)


def _layers_sql(name: str, layers, of: str) -> str:
    out = [f"{name}0 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layers[0].items())} FROM {of})"]
    out += [f"{name}{k} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM {name}{k - 1})" for k, layer in enumerate(layers[1:], 1)]
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {name}{len(layers) - 1})"])


VAULT_SQL, RAWS_SQL = _layers_sql("v", VAULT, "documents"), _layers_sql("w", RAWS, "documents")


def _layered(df: DataFrame, layers) -> DataFrame:
    for layer in layers:
        df = df.selectExpr("*", *(f"{e} AS {c}" for c, e in layer.items()))
    return df


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that VAULT makes."""
    ship.small_batches(spark)
    return _layered(table(spark, sf_dir, "documents"), VAULT)


def vault_pages(spark: SparkSession, sf_dir: str, flavour: str = "index", columns: tuple[str, ...] = ()) -> DataFrame:
    """Pages parsed out of the vault's content; page_id is the document's id. columns: those that are worked out and kept, all if none is named."""
    from ..sources import vault as V

    own = vault(spark, sf_dir).select(F.col("rel_path").alias("path"), F.element_at(F.split("rel_path", "/"), -1).alias("name"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.octet_length("content").alias("size"), "content")
    parsed = V.pages_of(own, flavour=flavour).withColumn("page_id", F.regexp_extract("rel_path", r"/p(\d+)\.md$", 1).cast("long"))
    parsed = parsed.select("page_id", *columns) if columns else parsed
    return materialise(parsed, "vault-pages")  # parsed once, and plans over it stay small


def vault_raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import vault as V

    ship.small_batches(spark)
    own = _layered(table(spark, sf_dir, "documents"), RAWS)
    own = own.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.octet_length("content").alias("size"), "content")
    return materialise(V.raws_of(own), "vault-raws")


__all__ = ["table", "pages", "keywords", "neighbour_edges", "shared_keyword_edges", "vault", "vault_pages", "vault_raws", "web_pages", "statuses", "lines", "entries", "U"]
