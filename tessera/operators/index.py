"""The search index as tables: full build, incremental build, deletion, embeddings by provider, status."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources import vault
from . import evolve, graph, retrieval

TABLES = ("pages", "chunks", "edges", "keywords", "vectors", "meta")
WORDS_EMBEDDED, DIMENSIONS = 500, 64


def embedding_text(title: Column, heading: Column, text: Column) -> Column:
    """Title, heading and the first words of a chunk."""
    return F.concat_ws("\n", title, heading, F.array_join(F.slice(F.split(text, r"\s+"), 1, WORDS_EMBEDDED), " "))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A deterministic vector without a model: counts of hashed tokens, signed, scaled to length 1."""
    tokens = T.unicode_tokens(text)
    slots = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int").alias("k"), F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(slots, lambda s: s["k"] == i), F.lit(0.0), lambda a, s: a + s["v"]))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(size == 0, 0.0).otherwise(x / size).cast("float"))


#: Providers by name, in the order they are tried: each makes a vector column of a text column, or is None if it is not there.
PROVIDERS: dict[str, Callable[[Column], Column] | None] = {"library": None, "service": None, "hashed": hashed_embedding}


def provider() -> tuple[str, Callable[[Column], Column]]:
    return next((k, f) for k, f in PROVIDERS.items() if f)


def vectors(chunks: DataFrame, pages: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """chunk_id, page_id, embedding of the chunks that have none."""
    left = chunks if have is None else chunks.join(have.select("chunk_id"), "chunk_id", "left_anti")
    texts = left.join(pages.select("page_id", "title"), "page_id").withColumn("_t", embedding_text(F.col("title"), F.col("heading"), F.col("chunk_text")))
    return texts.select("chunk_id", "page_id", provider()[1](F.col("_t")).alias("embedding"))


def keywords(pages: DataFrame) -> DataFrame:
    """By similarity if there is a model among the providers, else by frequency: hashed vectors say nothing of meaning."""
    name, embed = provider()
    return retrieval.keywords_by_frequency(pages) if name == "hashed" else retrieval.keywords_by_similarity(pages, embed)


def tables(pages: DataFrame) -> dict[str, DataFrame]:
    """All index tables of pages, lazily."""
    chunks = vault.vault_chunks(pages)
    out = {"pages": pages.drop("values", "lists"), "chunks": chunks, "edges": graph.link_edges(pages), "keywords": keywords(pages), "vectors": vectors(chunks, pages)}
    out["meta"] = pages.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("page_count").alias("key"), "value")
    return out


def build(spark: SparkSession, root: str, out: str, vault_id: str = "local") -> dict[str, DataFrame]:
    """Writes every table anew and reads them."""
    for name, df in tables(vault.pages(spark, root, vault_id)).items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return read(spark, out)


def read(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out}/{name}") for name in TABLES}


def update(spark: SparkSession, root: str, old: str, out: str, vault_id: str = "local", parity: bool = False) -> dict[str, DataFrame]:
    """Writes a new index from an old one: rows of pages that are the same are kept, only changed pages are worked on.

    parity=True leaves pages that are gone in the index and makes no keywords for changed pages, as some tools do.
    """
    before, now = read(spark, old), vault.pages(spark, root, vault_id)
    changes = evolve.index_changes(before["pages"], now)
    keep = changes.where(F.col("change").isin("same", *(["removed"] if parity else []))).select("page_id")
    work = changes.where(F.col("change").isin("added", "changed")).select("page_id")
    changed = now.join(work, "page_id", "left_semi")
    fresh = {**tables(changed), "edges": graph.link_edges(now)}
    for name in ("pages", "chunks", "keywords", "vectors"):
        kept = before[name].join(keep, "page_id", "left_semi")
        new = fresh[name].limit(0) if parity and name == "keywords" else fresh[name]
        kept.unionByName(new, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/{name}")
    fresh["edges"].write.mode("overwrite").parquet(f"{out}/edges")
    spark.read.parquet(f"{out}/pages").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("page_count").alias("key"), "value").write.mode("overwrite").parquet(f"{out}/meta")
    return read(spark, out)


def without(index: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the pages of gone (page_id), edges at either end included."""
    out = {name: df.join(gone, "page_id", "left_anti") if "page_id" in df.columns else df for name, df in index.items()}
    for side in ("source_id", "target_id"):
        out["edges"] = out["edges"].join(gone.select(F.col("page_id").alias(side)), side, "left_anti")
    return out


def missing(index: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Chunks without vectors, and pages without keywords."""
    return index["chunks"].join(index["vectors"].select("chunk_id"), "chunk_id", "left_anti"), index["pages"].join(index["keywords"].select("page_id").distinct(), "page_id", "left_anti")


def search(index: dict[str, DataFrame], query: str, k: int = 10, vault_id: str | None = None) -> DataFrame:
    """Hybrid search over the tables, of one vault if given."""
    pages = index["pages"] if vault_id is None else index["pages"].where(F.col("vault_id") == vault_id)
    spark = pages.sparkSession
    q = list(spark.range(1).select(provider()[1](F.lit(query)).alias("q")).first()["q"])
    found = retrieval.hybrid(pages, query, index["vectors"].join(pages.select("page_id"), "page_id", "left_semi"), q, index["edges"], index["keywords"], k)
    return found.join(pages.select("page_id", "rel_path", F.substring("summary", 1, 120).alias("summary")), "page_id").orderBy(F.desc("score"), "page_id")


def results_page(found: DataFrame, query: str) -> DataFrame:
    """One row with the results as markdown."""
    line = F.concat(F.lit("- [["), "title", F.lit("]] ("), F.round("score", 4).cast("string"), F.lit(", "), "signals", F.lit(")"))
    return found.agg(F.concat(F.lit(f"# Results for {query}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "page_id", line.alias("t")))), lambda x: x["t"]), "\n")).alias("page"))
