"""A stored lexical index: postings and page lengths as tables, and ranked search of many queries at once over them.

postings: page_id, term, tf (counts weighted by field). lengths: page_id, len (tokens of all fields together). Both are
plain tables: where they are kept, and partitioned, is up to the writer; bucket_of names the partition of a term, so that
a search reads the partitions of its terms only. Scores equal retrieval.bm25, which reads the texts.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.scratch import materialise
from . import retrieval

#: Query terms that may be sent to every task.
BROADCAST_TERMS = 1_000_000


def _tokens(text: Column, letters: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{letters}]+"), 0)


def postings(pages: DataFrame, fields: dict[str, float], letters: str = T.ASCII, once: bool = False) -> DataFrame:
    """pages: page_id and the fields (strings or arrays of strings). One row for each page and term; pages without terms have none.

    once: no page_id has two rows. Terms of a single field are then counted inside the row: nothing is shuffled, and a task holds one page at a time.
    """
    kinds = dict(pages.dtypes)

    def weighted(field: str, weight: float) -> Column:
        text = F.array_join(field, " ") if kinds[field].startswith("array") else F.col(field)
        return F.transform(_tokens(text, letters), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    if once and len(fields) == 1:
        (field, weight), = fields.items()
        text = F.array_join(field, " ") if kinds[field].startswith("array") else F.col(field)
        counted = pages.select("page_id", F.explode(T.term_counts(_tokens(text, letters))).alias("x"))
        return counted.select("page_id", F.col("x.keyword").alias("term"), (F.col("x.tf") * float(weight)).alias("tf"))
    return pages.select("page_id", F.explode(F.concat(*(weighted(f, w) for f, w in fields.items()))).alias("x")).groupBy("page_id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("tf"))


def token_count(fields: dict[str, float], kinds: dict[str, str], letters: str = T.ASCII) -> Column:
    """Tokens of all fields together."""
    return sum((T.token_number(F.lower(F.coalesce(F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f), F.lit(""))), letters) for f in fields), F.lit(0)).cast("long")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_words(text: Column, letters: str = T.ASCII) -> Column:
    """Different terms of a query, without stop words unless nothing else is left."""
    all_words = F.array_distinct(_tokens(text, letters))
    rare = F.array_except(all_words, T.literals(T.STOP_WORDS))
    return F.when(F.size(rare) > 0, rare).otherwise(all_words)


def bm25_many(terms: DataFrame, postings: DataFrame, lengths: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """terms: query_id, term (each once). query_id, page_id, matched (number of terms found) and score.

    Only postings of the asked terms go on: each is scored once, whatever number of queries asks for it, and meets the
    queries after that.
    """
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    hits = materialise(postings.join(asked, "term", "left_semi").select("page_id", "term", "tf"), "index-hits")
    found = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(found, "term").join(lengths.select("page_id", "len"), "page_id").crossJoin(retrieval.single_row(stats))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    met = scored.select("page_id", "term", part.alias("part")).join(terms.select("query_id", "term"), "term")
    return met.groupBy("query_id", "page_id").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.sum("part").alias("score"))


def best(scored: DataFrame, k: int = retrieval.SIGNAL_ROWS) -> DataFrame:
    """The k best pages of each query with their rank from 1; tasks cut their own rows to k before any shuffle. Equal scores (to 9 places) go by page."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "page_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int = retrieval.SIGNAL_ROWS, letters: str = T.ASCII) -> DataFrame:
    """queries: query_id, text. The k best pages of each by any of its terms."""
    terms = queries.select("query_id", F.explode(query_words(F.col("text"), letters)).alias("term"))
    return best(bm25_many(terms, postings, lengths), k)
