"""Keeps a search index over a growing folder of documents; each run takes only the files that are new.

    spark-submit jobs/search_index.py --input s3://corpus/documents --output s3://kb/index --checkpoint s3://kb/index-mark
    spark-submit jobs/search_index.py --output s3://kb/index --find "late interaction retrieval"

input      folder of Parquet files with an id and a text column (see search_index.json), or a pattern of such paths;
           a single file is given by a pattern too (documents.parque[t]), as file streams take no bare file
output     pages/segment=n: page_id, title, content_hash, len
           postings/bucket=b/segment=n: page_id, term, tf
checkpoint of the file stream: which files have been taken

A batch of new files is a segment, numbered by the stream. A page is indexed if its text differs from the one that the
index has; its newest segment counts, older rows of it are passed over. A segment is written by overwriting its own
partitions and is worked out from earlier segments alone, so a batch that is run again after a failure gives the same
rows. A run without new files writes nothing.

Defined cases: rows without an id are left out; a null text is an empty one; of rows with one id in a batch that of the
file changed last counts, then of the last path, then of the largest hash; pages without terms have no postings; a file
that is rewritten under its old name isn't taken again; columns that aren't named in the settings are not read.
"""
from __future__ import annotations

import os
import sys

if __name__ == "__main__":  # run as a file: the repository's root is beside this folder
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from jobs import common  # noqa: E402
from tessera.functions import text as T  # noqa: E402
from tessera.operators import lexical_index  # noqa: E402

OPTIONS = {
    "input": "folder or path pattern of Parquet files", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint", "id": "column of ids", "id_type": "type of ids in the index", "text": "column of texts",
    "buckets": "partitions of terms", "files_per_batch": "new files in a batch at most", "find": "search the index instead, and print the best pages",
}
PAGES = "page_id {id}, title string, content_hash string, len long, segment long"
POSTINGS = "page_id {id}, term string, tf double, bucket int, segment long"
TITLE = 60


def _table(spark: SparkSession, output: str, name: str, id_type: str) -> DataFrame:
    """The rows of all segments; by its schema, as there may be none yet."""
    return spark.read.schema({"pages": PAGES, "postings": POSTINGS}[name].format(id=id_type)).parquet(f"{output}/{name}")


def pages(spark: SparkSession, output: str, id_type: str = "long") -> DataFrame:
    """Pages of the index as it stands: of each its newest segment."""
    own = _table(spark, output, "pages", id_type)
    return own.join(own.groupBy("page_id").agg(F.max("segment").alias("segment")), ["page_id", "segment"]).select("page_id", "title", "content_hash", "len", "segment")


def postings(spark: SparkSession, output: str, id_type: str = "long") -> DataFrame:
    """Postings of the index as it stands."""
    own = _table(spark, output, "postings", id_type)
    return own.join(pages(spark, output, id_type).select("page_id", "segment"), ["page_id", "segment"]).select("page_id", "term", "tf", "bucket")


def find(spark: SparkSession, output: str, query: str, buckets: int = 16, id_type: str = "long", k: int = 20) -> DataFrame:
    """The best pages for a query. Its terms are known before the plan is made, so only their partitions are read."""
    words = list(dict.fromkeys(t for t in (w.lower() for w in T.query_terms(query)) if t))
    asked = spark.createDataFrame([(query,)], "text string").select(F.lit(0).alias("query_id"), "text")
    slots = [r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(lexical_index.bucket_of(F.col("w"), buckets).alias("b")).collect()] if words else []
    held = postings(spark, output, id_type).where(F.col("bucket").isin(slots) & F.col("term").isin(words))
    own = pages(spark, output, id_type)
    ranked = lexical_index.search(asked, held, own, k)
    return ranked.join(own.select("page_id", "title"), "page_id").select("rank", "page_id", "title", "score").orderBy("rank")


def index_batch(batch: DataFrame, segment: int, output: str, buckets: int, id_type: str) -> int:
    """batch: page_id, body, and when and where its file was written. Returns the number of its rows.

    What is new or changed is found by hashes; texts move only where they are to be indexed, and postings are counted
    where their page lies.
    """
    spark = batch.sparkSession
    own = batch.where("page_id is not null").withColumn("content_hash", T.content_hash(F.col("body")))
    length = lexical_index.token_count({"body": 1.0}, {"body": "string"})
    keys = own.select("page_id", F.struct("changed", "file", "content_hash", F.substring("body", 1, TITLE).alias("title"), length.alias("len")).alias("x"))
    newest = keys.groupBy("page_id").agg(F.max("x").alias("x")).select("page_id", "x.title", "x.content_hash", "x.len")
    before = _table(spark, output, "pages", id_type).where(F.col("segment") < segment)
    known = before.groupBy("page_id").agg(F.max_by("content_hash", "segment").alias("known"))
    work = newest.join(known, "page_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("known"))).drop("known")
    common.overwrite_partitions(work.withColumn("segment", F.lit(segment).cast("long")), f"{output}/pages", "segment")
    indexed = _table(spark, output, "pages", id_type).where(F.col("segment") == segment)
    texts = own.join(indexed.select("page_id", F.col("content_hash").alias("indexed")), "page_id").where("content_hash = indexed").dropDuplicates(["page_id"])
    terms = lexical_index.postings(texts, {"body": 1.0}, once=True).withColumns({"bucket": lexical_index.bucket_of(F.col("term"), buckets), "segment": F.lit(segment).cast("long")})
    # one file or a few for each bucket, whatever its size; terms in order, so that a scan can leave out what it isn't asked for
    common.overwrite_partitions(terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "segment", "term", "page_id"), f"{output}/postings", "bucket", "segment")
    read, written, terms_written = batch.count(), indexed.count(), _table(spark, output, "postings", id_type).where(F.col("segment") == segment).count()
    common.log.info("search_index: segment %d: read %d rows, wrote %d new or changed pages and %d postings to %s", segment, read, written, terms_written, output)
    return read


def run(spark: SparkSession, input: str, output: str, checkpoint: str, id: str = "doc_id", id_type: str = "long", text: str = "text", buckets: int = 16, files_per_batch: int = 64) -> int:
    """Takes the files of input that no run before has taken. Returns the number of rows read."""
    schema = spark.read.parquet(input).select(id, text).schema
    common.laid_out(spark, f"{output}/pages", PAGES.format(id=id_type), "segment")
    common.laid_out(spark, f"{output}/postings", POSTINGS.format(id=id_type), "bucket", "segment")
    # files of any age are taken: one that is copied in late must not be passed over
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(input)
    rows = source.select(F.col(id).cast(id_type).alias("page_id"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    read: list[int] = []
    stream = rows.writeStream.foreachBatch(lambda batch, n: read.append(index_batch(batch, n, output, buckets, id_type))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    common.log.info("search_index: read %d new rows of %s in %d batches", sum(read), input, len(read))
    return sum(read)


def main(argv: list[str] | None = None) -> None:
    s = common.settings("search_index", __doc__.splitlines()[0], OPTIONS, argv)
    spark = common.session("search_index")
    try:
        if s.find:
            for r in find(spark, s.output, s.find, int(s.buckets), s.id_type).collect():
                print(f"{r['rank']:>3}  {r['score']:.4f}  {r['page_id']}  {r['title']}")
        else:
            run(spark, s.input, s.output, s.checkpoint, s.id, s.id_type, s.text, int(s.buckets), int(s.files_per_batch))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
