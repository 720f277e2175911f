"""Takes a crawl in: which page stands for each URL, which captures are no use, and a ledger of all of them.

    spark-submit jobs/web_captures.py --input s3://crawl/pages --output s3://kb/web

input   Parquet with page_id, url and html
output  captures/status=s/kind=k: page_id, canonical, winner_id, slug, title, n_chars, n_links, size
        ledger/status=s: tab-separated title and URL of each canonical URL, as the trackers read it

Status: `no_url` (not an absolute URL), `dead` (what the page shows is short and says that it is gone), `thin` (it shows
fewer than least_chars characters), else `captured`, or `duplicate` if another useful capture of the same canonical URL is
to be kept: the longer original URL, then the larger file, then the smaller id. A URL of which no capture is of use is
`failed` in the ledger, a URL with one is `captured` under that page's title.

The whole output is worked out from the whole input and written over what was there, so a second run gives the same rows.

Defined cases: a null html is an empty one, so it is thin; a null url is none; rows that repeat are each judged, of equal
ids under one URL all are captured or all duplicates; an empty input gives an empty output; other columns are not read.
"""
from __future__ import annotations

import os
import sys

if __name__ == "__main__":  # run as a file: the repository's root is beside this folder
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from jobs import common  # noqa: E402
from tessera.functions import text as T, urls as U  # noqa: E402
from tessera.operators import evolve, quality  # noqa: E402
from tessera.sources.scratch import materialise  # noqa: E402

OPTIONS = {"input": "Parquet of crawled pages", "output": "folder of captures and ledger", "least_chars": "characters that a useful page shows"}
CAPTURES = "page_id {id}, canonical string, winner_id {id}, slug string, title string, n_chars long, n_links long, size long, status string, kind string"


def judged(pages: DataFrame, least_chars: int) -> DataFrame:
    """pages: page_id, url, html. The columns of captures but winner_id; useful pages are all `captured` yet."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    shown = pages.select("page_id", url.alias("url"), U.canonical_url(url).alias("canonical"), T.html_text(html).alias("shown"), T.html_title(html).alias("title"), F.regexp_count(html, F.lit("(?i)<a [^>]*href=")).cast("long").alias("n_links"), F.octet_length(html).cast("long").alias("size"))
    status = (
        F.when(~F.col("url").rlike("^[a-z]+://[^/?#]"), "no_url")
        .when(quality.has_dead_marker(F.col("shown")), "dead")
        .when(F.length("shown") < least_chars, "thin")
        .otherwise("captured")
    )
    kind, slug = U.source_kind(U.domain(F.col("url"))), U.slug(F.lit("webpages"), F.col("url"), F.col("title"))
    return shown.select("page_id", "url", F.when(status == "no_url", "").otherwise(F.col("canonical")).alias("canonical"), slug.alias("slug"), "title", F.length("shown").cast("long").alias("n_chars"), "n_links", "size", status.alias("status"), kind.alias("kind"))


def captures(pages: DataFrame, least_chars: int) -> DataFrame:
    """Pages with their status and, where one is kept for their URL, its id."""
    own = materialise(judged(pages, least_chars), "captures")  # html is read once
    kept = evolve.winners(own.where("status = 'captured'"), "canonical").select("canonical", "winner_id")
    beaten = (F.col("status") == "captured") & (F.col("page_id") != F.col("winner_id"))
    both = own.join(kept, "canonical", "left").withColumn("status", F.when(beaten, "duplicate").otherwise(F.col("status")))
    return both.select("page_id", "canonical", "winner_id", "slug", "title", "n_chars", "n_links", "size", "status", "kind")


def ledger(rows: DataFrame) -> DataFrame:
    """One row for each canonical URL: status, title, url."""
    plain = F.trim(F.regexp_replace("title", r"[\t\r\n]+", " "))
    best = F.min(F.struct((F.col("status") != "captured").alias("failed"), F.col("page_id"), plain.alias("title"))).alias("x")
    return rows.where("canonical != ''").groupBy("canonical").agg(best).select(F.when(F.col("x.failed"), "failed").otherwise("captured").alias("status"), "x.title", F.col("canonical").alias("url"))


def read(spark: SparkSession, output: str, id_type: str = "long") -> DataFrame:
    """The captures that a run has left."""
    return spark.read.schema(CAPTURES.format(id=id_type)).parquet(f"{output}/captures")


def run(spark: SparkSession, input: str, output: str, least_chars: int = 400) -> dict[str, int]:
    """Reads all pages and writes captures and ledger. Returns the number of captures by status."""
    pages = spark.read.parquet(input).select("page_id", "url", "html")
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = captures(pages, least_chars).hint("rebalance", "status", "kind")
    rows.write.mode("overwrite").partitionBy("status", "kind").parquet(f"{output}/captures")
    written = read(spark, output, id_type)
    ledger(written).hint("rebalance", "status").write.mode("overwrite").partitionBy("status").option("sep", "\t").csv(f"{output}/ledger")
    found = {r["status"]: r["count"] for r in written.groupBy("status").count().collect()}
    common.log.info("web_captures: read %d pages of %s; wrote to %s: %s", sum(found.values()), input, output, ", ".join(f"{n} {s}" for s, n in sorted(found.items())) or "nothing")
    return found


def main(argv: list[str] | None = None) -> None:
    s = common.settings("web_captures", __doc__.splitlines()[0], OPTIONS, argv)
    spark = common.session("web_captures")
    try:
        run(spark, s.input, s.output, int(s.least_chars))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
