"""The jobs as registered queries: each runs twice into a new folder of the shared scratch space; its output is read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs import search_index, web_captures
from tessera.plans.queries import _CANON, query
from tessera.sources import scratch


@query("SELECT doc_id AS page_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY ALL")
def job1_search_index(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the index after two runs; the second finds nothing new."""
    out = scratch.folder(spark, "job1")
    for _ in range(2):
        # a pattern, as the table may be one file
        search_index.run(spark, f"{sf}/documents.parque[t]", f"{out}/index", f"{out}/mark")
    return search_index.postings(spark, f"{out}/index").select("page_id", "term", "tf")


_SHOWN = "coalesce(html, '')"
for _pattern in ("(?is)<head[ >].*?</head>", "(?is)<script[ >].*?</script>", "(?is)<style[ >].*?</style>", "(?s)<!--.*?-->", "<[^>]*>", "[ \\t\\r\\n]+", " +"):
    _SHOWN = f"regexp_replace({_SHOWN}, '{_pattern}', ' ', 'g')"


@query(f"""WITH own AS (SELECT page_id, url, {_CANON} AS canonical, trim({_SHOWN}) AS shown, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a [^>]*href=')) AS n_links, strlen(html) AS size FROM pages),
judged AS (SELECT *, length(shown) AS n_chars, CASE WHEN NOT regexp_matches(url, '^[a-z]+://[^/?#]') THEN 'no_url'
 WHEN length(shown) < 300 AND (contains(lower(shown), 'page not found') OR contains(lower(shown), 'uh oh, we can''t seem to find') OR contains(lower(shown), '404') OR contains(lower(shown), 'this page isn''t available')) THEN 'dead'
 WHEN length(shown) < 400 THEN 'thin' ELSE 'captured' END AS status FROM own),
kept AS (SELECT canonical, first(page_id ORDER BY length(url) DESC, size DESC, page_id) AS winner_id FROM judged WHERE status = 'captured' GROUP BY canonical)
SELECT page_id, canonical, coalesce(winner_id, -1) AS winner_id, title, n_chars, n_links, size, CASE WHEN status = 'captured' AND page_id <> winner_id THEN 'duplicate' ELSE status END AS status FROM judged LEFT JOIN kept USING (canonical)""")
def job2_web_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures after two runs over the same pages."""
    out = scratch.folder(spark, "job2")
    for _ in range(2):
        web_captures.run(spark, f"{sf}/pages.parquet", out)
    return web_captures.read(spark, out).select("page_id", "canonical", F.coalesce("winner_id", F.lit(-1)).cast("long").alias("winner_id"), "title", "n_chars", "n_links", "size", "status")


