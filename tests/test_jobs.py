"""The jobs over growing and odd input, again after a failure, and from the command line; each against its SQL."""
import json
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries as bound, search_index, web_captures
from tessera.operators import lexical_index, retrieval
from tessera.plans.queries import ORACLES

from .conftest import DATA, ROOT
from .test_queries import normal

DOCS = "doc_id long, text string, extra string"


def add(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def held(spark, out):
    """Terms of each page, and what each page's row says."""
    terms = {}
    for r in search_index.postings(spark, out).collect():
        assert (r["page_id"], r["term"]) not in terms and r["bucket"] == spark.range(1).select(lexical_index.bucket_of(F.lit(r["term"]), 16).alias("b")).first()["b"]
        terms[r["page_id"], r["term"]] = r["tf"]
    return terms, {r["page_id"]: (r["segment"], r["len"], r["title"]) for r in search_index.pages(spark, out).collect()}


def of(rows):
    return {(i, t): float(n) for i, text in rows.items() for t, n in Counter(text.lower().split()).items()}


@pytest.fixture
def places(tmp_path):
    return f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"


def test_index_of_growing_input(spark, places):
    docs, out, mark = places
    add(spark, docs, [(1, "red red fox", "a"), (2, "blue fox", None), (None, "lost", "b"), (3, None, None)])
    assert search_index.run(spark, docs, out, mark) == 4
    terms, pages = held(spark, out)
    assert terms == of({1: "red red fox", 2: "blue fox"}) and pages == {1: (0, 3, "red red fox"), 2: (0, 2, "blue fox"), 3: (0, 0, "")}
    # only new files: one page is new, one changed, one came again as it was, one repeats within the file
    add(spark, docs, [(4, "fox den", None), (2, "green hen", None), (1, "red red fox", None), (4, "fox den", None)])
    assert search_index.run(spark, docs, out, mark) == 4
    now = held(spark, out)
    assert now[0] == of({1: "red red fox", 2: "green hen", 4: "fox den"})
    assert now[1] == {1: (0, 3, "red red fox"), 2: (1, 2, "green hen"), 3: (0, 0, ""), 4: (1, 2, "fox den")}
    # nothing new: nothing read, nothing written
    files = spark.read.parquet(f"{out}/postings").inputFiles()
    assert search_index.run(spark, docs, out, mark) == 0
    assert held(spark, out) == now and sorted(spark.read.parquet(f"{out}/postings").inputFiles()) == sorted(files)
    # a page that goes back to an older text is indexed again
    add(spark, docs, [(2, "blue fox", None)])
    assert search_index.run(spark, docs, out, mark) == 1
    assert held(spark, out)[0] == of({1: "red red fox", 2: "blue fox", 4: "fox den"})


def test_index_again_after_a_failure(spark, places, monkeypatch):
    """The batch that broke off after its pages were written is run again as the same segment."""
    docs, out, mark = places
    add(spark, docs, [(1, "one fox", None)])
    search_index.run(spark, docs, out, mark)
    add(spark, docs, [(1, "two hens", None), (2, "a fox", None)])
    write, calls = search_index.common.overwrite_partitions, []

    def broken(df, path, *partitions):
        calls.append(path)
        if path.endswith("/postings"):
            raise RuntimeError("executor lost")
        write(df, path, *partitions)

    monkeypatch.setattr(search_index.common, "overwrite_partitions", broken)
    with pytest.raises(Exception, match="executor lost"):
        search_index.run(spark, docs, out, mark)
    monkeypatch.undo()
    assert search_index.run(spark, docs, out, mark) == 2 and len(calls) == 2
    terms, pages = held(spark, out)
    assert terms == of({1: "two hens", 2: "a fox"}) and {i: p[0] for i, p in pages.items()} == {1: 1, 2: 1}


def test_several_batches_are_one_by_one(spark, places):
    docs, out, mark = places
    for i in range(5):
        add(spark, docs, [(i, f"w{chr(97 + i)} fox", None), (9, f"text {chr(97 + i)}", None)])
    assert search_index.run(spark, docs, out, mark, files_per_batch=2) == 10
    _, pages = held(spark, out)
    assert len({p[0] for p in pages.values()}) == 3 and set(pages) == {0, 1, 2, 3, 4, 9}


def test_empty_input_gives_an_empty_index(spark, places):
    docs, out, mark = places
    add(spark, docs, [])
    assert search_index.run(spark, docs, out, mark) == 0 and held(spark, out) == ({}, {})
    assert search_index.find(spark, out, "fox").count() == 0


def test_find_is_bm25_over_texts(spark, places):
    docs, out, mark = places
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    table.write.parquet(docs)
    search_index.run(spark, docs, out, mark)
    own = table.select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"))
    for query in ("reation pathetic anthing", "the", "nothing-of-this xyzzyq"):
        got = [(r["page_id"], round(r["score"], 6)) for r in search_index.find(spark, out, query).collect()]
        want = [(r["page_id"], round(r["score"], 6)) for r in retrieval.top(retrieval.bm25(own, retrieval.T.query_terms(query), {"body": 1.0}).withColumn("score", F.round("score", 9)), 20).collect()]
        assert got == want
    one = search_index.postings(spark, out).where("bucket = 3 and term = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in one and "EqualTo(term,x)" in one


PAGES = "page_id long, url string, html string, status string"
SHOWN = "words " * 100


def page(body, title="T"):
    return f"<html><head><title>{title}</title><style>x{{}}</style></head><body><script>var a='<p>'</script><!-- note -->{body}</body></html>"


def test_captures(spark, tmp_path):
    rows = [
        (1, "http://a.org/x", page(SHOWN, " First\tone ")), (2, "http://www.a.org/x?utm_source=y", page(SHOWN + "more")), (3, "http://a.org/x/", page(SHOWN)),
        (4, "http://b.org/", page("Page not found")), (5, "http://b.org/y", page("<a href='z'>short</a> <A class='k' HREF='q'>one</A>")), (6, None, page(SHOWN)), (7, "nonsense", page(SHOWN)),
        (8, "http://c.org/", None), (9, "http://d.org/long", page("404")), (10, "http://d.org/long", page(SHOWN)), (10, "http://d.org/long", page(SHOWN)),
    ]
    spark.createDataFrame([(*r, "clash") for r in rows], PAGES).write.parquet(f"{tmp_path}/pages")
    for _ in range(2):  # the second run leaves the same
        found = web_captures.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out")
        got = sorted((r["page_id"], r["status"], r["canonical"], r["winner_id"]) for r in web_captures.read(spark, f"{tmp_path}/out").collect())
        assert got == [
            (1, "duplicate", "http://a.org/x", 2), (2, "captured", "http://a.org/x", 2), (3, "duplicate", "http://a.org/x", 2), (4, "dead", "http://b.org/", None), (5, "thin", "http://b.org/y", None), (6, "no_url", "", None),
            (7, "no_url", "", None), (8, "thin", "http://c.org/", None), (9, "dead", "http://d.org/long", 10), (10, "captured", "http://d.org/long", 10), (10, "captured", "http://d.org/long", 10)]
        assert found == {"captured": 3, "duplicate": 2, "dead": 2, "thin": 2, "no_url": 2}
        lines = spark.read.csv(f"{tmp_path}/out/ledger", sep="\t", schema="title string, url string, status string").collect()
        assert sorted((r["status"], r["title"] or "", r["url"]) for r in lines) == [("captured", "T", "http://a.org/x"), ("captured", "T", "http://d.org/long"), ("failed", "", "http://c.org/"), ("failed", "T", "http://b.org/"), ("failed", "T", "http://b.org/y")]
    own = {r["page_id"]: r for r in web_captures.read(spark, f"{tmp_path}/out").collect()}
    assert own[1]["title"] == "First\tone" and own[5]["n_links"] == 2 and own[1]["n_chars"] == len(SHOWN.strip()) and own[8]["size"] == 0
    # fewer pages: what was there before goes
    spark.createDataFrame([(*r, "clash") for r in rows[:1]], PAGES).write.parquet(f"{tmp_path}/fewer")
    assert web_captures.run(spark, f"{tmp_path}/fewer", f"{tmp_path}/out") == {"captured": 1} and spark.read.parquet(f"{tmp_path}/out/captures").count() == 1
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/none")
    assert web_captures.run(spark, f"{tmp_path}/none", f"{tmp_path}/out") == {}


def test_a_url_that_all_pages_share(spark):
    """The captures of one URL come together as sums; no task holds them all."""
    many = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.org/"), F.repeat(F.lit("x"), 3)).alias("url"), F.lit(page(SHOWN)).alias("html"))
    assert {r["status"]: r["count"] for r in web_captures.captures(many, 400).groupBy("status").count().collect()} == {"captured": 1, "duplicate": 19_999}


@pytest.mark.parametrize("name", ["job1_search_index", "job2_web_captures"])
def test_job_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    before = spark.conf.getAll if isinstance(spark.conf.getAll, dict) else dict(spark.conf.getAll)
    got = normal(getattr(bound, name)(spark, str(DATA)).toPandas())
    assert (spark.conf.getAll if isinstance(spark.conf.getAll, dict) else dict(spark.conf.getAll)) == before
    want = normal(con.sql(ORACLES[name]).df())
    assert len(got) and got.equals(want)


def test_command_lines(tmp_path):
    """Both jobs from their command lines, with a config file; the index is searched afterwards."""
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"input": f"{DATA}/documents.parque[t]", "output": f"{tmp_path}/index", "checkpoint": f"{tmp_path}/mark", "id": "doc_id", "id_type": "long", "text": "text", "buckets": 4, "files_per_batch": 8}))

    def call(*args):
        return subprocess.run([sys.executable, *args], check=True, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "SPARK_LOCAL_IP": "127.0.0.1", **{k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "PATH", "PYSPARK"))}})

    first = call(f"{ROOT}/jobs/search_index.py", "--config", str(config))
    assert "read 200 new rows" in first.stderr
    assert "read 0 new rows" in call(f"{ROOT}/jobs/search_index.py", "--config", str(config)).stderr
    found = call(f"{ROOT}/jobs/search_index.py", "--config", str(config), "--find", "the pathetic")
    assert found.stdout.splitlines()[0].split()[0] == "1"
    told = call(f"{ROOT}/jobs/web_captures.py", "--input", f"{DATA}/pages.parquet", "--output", f"{tmp_path}/web")
    assert "captured" in told.stderr and (tmp_path / "web" / "ledger").is_dir()
    config.write_text('{"inptu": "x"}')
    with pytest.raises(subprocess.CalledProcessError):
        call(f"{ROOT}/jobs/search_index.py", "--config", str(config))
