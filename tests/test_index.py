"""Index builds, statistics and page-making functions on the small vault."""
import pytest
from pyspark.sql import functions as F

from tessera.functions import clips as C
from tessera.operators import aggregates as A, index as I, mining, quality
from tessera.sources import vault

from .vault_fixture import build


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("vault")
    build(path)
    return path


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_index_build_update_search(spark, root, tmp_path):
    first = I.build(spark, str(root / "wiki/format"), str(tmp_path / "one"))
    assert first["pages"].count() == 10 and first["meta"].first()["value"] == "10" and first["vectors"].count() == first["chunks"].count()
    found = I.search(first, "soil types", 3)
    assert found.first()["title"] == "Soil Types" and {"vector", "graph", "lexical"} & set(found.first()["signals"].split(","))
    assert "[[Soil Types]]" in I.results_page(found, "soil types").first()["page"]
    chunks, pages = I.missing(first)
    assert chunks.count() == 0 == pages.count()
    (root / "wiki/format/webpages/Soil Types.md").write_text("---\ntitle: Soil Types\n---\n\nAll new clay")
    (root / "wiki/format/webpages/Soil Copy.md").unlink()
    (root / "wiki/format/webpages/New.md").write_text("---\ntitle: New\n---\n\nfresh page about clay")
    second = I.update(spark, str(root / "wiki/format"), str(tmp_path / "one"), str(tmp_path / "two"))
    titles = {r["title"]: r["body"] for r in second["pages"].collect()}
    assert len(titles) == 10 and "Soil Copy" not in titles and titles["Soil Types"] == "All new clay" and I.missing(second)[1].count() == 0
    kept = I.update(spark, str(root / "wiki/format"), str(tmp_path / "one"), str(tmp_path / "three"), parity=True)
    assert kept["pages"].count() == 11 and I.missing(kept)[1].count() == 2
    gone = second["pages"].where("title = 'New'").select("page_id")
    assert I.without(second, gone)["pages"].count() == 9


def test_statistics(spark, root):
    pages, raws = vault.pages(spark, str(root / "wiki/format")), vault.raw_files(spark, str(root))
    stats = {r["metric"]: r["n"] for r in A.corpus_stats(pages, raws, vault.ledger(spark, str(root / "url-resolved.tsv")), vault.pending_urls(spark, str(root / "pending.txt"))).collect()}
    assert stats["raws"] == 10 and stats["ledger:captured"] == 2 and stats["pending"] == 1 and stats["raw:webpages"] == 10
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, ["c"])], "id long, tags array<string>")
    assert [tuple(r) for r in A.count_by_field(d, "tags", "id").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    t = spark.createDataFrame([([{"n": "1,000", "s": "x"}, {"n": "2", "s": "3"}],)], "rows array<map<string,string>>")
    assert [r[0] for r in A.numeric_columns(t).collect()] == ["n"]
    links = spark.createDataFrame([("p", 1, "https://a.org/x?utm_source=1"), ("p", 2, "https://www.a.org/x"), ("p", 3, "https://b.org/login"), ("p", 4, "https://c.org/y")], "page string, pos int, url string")
    assert [r["url"] for r in A.distinct_links(links, "page").collect()] == ["https://a.org/x?utm_source=1", "https://b.org/login", "https://c.org/y"]
    assert [r["url"] for r in A.followed_links(links, "page", quality.SKIPPED_LINKS, 2).collect()] == ["https://a.org/x?utm_source=1", "https://www.a.org/x"]
    found = spark.createDataFrame([("https://s.org/1", "https://a.org/x"), ("https://s.org/1", "https://s.org/1#y"), ("https://s.org/1", "https://q.org/")], "source_url string, url string")
    assert [r["url"] for r in A.queued(found, spark.createDataFrame([("https://q.org",)], "url string"), found.select("url").limit(0)).collect()] in (["https://a.org/x"], ["https://a.org/x", "https://q.org/"])
    assert A.page_of_url(spark.createDataFrame([("https://site.org/soil-types",)], "url string"), vault.ledger(spark, str(root / "url-resolved.tsv")).withColumn("title", F.lit("Lexer Notes")), pages).count() == 1
    assert A.refreshed(pages, raws).where("title = 'Lexer Notes'").first()["url"] == "https://site.org/lexer-notes"
    later = A.touched(pages, spark.createDataFrame([("https://site.org/lexer-notes", "2025-01-01T00")], "url string, ts string"))
    assert later.where("title = 'Lexer Notes'").first()["last_updated"] == "2025-01-01"
    assert mining.claims(vault.claim_pages(spark, str(root / "wiki"))).count() >= 7


def test_more_rules(spark, root):
    pages, raws = vault.pages(spark, str(root / "wiki/format")), vault.raw_files(spark, str(root))
    wrong = pages.select("page_id", F.when(F.col("title") == "Lexer Notes", "Else").otherwise(F.col("title")).alias("title"))
    assert quality.indexed_titles(pages, wrong).count() == 1 and quality.asset_problems(spark.createDataFrame([("nowhere",)], "slug string"), pages).count() == 1
    listing = spark.createDataFrame([("l", "[[Lexer Notes]] [[Nothing]]")], "path string, body string")
    assert [r["detail"] for r in quality.listed_nothing(listing, pages).collect()] == ["Nothing"]
    hub = spark.createDataFrame([("Hub", "topic", [], "| [[A]] | x |\n- [[B]]", "h.md"), ("A", "paper", ["[[Hub]]"], "", "a.md"), ("C", "paper", ["[[Hub]]"], "", "c.md")], "title string, source_type string, related array<string>, body string, rel_path string")
    assert {(r["rule"], r["detail"]) for r in quality.member_lists(hub).collect()} == {("22", "C"), ("23", "B")}
    thread = spark.createDataFrame([("p", "https://x.com/ann/status/1", "x.com/ann/status/2")], "path string, source string, body string")
    clip = spark.createDataFrame([("https://x.com/ann/status/1", "x.com/ann/status/2 x.com/ann/status/3")], "source string, body string")
    assert quality.short_threads(thread, clip).count() == 1


def test_page_making(spark):
    assert one(spark, "## Key Findings\n\nreal\n## X", C.body_problem) is None and one(spark, "## Key Findings\n\n*Pending", C.body_problem) == "key-findings-empty" and one(spark, "x", C.body_problem) == "missing-key-findings"
    empty = F.create_map().cast("map<string,string>")
    assert one(spark, "- **Source:** https://a.org/x\nhttps://b.org", lambda c: C.url_in_body(empty, c)) == "https://a.org/x" and one(spark, "see https://w3.org/a https://b.org", lambda c: C.url_in_body(empty, c)) == "https://b.org"
    assert one(spark, "My Title\nMY TITLE!\n-\nHome > A > B\ntext", lambda c: C.without_title_lines(c, F.lit("My title"))) == "text"
    made = spark.createDataFrame([("# A useful heading\n\n" + "Words of prose about rag. " * 8,)], "b string").select(*(c.alias(k) for k, c in C.fallback_page(F.col("b"), F.lit("u"), F.lit("github"), {"rag": ("rag",)}).items())).first()
    assert made["title"] == "GitHub: A useful heading" and made["summary"].startswith("Words of prose") and made["tags"] == ["rag"]
    assert one(spark, "m.a.org", lambda c: C.icon(c, {"a.org": "A"})) == "A" and one(spark, "b.org", lambda c: C.icon(c, {"a.org": "A"})) == "🌐"
    assert one(spark, {"title": 'a"b'}, lambda c: C.migrated(c, F.lit("body")), "map<string,string>") == '---\ntitle: "a\\"b"\n---\n\nbody'
    assert one(spark, "[Ann](https://l.com/x?trk=feed_main-actor) ![p](img)\nReal text\n12 reactions\nSign in to see", C.without_actor_chrome) == "Real text\n\n![p](img)"
    clips = spark.createDataFrame([("d/a.md", "---\ntitle: Post\nsource: https://x.com/a/status/1\n---\nA first line that says something\nReply"), ("d/b.md", "plain"), ("d/c.md", "---\ntitle: T\n---\nx")], "path string, content string")
    got = {r["path"]: r for r in C.intake(clips, {}).collect()}
    assert got["d/a.md"]["title"] == "A first line that says something" and got["d/a.md"]["reason"] is None and got["d/b.md"]["reason"] == "no front matter" and got["d/c.md"]["reason"] == "no source"
