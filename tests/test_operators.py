"""Sources, retrieval, graph, mining, reflection, quality, changes, sinks and streams on the small vault, against plain versions."""
import json
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evolve, graph, mining, quality, reflect, retrieval
from tessera.sources import export, vault
from tessera.streaming import watch

from .vault_fixture import CLUSTERS, build


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("vault")
    build(path)
    return str(path)


@pytest.fixture(scope="module")
def pages(spark, root):
    return vault.pages(spark, root + "/wiki/format").cache()


@pytest.fixture(scope="module")
def raws(spark, root):
    return vault.raw_files(spark, root).cache()


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_sources(spark, root, pages, raws):
    assert vault.pages(spark, root + "/wiki").count() == 13 and pages.count() == 10 and pages.where("title = 'Soil Types'").first()["tags"] == ["garden", "webpage"]
    assert raws.count() == 10 and dict(rows(raws, "slug", "source"))["old"] == "https://old.org/x"
    assert [r["title"] for r in vault.listing(spark, root + "/wiki", "webpage", recent=2).collect()] == ["Soil Copy", "Crop Rotation"]
    assert rows(vault.ledger(spark, root + "/url-resolved.tsv").orderBy("title", "ts"), "status", "resolved_url", "ts") == [("captured", None, "2024-01-05T00:00"), ("captured", None, "2024-03-05T00:00"), ("thin", "https://a.org/y", None)]
    assert rows(vault.pending_urls(spark, root + "/pending.txt")) == [("https://p.org/1",)]
    entries = vault.journal(spark, root, "2024-01-03").collect()
    assert [(e["date"], e["time"]) for e in entries] == [("2024-01-05", "18:00"), ("2024-01-05", "09:30")] and entries[1]["text"].endswith("There is a gap.")
    log = vault.session_logs(spark, root, "2024-01-01").first()
    assert log["sections"]["Summary"] == "last" and watch.latest_session(vault.session_logs(spark, root, "2024-01-01")).first()["open_threads"] == "- t"
    assert rows(vault.projects(spark, root)) == [("one", "Project One", "active")]
    assert [(r[0], r[2]) for r in rows(vault.rules(spark, root + "/rules.md"))] == [("Links", "link back"), ("Style", "be short"), ("Style", "be clear")]
    assert vault.inside("/a", "b/../c") and not vault.inside("/a", "../c") and not vault.inside("/a", "/etc")
    assert vault.config({"a": {"b": 1, "c": [1]}, "d": 2}, '{"a": {"c": [3]}}') == {"a": {"b": 1, "c": [3]}, "d": 2}
    chunks = vault.vault_chunks(pages)
    assert chunks.where("heading = 'Detail'").count() == 8 and chunks.select("chunk_id").distinct().count() == chunks.count()
    assert rows(vault.recently_changed(vault.files(spark, root, "*.txt"), "2020-01-01"), "name") == [("pending.txt",)]


def plain_bm25(docs, terms, weights):
    tokens = {i: {f: re.findall("[a-z]+", (d[f] or "").lower()) for f in weights} for i, d in docs.items()}
    size = {i: sum(map(len, t.values())) for i, t in tokens.items()}
    avg, n, out = sum(size.values()) / len(docs), len(docs), defaultdict(float)
    for t in terms:
        tf = {i: sum(w * tokens[i][f].count(t) for f, w in weights.items()) for i in docs}
        df = sum(x > 0 for x in tf.values())
        idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
        for i, x in tf.items():
            if x:
                out[i] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / avg))
    return out


def test_bm25_is_the_formula(spark, pages):
    weights = {"title": 5.0, "summary": 3.0, "body": 1.0}
    docs = {r["page_id"]: r.asDict() for r in pages.collect()}
    got = dict(rows(retrieval.bm25(pages, ["soil", "garden", "zzz"], weights), "page_id", "score"))
    want = plain_bm25(docs, ["soil", "garden"], weights)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)
    assert [retrieval.bm25(pages, ["compilers"], weights, stem=s).count() for s in (True, False)] == [4, 0]
    two = dict(rows(retrieval.lexical(pages, "soil garden", fields=weights)))
    best = max(two, key=two.get)
    assert docs[best]["title"] == "Soil Types"


def test_hybrid_and_fusion(spark, pages):
    edges = graph.link_edges(pages)
    kw = retrieval.keywords_by_frequency(pages)
    found = retrieval.hybrid(pages, "show soil types", edges=edges, keywords=kw, k=4).collect()
    assert found[0]["title"] == "Soil Types" and "lexical" in found[0]["signals"] and found == sorted(found, key=lambda r: -r["score"])
    a = spark.createDataFrame([("x", 4.0), ("y", 2.0)], "page_id string, score double")
    b = spark.createDataFrame([("y", 1.0)], "page_id string, score double")
    got = {r["page_id"]: (r["score"], r["signals"]) for r in retrieval.fuse([("a", a, 1), ("b", b, 2)]).collect()}
    assert got["x"][0] == pytest.approx(2 / 61) and got["y"][0] == pytest.approx(1 / 62 + 0.5 / 61 + 4 / 61) and got["y"][1] == "a,b"
    flipped = {r["page_id"]: r["score"] for r in retrieval.fuse([("b", b, 2), ("a", a, 1)]).collect()}
    assert all(flipped[k] == pytest.approx(v[0]) for k, v in got.items())
    assert rows(retrieval.search_or_scan(None, spark.createDataFrame([("p", "has Soil")], "path string, content string"), "soil")) == [("p", 0.0)]
    ranks = retrieval.keywords_by_frequency(pages).where("rank = 1").count()
    assert ranks == 10
    sections = pages.select("page_id", F.posexplode(T.chunks(F.col("body"))).alias("position", "c")).select("page_id", "position", "c.heading", "c.text")
    assert retrieval.snippets(sections, pages, "soil types").first()["page_id"] in {r["page_id"] for r in pages.collect()}


def plain_bfs(edges, seeds, depth=2, decay=0.5):
    near = defaultdict(set)
    for a, b, w in edges:
        near[a].add((b, w))
        near[b].add((a, w))
    scores, level, seen = defaultdict(float), [(s, 1 / (i + 1)) for i, s in enumerate(seeds)], set(seeds)
    for _ in range(depth):
        following = []
        for node, own in level:
            for b, w in sorted(near[node]):
                if b in seeds:
                    continue
                scores[b] += own * decay * w
                if b not in seen:
                    seen.add(b)
                    following.append((b, own * decay * w))
        level = following
    return scores


def test_bfs_is_the_plain_walk(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice([1.0, 2.0])) for _ in range(60)]
    edges = list({(a, b, w) for a, b, w in edges if a != b})
    df = spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    seeds = spark.createDataFrame([(5, 1), (9, 2), (1, 3)], "page_id long, place int")
    for n in (1, 5):
        got = dict(rows(retrieval.graph_signal(df.repartition(n), seeds)))
        want = plain_bfs(edges, [5, 9, 1])
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_vector_and_keyword_signals(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (1, [3.0, 4.0]), (2, [0.0, 2.0]), (3, None)], "page_id long, embedding array<float>")
    assert rows(retrieval.vector_signal(v, [0.0, 1.0])) == [(1, 1.0), (2, 0.5)]
    k = spark.createDataFrame([(1, "soil", 0.5), (1, "types", 0.25), (2, "soil types", 9.0)], "page_id long, keyword string, score double")
    assert rows(retrieval.keyword_signal(k, "soil types")) == [(1, 1.5)]


def test_link_graph(spark, pages):
    names = {r["page_id"]: r["title"] for r in pages.collect()}
    edges = graph.link_edges(pages)
    got = {(names[a], names[b], t) for a, b, t, _ in rows(edges)}
    assert ("Parser Notes", "Compiler Design", "related") in got and ("Compiler Design", "Lexer Notes", "wikilink") in got
    assert not any("Missing" in x for e in got for x in e) and ("Soil Types", "Soil Copy", "related") in got
    assert {names[r[0]] for r in rows(graph.orphans(pages, edges), "page_id")} == {"Lone &amp; Odd"}
    reached, _ = graph.subgraph(edges, pages.where("title = 'Soil Types'").select("page_id"), 1)
    assert {names[r[0]] for r in rows(reached)} == {"Soil Types", "Garden Planning", "Seed Storage", "Crop Rotation", "Soil Copy"}
    assert [r["title"] for r in graph.related_neighbours(pages, "Soil Types").collect()] == ["Garden Planning", "Seed Storage"]
    kw = retrieval.keywords_by_frequency(pages, most=5)
    whole = graph.weighted_graph(edges, kw)
    members = graph.communities(whole, rounds=6)
    groups = defaultdict(set)
    for node, c, _ in rows(members):
        groups[c].add(names[node])
    for hub, own in CLUSTERS.items():
        assert any({hub, *own} <= g for g in groups.values())
    assert graph.modularity(whole, members) > 0.3
    labels = graph.community_labels(members, kw)
    assert graph.community_suggestions(labels, spark.createDataFrame([("zzz",)], "title string")).count() >= 2


def test_mining(spark, pages):
    kw = spark.createDataFrame([(1, "a", 1.0, True), (1, "b", 1.0, True), (2, "a", 1.0, True), (2, "b", 1.0, False), (3, "a", 1.0, True)], "page_id long, keyword string, score double, is_top boolean")
    own = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "page_id long, title string")
    assert rows(mining.see_also(kw, own), "page_id", "other_id", "shared") == [(1, 2, 2), (2, 1, 2)]
    assert rows(mining.see_also_one(kw, own, "tw"), "page_id") == [(1,)] and rows(mining.keyword_overview(kw, own)) == [("a", 3, "One, Three, Two"), ("b", 2, "One")]
    c = mining.claims(pages)
    assert c.count() == 8
    alike = spark.createDataFrame([(1, "Great Tool Review", "u", "1,000 stars, then 1,500 stars", "x"), (2, "Great Tool Review again", "v", "900 stars", "x"), (3, "Great Tool Review", "u", "900 stars", "topic"), (4, "Other", "u", "1,400 stars spring 2022", "x"), (5, "Other", "w", "fall 2024", "x")], "page_id long, title string, url string, body string, source_type string")
    got = sorted(rows(mining.page_conflicts(alike, mining.claims(alike)), "page_id", "subject", "lowest", "highest"))
    assert got == [(1, "stars", 900, None), (2, "stars", None, 1500)] and rows(mining.semester_conflicts(alike), "page_id", "before") == [(5, "spring 2022")]
    dup = mining.duplicate_pages(pages.select(F.hash("title").alias("page_id"), "title", "body", "url"))
    assert dup.where("rule = 'url'").count() == 2
    whole, per_page = mining.entities(spark.createDataFrame([(1, "Ann Lee met CS229A and ann lee"), (2, "ANN and Ann  Lee used pytorch")], "page_id long, body string"))
    assert dict(rows(whole, "normalized", "mention_count"))["ann lee"] == 2 and per_page.count() == 4
    assert mining.question_type("How many repos do I have?") == (True, "repo") and mining.question_type("a report") == (False, "repo")
    assert rows(mining.counted_answer(pages, "webpage", ["soil"])) == [("webpage", 2)] and rows(mining.counted_answer(pages, "paper", ["soil"])) == [("page", 2)]
    best = mining.best_topic(spark.createDataFrame([(1, "Soil notes", ["garden"])], "page_id long, title string, tags array<string>"), spark.createDataFrame([(7, "Soil", ["x"]), (8, "Trees", ["garden"])], "page_id long, title string, tags array<string>"))
    assert rows(best) == [(1, 7, 3)]
    v = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "page_id long, embedding array<float>")
    q = v.where("page_id % 10 = 0").select("page_id")
    exact, near = ({(a, b) for a, b in rows(f(v, q, 3), "source_id", "target_id")} for f in (graph.nearest_edges, mining.lsh_neighbours))
    assert len(exact & near) >= 0.9 * len(exact)


def test_reflection(spark, root, pages):
    entries = vault.journal(spark, root, "2024-01-01").withColumn("entry_id", F.concat("date", "time"))
    themes = dict(rows(reflect.themes(entries)))
    assert themes["garden"] == 3 and themes["notes"] == 2 and "read" not in themes
    assert dict(rows(reflect.thinking_patterns(entries)))["gap_detection"] == 2 and reflect.pattern_evidence(entries).count() >= 2
    assert rows(reflect.referenced_pages(entries, pages), "title") == [("Soil Types",)] and rows(reflect.derived_searches(entries))[0] == ("CS229", 1)
    i = spark.createDataFrame([(1, "Graph ideas", "merge every graph page", "[[A]] [[B]]"), (2, "Graph rules", "merge every graph node", "[[B]]"), (3, "Else", "none", "")], "insight_id long, title string, rules string, evidence string")
    assert rows(reflect.insight_connections(i)) == [(1, 2, "evidence,rule,title", 3)]
    assert [r["date"] for r in reflect.day_previews(entries).collect()] == ["2024-01-05", "2024-01-02"] and rows(reflect.focus(entries, ["cs229", "gap"]), "relevance")[0] == (1.0,)
    assert set(reflect.report(entries, pages, i, pages)) == {"entries", "themes", "patterns", "evidence", "connections", "references", "changes", "searches"}


def test_quality(spark, root, pages, raws):
    found = quality.findings(pages, raws).collect()
    by = defaultdict(set)
    for r in found:
        by[r["rule"]].add(r["path"].rsplit("/", 1)[-1])
    odd, copy = "Lone &amp; Odd.md", "Soil Copy.md"
    assert by["1"] == {odd} and by["2a"] == {odd} and by["2c"] == {"orphan.md", "old.md"} and by["4-type"] == {odd} and odd in by["17"] and by["30"] == {odd} and by["34"] == {odd} and by["36"] == {odd}
    assert by["2e"] == {"soil-types.md"} and by["3a"] == {odd} and copy in by["3c"] and len(by["6a"]) == 2 and by["30c-raw"] == {"old.md"} and by["43"] == {"orphan.md"}
    clean = pages.where(F.col("title").isin("Parser Notes", "Lexer Notes"))
    assert not {r["rule"] for r in quality.predicate_findings(clean, "pages", "rel_path").collect()} - {"4-tags", "13", "15a", "15f"}
    top = quality.classes(quality.findings(pages, raws)).first()
    assert top["n"] >= len(top["samples"]) and len(top["samples"]) <= 5
    fixed = {r["title"]: r for r in quality.fixes(pages).collect()}
    assert fixed["Lone & Odd"]["date_added"] == "2024-01-09" and fixed["Soil Types"]["url"] == "https://site.org/soil-types"
    assert quality.stated_counts(pages, raws, {"wiki": 10, "raw": 9}).count() == 1
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["ctx", "", "", "", "", "url", "url", "x", "url"])], "path string, n int, line string")
    assert rows(quality.context_flags(lines, "url", "ctx"), "path") == [("f",)]
    one = lambda v, f: spark.createDataFrame([(v,)], "s string").select(f(F.col("s"))).first()[0]
    assert one("x" * 99, quality.summary_problem) == "too-short" and one("This page " + "x " * 60, quality.summary_problem) == "forbidden-opener" and one("Good words. " * 10, quality.summary_problem) is None
    assert one("Long text " * 12 + "cut off at t", quality.looks_cut) and not one("A whole sentence of some length. " * 5, quality.looks_cut)
    dead = spark.createDataFrame([("https://www.a.org/x?utm_source=1",), ("https://b.org/y",)], "url string")
    assert quality.dead_again(dead, spark.createDataFrame([("https://a.org/x",)], "url string")).count() == 1


def test_changes(spark, root, pages, tmp_path):
    merged = evolve.merge_pages(spark.createDataFrame([("k", 1, ["a", "b"], ["u1"], ["r1"], "2024-02", "webpage", "w"), ("k", 2, ["b", "c"], ["u1", "u2"], [" "], "", "paper", "p")], "key string, place int, tags array<string>, urls array<string>, raw_paths array<string>, date_added string, source_type string, summary string"), "key").first()
    assert (merged["tags"], merged["urls"], merged["raw_paths"], merged["date_added"], merged["source_type"], merged["summary"]) == (["a", "b", "c"], ["u1", "u2"], ["r1"], "2024-02", "paper", "p")
    winners = evolve.url_winners(pages.where("url != ''"))
    assert winners.where("wins").count() == 1 and winners.count() == 3
    renames = spark.createDataFrame([("Soil Types", "Soils")], "old string, new string")
    bodies = dict(rows(evolve.renamed(pages, renames), "title", "body"))
    assert "[[Soils]]" in bodies["Soil Copy"] and "[[Soil Types]]" not in bodies["Crop Rotation"] and evolve.redirect_stubs(renames).count() == 1
    old, new = (spark.createDataFrame(x, "page_id long, content_hash string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(2, "b"), (3, "d"), (4, "e")]))
    assert dict(rows(evolve.index_changes(old, new))) == {1: "removed", 2: "same", 3: "changed", 4: "added"} and rows(evolve.incremental(old, new)) == [(2, "b")]
    ledger = vault.ledger(spark, root + "/url-resolved.tsv")
    assert evolve.ledger_upsert(ledger, ledger.limit(0)).count() == 2
    m = spark.createDataFrame([("h", "a"), ("h", "b"), ("g", "a")], "hub string, member string")
    a = spark.createDataFrame([("a",)], "member string")
    assert set(rows(evolve.move(m, a, "z"), "hub", "member")) == {("h", "b"), ("z", "a")} and evolve.ungroup(m, "h").count() == 1 and evolve.detach(m, spark.createDataFrame([("h", "a")], "hub string, member string")).count() == 2
    gone = pages.where("title = 'Soil Types'").select("page_id")
    left = evolve.removed(pages, gone)
    assert left.count() == 9 and all("[[Soil Types]]" not in r["related"] for r in left.collect())
    v = evolve.Versions(spark, str(tmp_path / "data"))
    v.write(old, "add", "2024-01-01")
    v.write(new, "merge", "2024-02-01")
    v.restore("2024-03-01")
    assert v.read().count() == 3 and {r[0] for r in rows(v.read(), "page_id")} == {1, 2, 3} and v.listed().count() == 3 and v.purge("2024-02-15") == [0, 1]


def test_sinks(spark, pages, tmp_path):
    d = spark.createDataFrame([("b", 2), ("a", 5), ("a very long label that goes on and on", 1)], "k string, v long")
    chart = export.bar_chart(d, "k", "v", "T").first()[0]
    assert chart.split("\n")[3].startswith('    x-axis ["a", "b", "a very long label that goes o…') and "0 --> 6" in chart and "bar [5, 2, 1]" in chart
    assert export.bar_chart(d.limit(0), "k", "v").first()[0] == "*(No data for bar chart)*" and '"a" : 5' in export.pie_chart(d, "k", "v").first()[0]
    n = pages.select(F.col("rel_path").alias("path")).limit(4)
    canvas = json.loads(export.canvas(n, "center.md").first()[0])
    assert [(x["x"], x["y"]) for x in canvas["nodes"]] == [(0, 0), (520, 0), (0, 520), (-520, 0), (0, -520)] and [e["fromSide"] for e in canvas["edges"]] == ["right", "bottom", "left", "top"]
    assert export.feature_matrix(spark.createDataFrame([("f", "Strong", "no")], "feature string, a string, b string"), "feature", ["a", "b"]).first()[0].endswith("| f | 🟢 | 🔴 |")
    g = export.relationship_graph(spark.createDataFrame([(1, "A", 3), (2, "B", 2), (3, "C", 1)], "id long, label string, weight long"), spark.createDataFrame([(1, 2), (1, 3)], "source long, target long"), 2).first()[0]
    assert "n1 --> n2" in g and "C" not in g
    sections = pages.select("page_id", F.posexplode(T.chunks(F.col("body"))).alias("position", "c")).select("page_id", "position", "c.heading", "c.text")
    assert "## Detail\n\n- See" in export.slides(sections).where(F.col("slides").contains("Detail")).first()["slides"]
    assert "timeline" in export.timeline(spark.createDataFrame([("2024", "x"), ("2023", "y")], "d string, t string"), "d", "t").first()[0] and "gantt" in export.gantt(spark.createDataFrame([("n", "a", "b")], "n string, s string, e string"), "n", "s", "e").first()[0]
    assert export.stats_page(d, "k", "v").count() == 1
    index = export.page_index(pages).collect()
    assert index[0]["day"] == "2024-02-01" and index[0]["n"] == 8
    assert rows(export.collections(pages, {"soil": F.col("title").contains("Soil"), "none": F.lit(False)})) == [("soil", 2)]
    export.write_table(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    raw = spark.createDataFrame([("webpages", "https://a.org/x", "T", "b" * 2000, 0, 1), ("webpages", "https://a.org/#/x", "T", "b", 0, 2), ("webpages", "https://a.org/y", "T", "Just a moment...", 0, 3), ("webpages", "https://a.org/x", "T", "b", 9000, 4), ("webpages", "https://a-org/x", "T", "b" * 2000, 0, 5)], "category string, source string, title string, body string, existing_size long, place long")
    own = export.accepted(raw)
    assert [r["reason"] for r in own.orderBy("place").collect()] == [None, "identity lost", "interstitial", "thinner than what is there", None]
    assert sorted(set(rows(export.distinct_slugs(own.where("reason is null")), "file_slug"))) == [("a-org-x",), ("a-org-x-2",)]
    text = spark.range(1).select(export.markdown_page(F.lit('a"b'), {"k": F.lit("v")}, F.lit("body"))).first()[0]
    assert text == '---\ntitle: "a\\"b"\nk: "v"\n---\n\nbody'


def test_streams(spark, tmp_path):
    folder = tmp_path / "clips"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    seen = []
    stream = watch.watched_files(spark, f"file://{folder}")
    for _ in range(2):
        watch.run_once(stream, str(tmp_path / "cp"), lambda b, n: seen.extend(r["content"] for r in b.collect()))
        (folder / "b.md").write_text("two")
    assert seen == ["one", "two"]
    events = spark.createDataFrame([(1, "u", "2024-01-01 00:10:00", 1.0), (1, "u", "2024-01-01 00:20:00", 2.0), (2, "v", "2024-01-01 03:00:00", None)], "user_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(rows(watch.tumbling(events), "event_type", "n")) == [("u", 2), ("v", 1)] and watch.sliding(events).count() == 4
    assert sorted(rows(watch.sessions(events), "user_id", "n")) == [(1, 2), (2, 1)]
    events.write.parquet(str(tmp_path / "events"))
    out = []
    source = watch.parquet_stream(spark, str(tmp_path / "events"))
    watch.run_once(watch.running_totals(source), str(tmp_path / "cp2"), lambda b, n: out.extend(tuple(r) for r in b.collect()), "update")
    assert sorted(out) == [(1, 2, 3.0), (2, 1, 0.0)]
    apply = watch.upsert_into(str(tmp_path / "ledger"))
    apply(spark.createDataFrame([("thin", "https://a.org/x", "1")], "status string, url string, ts string"), 0)
    apply(spark.createDataFrame([("captured", "https://www.a.org/x?utm_source=1", "2")], "status string, url string, ts string"), 1)
    assert rows(spark.read.parquet(str(tmp_path / "ledger/v=1")), "status") == [("captured",)]
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    watch.quarantine_into(good, bad)(spark.createDataFrame([("x", None), ("y", "thin")], "u string, reason string"), 0)
    assert spark.read.parquet(good).count() == 1 == spark.read.parquet(bad).count()
    urls = spark.createDataFrame([("https://a.org/x", 1), ("https://b.org/y", 2), ("https://b.org/y#z", 3)], "url string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    urls.write.parquet(str(tmp_path / "urls"))
    fresh = []
    new = watch.new_urls(watch.parquet_stream(spark, str(tmp_path / "urls")), spark.createDataFrame([("https://a.org/x/",)], "url string"))
    watch.run_once(new, str(tmp_path / "cp3"), lambda b, n: fresh.extend(r["canonical"] for r in b.collect()))
    assert fresh == ["https://b.org/y"]
