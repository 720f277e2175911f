"""The whole job of queries whose SQL stands for a part of it: against plain versions without that cut."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clips, frontmatter, stemming
from tessera.operators import graph, mining, neighbours, retrieval
from tessera.plans import bindings, vault_queries  # noqa: F401 (registers its queries)
from tessera.plans.queries import ORACLES, QUERIES

from .conftest import DATA


def run(spark, name):
    return {tuple(r) for r in QUERIES[name](spark, str(DATA)).collect()}


def run_in(spark, name, folder):
    return {tuple(r) for r in QUERIES[name](spark, str(folder)).collect()}


def knn(vectors: dict, k: int) -> set:
    """Every pair measured; ties go to the smaller id."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype="float64")
    out = set()
    for i, own in enumerate(ids):
        far = np.sqrt(np.cumsum((x - x[i]) ** 2, axis=1)[:, -1])
        out |= {(own, t) for _, t in sorted((far[j], t) for j, t in enumerate(ids) if t != own)[:k]}
    return out


@pytest.fixture(scope="module")
def links():
    return knn(dict(duckdb.sql(f"select vec_id, embedding from read_parquet('{DATA}/embeddings.parquet')").fetchall()), 3)


def test_neighbours_of_all(spark, links):
    pages = {a for a, _ in links}
    assert len(pages) == 500
    assert run(spark, "nearest_neighbours") == {(a, b) for a, b in links if a % 50 == 0}
    assert run(spark, "orphans") == {(p,) for p in pages - {b for _, b in links}}
    assert run(spark, "inbound_links") == {(p, sum(b == p for _, b in links)) for p in pages}
    assert run(spark, "one_way_links") == {(a, b) for a, b in links if (b, a) not in links}
    for name, depth, both in (("subgraph_reach", 3, False), ("subgraph_nodes", 2, True)):
        edges = links | {(b, a) for a, b in links} if both else links
        seen = {0: 0}
        for d in range(1, depth + 1):
            for b in {b for a, b in edges if a in seen} - set(seen):
                seen[b] = d
        assert run(spark, name) == set(seen.items())


def test_nearest_edges_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "VECTOR_BLOCK", 16)
    v = {i: [float(i % 7), float(i % 5)] for i in range(90)}  # copies in every block
    got = graph.nearest_edges(spark.createDataFrame(list(v.items()), "page_id long, embedding array<float>"), None, 3)
    assert {tuple(r) for r in got.select("source_id", "target_id").collect()} == knn(v, 3)
    named = {f"p{i:02}": x for i, x in v.items()}
    got = graph.nearest_edges(spark.createDataFrame(list(named.items()), "page_id string, embedding array<float>"), None, 3)
    assert {tuple(r) for r in got.select("source_id", "target_id").collect()} == knn(named, 3)


def test_claims_conflict_at_any_distance(spark):
    """Every pair of claims of a part, whatever lies between their orders."""
    claims = duckdb.execute("SELECT l_orderkey, CAST(l_partkey AS VARCHAR), max(CAST(l_quantity AS BIGINT)) FROM read_parquet(?) GROUP BY ALL", [f"{DATA}/lineitem.parquet"]).fetchall()
    claims += [(10**9 + i, "edge", n) for i, n in enumerate((0, 0, 1, 4, 5, 8, 10, 100, 125))]
    by_subject = {}
    for page, subject, n in claims:
        by_subject.setdefault(subject, []).append(n)
    want = set()
    for page, subject, n in claims:
        far = [m for m in by_subject[subject] if abs(n - m) / max(n, m, 1) > 0.2]
        if far:
            want.add((page, subject, n, len(far), min(far), max(far)))
    df = spark.createDataFrame(claims, "page_id long, subject string, number long")
    assert {tuple(r) for r in mining.claims_in_conflict(df).collect()} == want
    pairs = mining.conflicts(spark.createDataFrame([(1, "s", 10), (999, "s", 20), (5, "s", 11)], "page_id long, subject string, number long")).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(1, 999), (5, 999)}


def test_entities_of_whole_texts(spark, tmp_path):
    text = "filler words " * 500 + "met Ann Lee and Bob Ray"
    spark.createDataFrame([(1, text, "s", "en"), (2, "Ann Lee", "s", "en")], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["entities"](spark, str(tmp_path)).collect()} == {("ann lee", 2), ("bob ray", 1)}
    pages = bindings.pages(spark, str(tmp_path))
    assert mining.entities(pages, head=5000)[0].where("normalized = 'bob ray'").count() == 0


def test_hybrid_search_walks_the_graph(spark):
    assert any("graph" in r["signals"] for r in QUERIES["hybrid_search"](spark, str(DATA)).collect())


def test_walk_edges_are_all_that_a_walk_needs(spark):
    kw = spark.createDataFrame([(i, f"k{(i * j) % 13}") for i in range(40) for j in (1, 2, 3)], "page_id long, keyword string")
    seeds = spark.createDataFrame([(1, 1), (5, 2)], "page_id long, place int")
    every = graph.cooccurrence(kw).selectExpr("a AS source_id", "b AS target_id", "1.0D AS weight")
    walks = [{r[0]: round(r[1], 9) for r in retrieval.graph_signal(e, seeds).collect()} for e in (every, graph.cooccurrence_near(kw, seeds))]
    assert walks[0] and walks[0] == walks[1]


def test_containment_of_many_items(spark, monkeypatch):
    rows = [(i, f"word{i} some long text with item {i % 7} inside, x{i}y") for i in range(40)]
    items = [(k, f"text with item {k} inside") for k in range(9)] + [(100, "x3"), (101, "ord1"), (102, "absent words are here"), (103, None)]
    want = {(i, k) for i, t in rows for k, x in items if x and x in t}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in mining.containment(docs, bench).collect()} == want
    monkeypatch.setattr(mining, "ITEM_BYTES", 40)
    assert {tuple(r) for r in mining.containment(docs, bench).collect()} == want and len(want) > 40


def test_containment_of_100_000_items(spark):
    """100,000 items, most of them without a word between two others, in one pass and without a nested loop."""
    import random

    draw = random.Random(9)
    items = {i: "".join(draw.choice("ab c") for _ in range(draw.randrange(3, 40))) for i in range(100_000)}
    texts = {i: "".join(draw.choice("ab c") for _ in range(draw.randrange(0, 400))) for i in range(60)} | {60: None, 61: ""}
    for i in range(0, 40):
        texts[i] += items[draw.randrange(100_000)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = mining.containment(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(i, k) for i, t in texts.items() if t for k, x in items.items() if x in t}
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "é"), (4, "é")], "item_id long, text string")
    got = mining.containment(spark.createDataFrame([(1, "caf é"), (2, ""), (3, None)], "doc_id long, text string"), odd)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (1, 3), (1, 4), (2, 1)}


def test_duplicate_pages_by_paragraphs_and_titles(spark):
    one, two, three, four = (f"{w} paragraph of more than fifty characters, so that it counts here" for w in ("first", "second", "third", "fourth"))
    rows = [(1, "https://a.org/x?utm_source=q", "Alpha", one + "\n\n" + two), (2, "https://www.a.org/x", "Beta", ""), (3, "", "Gamma", f"{three}\n\n{one}\n\n{two}"), (4, "", "A title with sixteen", ""), (5, "", "Here is a title with sixteen letters", ""), (6, "", "Delta", f"{one}\n\n{four}")]
    got = mining.duplicate_pages(spark.createDataFrame(rows, "page_id long, url string, title string, body string"))
    assert {tuple(r) for r in got.collect()} == {(2, 1, "url"), (3, 1, "paragraphs"), (5, 4, "title")}


def test_paragraphs_inside_longer_ones_as_a_plain_scan_finds_them(spark):
    import random

    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("abcde é") for _ in range(n)).strip()
    base = ["b" + letters(draw.randrange(50, 120)) + "b" for _ in range(12)]
    own = [p if draw.random() < 0.4 else "b" + letters(draw.randrange(0, 60)) + p + letters(draw.randrange(0, 60)) + "b" for p in base * 6]
    pages = [(i, "", f"t{i}", "\n\n".join(" ".join(p.split()) for p in draw.sample(own, draw.randrange(0, 6)))) for i in range(60)]
    long = {i: [p for p in body.split("\n\n") if len(p) >= 50] for i, _, _, body in pages}
    want = {}
    for i in long:
        for j in range(i):
            hits = sum(any(x in y or y in x for y in long[j][:5]) for x in dict.fromkeys(long[i][:3]))
            if hits >= 2 and i not in want:
                want[i] = j
    got = mining.duplicate_pages(spark.createDataFrame(pages, "page_id long, url string, title string, body string"))
    assert {r["page_id"]: r["match_id"] for r in got.collect()} == want and 10 < len(want) < 60


def test_hot_titles_and_urls_make_no_pairs(spark):
    """100,000 pages with one title, one URL and two claims: rows, not pairs, are what this costs."""
    n = 100_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://hot.org/x").alias("url"), F.lit("One very common page title").alias("title"), F.lit("paper").alias("source_type"),
                                  F.concat(F.when(F.col("id") % 2 == 0, "100 stars").otherwise("900 stars"), F.lit("")).alias("body"))
    found = mining.page_conflicts(pages, mining.claims(pages)).groupBy("number", "lowest", "highest").count().collect()
    assert {(int(r["number"]), r["lowest"] and int(r["lowest"]), r["highest"] and int(r["highest"]), r["count"]) for r in found} == {(100, None, 900, n // 2), (900, 100, None, n // 2)}
    members, links = mining.overlapping(pages.select("page_id", F.split("title", " ").alias("words")), 0.7)
    assert links.count() == 0 and mining.linked_pages(members, links).agg(F.min("n_links"), F.max("n_links")).first()[:] == (n - 1, n - 1)
    body = "a boilerplate paragraph that stands on every single page, " * 2 + "\n\n" + "another boilerplate paragraph that stands on every page, " * 2
    got = mining.duplicate_pages(pages.withColumns({"url": F.lit(""), "title": F.concat(F.lit("t"), F.col("page_id").cast("string")), "body": F.lit(body)}))
    assert got.groupBy("rule", "match_id").count().collect() == [("paragraphs", 0, n - 1)]
    assert mining.duplicate_pages(pages).groupBy("rule", "match_id").count().collect() == [("url", 0, n - 1)]


def test_keyword_pairs_with_hot_keywords(spark):
    """As a plain count of pairs, however few pages make a keyword hot; and 3,000 pages that share one keyword meet only at others."""
    import random
    from itertools import combinations

    draw = random.Random(3)
    held = {i: {"all"} | {f"k{int(draw.paretovariate(0.6)) % 40}" for _ in range(6)} for i in range(80)}
    kw = spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "page_id long, keyword string")
    for least in (1, 2, 3):
        want = {(a, b, len(held[a] & held[b])) for a, b in combinations(held, 2) if len(held[a] & held[b]) >= least}
        for hot_pages in (1, 5, 30, 1000):
            assert {tuple(r) for r in graph.cooccurrence(kw, least, hot_pages=hot_pages).collect()} == want
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("g"), (F.col("id") % 1000).cast("string")))).alias("keyword"))
    assert graph.cooccurrence(many).count() == 3000 and graph.cooccurrence(many).agg(F.max("shared")).first()[0] == 2


def test_reachable_by_least_distance(spark):
    edges = [(a, b) for a in range(12) for b in range(12) if a != b and (a * 5 + b) % 3] + [(11, 50), (50, 51)]
    got = graph.reachable(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame([(0,)], "page_id long"), 4)
    seen = {0: 0}
    for d in range(1, 5):
        for b in {b for a, b in edges if seen.get(a) == d - 1} - set(seen):
            seen[b] = d
    assert {tuple(r) for r in got.collect()} == set(seen.items())


def test_communities_reach_a_modularity(spark):
    """Four groups of ten that hang together inside: found whole, and no worse than the known split."""
    edges = [(10 * g + i, 10 * g + j, 1.0) for g in range(4) for i in range(10) for j in range(i + 1, 10) if (i + j) % 3] + [(10 * g, (10 * g + 10) % 40, 0.5) for g in range(4)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    found = graph.communities(df)
    known = spark.createDataFrame([(n, n // 10) for n in range(40)], "node long, community long")
    assert graph.modularity(df, found) >= graph.modularity(df, known) - 1e-9
    kw = bindings.keywords(spark, str(DATA))
    own = graph.cooccurrence(kw).selectExpr("a", "b", "CAST(shared AS DOUBLE) AS weight")
    assert graph.modularity(own, graph.communities(own)) >= 0.3


def test_lone_pages_get_their_nearest(spark):
    links = spark.createDataFrame([(1, 2, 2.0)], "source_id long, target_id long, weight double")
    none = spark.createDataFrame([], "page_id long, keyword string")
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0]), (4, [0.0, 4.0])], "page_id long, embedding array<float>")
    got = {(r["a"], r["b"]): round(r["weight"], 6) for r in graph.weighted_graph(links, none, vectors=vectors, k=1).collect()}
    assert got == {(1, 2): 2.0, (3, 4): 0.5}


def test_indexed_neighbours_recall(spark):
    """At least 0.9 of the exact neighbours of the vectors whose id 50 divides, with fewer probes than cells; all of them if all cells are looked into."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("page_id"), "embedding")
    asked = v.where("page_id % 50 = 0")
    exact = {(r[0], r[1]): r[2] for r in graph.nearest_edges(v, asked.select("page_id"), 3).select("source_id", "target_id", "place").collect()}
    index = neighbours.build(v)
    probes = neighbours.probes_for(index, v, asked, 3, 0.95)
    found = {(r[0], r[1]) for r in neighbours.search(index, asked, 3, probes).select("source_id", "target_id").collect()}
    assert len(found & set(exact)) >= 0.9 * len(exact) and probes < len(index.centres)
    every = {(r[0], r[1]): r[2] for r in neighbours.search(index, asked, 3, len(index.centres)).select("source_id", "target_id", "place").collect()}
    assert every == exact


def test_indexed_neighbours_of_equal_vectors(spark, tmp_path):
    """A vector of very many pages is one entry; ties go by page; the index can be stored."""
    rows = [(i, [1.0, 1.0]) for i in range(3000)] + [(5000 + i, [float(i), 0.0]) for i in range(40)] + [(9000, None)]
    v = spark.createDataFrame(rows, "page_id long, embedding array<float>")
    neighbours.build(v, cells=5).save(str(tmp_path))
    index = neighbours.load(spark, str(tmp_path))
    assert index.entries.count() == 41
    asked = v.where("page_id in (0, 2, 2999, 5003, 9000)")
    got = {(r["source_id"], r["place"]): (r["target_id"], round(r["distance"], 6)) for r in neighbours.search(index, asked, 3, 5).collect()}
    assert got == {(0, 1): (1, 0), (0, 2): (2, 0), (0, 3): (3, 0), (2, 1): (0, 0), (2, 2): (1, 0), (2, 3): (3, 0), (2999, 1): (0, 0), (2999, 2): (1, 0), (2999, 3): (2, 0), (5003, 1): (5002, 1), (5003, 2): (5004, 1), (5003, 3): (5001, 2)}
    with pytest.raises(ValueError):
        neighbours.search(index, asked, 6)
    assert neighbours.search(neighbours.build(v.limit(0)), asked, 3).count() == 0


def test_lexical_index_is_bm25(spark):
    """50 queries at once over stored postings, with weights by field: the same best 20 as a scan of the texts for each."""
    from tessera.operators import lexical_index

    pages = bindings.pages(spark, str(DATA))
    fields = {"title": 5.0, "summary": 3.0, "body": 1.0}
    texts = [" ".join(r["title"].split()[i : i + 3]) for i in range(2) for r in pages.orderBy("page_id").limit(25).select("title").collect()]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    post = lexical_index.postings(pages, fields)
    lens = pages.select("page_id", lexical_index.token_count(fields, dict(pages.dtypes)).alias("len"))
    got = {}
    for r in lexical_index.search(asked, post, lens).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["page_id"], round(r["score"], 6), r["matched"]))
    words = dict(asked.select("query_id", lexical_index.query_words(F.col("text"))).collect())
    for q in range(0, 50, 7):
        want = retrieval.bm25(pages, list(words[q]), fields).withColumn("score", F.round("score", 9))
        assert got.get(q, []) == [(r["page_id"], round(r["score"], 6), r["matched"]) for r in retrieval.top(want, 20).collect()]


def test_dead_marker_is_only_the_one_put_in(spark, tmp_path):
    """Texts with a marker of their own, of letters that two take in lower case, and between spaces that aren't blanks."""
    texts = {1: "call 4045650754", 2: "Page Not Found", 3: "call 4045650754", 4: "plain", 6: "\u0130" * 285, 9: "x" * 286, 12: "\u00a0" + "x" * 285 + "\u3000", 15: None, 18: "a\tb", 21: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = set(con.execute(ORACLES["rule_dead_marker"]).fetchall())
    assert {tuple(r) for r in QUERIES["rule_dead_marker"](spark, str(tmp_path)).collect()} == want == {(3,), (6,), (12,), (21,)}


@pytest.mark.parametrize("make", [lambda c: frontmatter.front_matter(c), lambda c: frontmatter.legacy_header(c), lambda c: clips.folded_typography(c), lambda c: stemming.stemmed(c), lambda c: mining.paragraph_keys(F.array(c))])
def test_python_functions_get_small_batches(spark, make):
    """Whatever the session's own size: what a Python worker holds must not grow with the rows of its partition."""
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)

    @F.arrow_udf("int")
    def rows(batch: pa.Array) -> pa.Array:
        return pa.array([len(batch)] * len(batch), pa.int32())

    own = spark.range(0, 5000, 1, 1).select(F.col("id").cast("string").alias("t"))
    got = own.select(make(F.col("t")).alias("made"), rows(F.col("t")).alias("n")).agg(F.count("made"), F.max("n")).first()
    assert got[0] == 5000 and got[1] <= 256


def test_overlapping_words_of_every_document(spark, tmp_path):
    """One row a document, those without long words or without text included; links as plain sets have them."""
    import random

    draw = random.Random(5)
    own = [f"{c}{d}aaaaaaaaa" for c in "bcdefg" for d in "hijk"]
    texts = {i: " ".join(draw.sample(own, draw.choice((0, 1, 2, 2, 3, 5, 8)))) for i in range(120)} | {200: None, 201: "", 202: "short words"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = {i: frozenset((t or "").split()) if i < 200 else frozenset() for i, t in texts.items()}
    alike = lambda x, y: x and y and len(x & y) >= 0.7 * min(len(x), len(y)) - 1e-9
    want = {(i, min(j for j in held if held[j] == x) if x else i, sum(bool(j != i and alike(x, y)) for j, y in held.items())) for i, x in held.items()}
    assert run_in(spark, "overlapping_words", tmp_path) == want and len(want) == 123


def test_page_conflicts_count_their_partners(spark):
    """By URL, by title, and by both, each once; against every pair compared."""
    import random
    from itertools import combinations

    draw = random.Random(9)
    pages = [(i, draw.choice(["", "u", "v"]), " ".join(draw.sample(["alpha", "beta1", "gamma", "delta", "omega"], draw.randrange(0, 4))), draw.choice(["paper", "paper", "topic"]), f"{draw.choice([1, 8, 10, 12, 15, 100])} stars") for i in range(70)]
    words = {i: set(t.split()) for i, _, t, _, _ in pages}
    want = {}
    for x, y in combinations([p for p in pages if p[3] != "topic"], 2):
        alike = (x[1] and x[1] == y[1]) or (words[x[0]] and words[y[0]] and len(words[x[0]] & words[y[0]]) >= 0.7 * min(len(words[x[0]]), len(words[y[0]])) - 1e-9)
        m, n = int(x[4].split()[0]), int(y[4].split()[0])
        if alike and abs(m - n) * 100 > max(m, n, 1) * 20:
            want[x[0]], want[y[0]] = want.get(x[0], 0) + 1, want.get(y[0], 0) + 1
    df = spark.createDataFrame(pages, "page_id long, url string, title string, source_type string, body string")
    assert {r["page_id"]: r["partners"] for r in mining.page_conflicts(df, mining.claims(df)).collect()} == want and len(want) > 30


def test_first_pages_of_the_keyword_graph(spark):
    """Found in batches, as the whole graph has them, however far apart they are; a graph without edges has none."""
    kw = spark.createDataFrame([(i, f"k{i}") for i in range(40)] + [(i, f"x{j}{i % 3}") for i in (17, 23, 29, 31, 37, 38, 39) for j in range(2)], "page_id long, keyword string")
    want = sorted({p for r in graph.cooccurrence(kw).collect() for p in (r["a"], r["b"])})
    assert [r[0] for r in graph.first_linked(kw, 5, batch=2).orderBy("page_id").collect()] == want[:5] and len(want) >= 5
    assert graph.first_linked(kw.where("page_id < 17"), 5, batch=2).count() == 0 and graph.first_linked(kw.limit(0), 5).count() == 0


def test_walk_query_never_builds_the_whole_graph(spark, monkeypatch):
    monkeypatch.setattr(graph, "cooccurrence", None)
    assert QUERIES["bfs_two_hop"](spark, str(DATA)).count() > 0


def test_terms_are_counted_inside_their_row(spark):
    """As a plain count, and without a shuffle."""
    import collections

    rows = [(1, "b a b c a b".split()), (2, ["x"]), (3, []), (4, None), (5, ["q"] * 300)]
    own = spark.createDataFrame(rows, "page_id long, w array<string>")
    counted = own.select("page_id", F.explode(bindings.term_counts(F.col("w"))).alias("t")).select("page_id", "t.*")
    assert {tuple(r) for r in counted.collect()} == {(i, w, n) for i, ws in rows for w, n in collections.Counter(ws or []).items()}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_insight_links_are_the_pairs_counted(spark):
    from tessera.operators import reflect

    rows = [(i, f"{['alpha', 'beta', 'gamma', ''][i % 4]} title{'ab'[i % 2] * 4}" if i % 5 else "", ["one rule about things that last", "things that last longer about rule", ""][i % 3], f"[[E{i % 6}]] [[E{i % 6}]]" if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows + [(100, None, None, None)], "insight_id long, title string, rules string, evidence string")
    want = {i: [0, 0, 0, 0] for i in [*range(60), 100]}
    for r in reflect.insight_connections(df).collect():
        for i in (r["a"], r["b"]):
            for k, on in enumerate((True, *(s in r["signals"].split(",") for s in ("evidence", "rule", "title")))):
                want[i][k] += on
    got = {r["insight_id"]: [r["n_links"], r["n_evidence"], r["n_rule"], r["n_title"]] for r in reflect.insight_links(df).collect()}
    assert got == want and want[100] == [0, 0, 0, 0] and want[1][0] > 10
