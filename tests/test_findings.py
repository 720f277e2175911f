"""What the third round's findings asked for: work and memory that grow no faster than the input."""
import random
import threading
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.functions import frontmatter, ship
from tessera.operators import graph, lexical_index, mining, quality
from tessera.plans import vault_queries  # noqa: F401 (registers its queries)
from tessera.plans.queries import QUERIES

from .conftest import DATA


def test_front_matter_goes_to_python_without_bodies_and_once(spark):
    texts = [None, "", "---", "--- \n---", "---\n---\nx", "---\ntitle: a\n---\n 　\x1c body \x85\n--- y  ", "plain\n---\nx", "---\nk:\n- é\n----\nb\n---", "---\nnever closed", "\n---\na: b\n---\nc", "---\r\na: b\r\n---\r\nc\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, c string")
    for flavour in frontmatter.FLAVOURS:
        got = df.select("i", frontmatter.front_matter(F.col("c"), flavour).alias("fm")).collect()
        assert {r["i"]: (r["fm"]["values"], r["fm"]["lists"], r["fm"]["body"], r["fm"]["found"]) for r in got} == {i: frontmatter.parse(t, flavour) for i, t in enumerate(texts)}
    for name in ("front_matter_lint", "front_matter_lists_lint"):
        plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_batches_are_small_in_a_thread_of_its_own(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    thread = threading.Thread(target=lambda: frontmatter.front_matter(F.col("c")))
    thread.start()
    thread.join()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(ship.BATCH_ROWS)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_keyword_links_are_counted_as_pairs_would_be_and_none_is_listed(spark, least, monkeypatch):
    draw = random.Random(least)
    held = {i: {f"k{int(draw.paretovariate(0.7)) % 25}" for _ in range(draw.randrange(1, 8))} for i in range(70)}
    held |= {i: held[i - 70] for i in range(70, 90)}
    kw = spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "page_id long, keyword string")
    links, shared = Counter(), Counter()
    for a, b in combinations(held, 2):
        n = len(held[a] & held[b])
        for p in (a, b) if n >= least else ():
            links[p] += 1
            shared[p] += n
    want = {(i, min(j for j in held if held[j] == held[i]), links[i], shared[i]) for i in held}
    monkeypatch.setattr(graph, "_met", None)
    assert {tuple(r) for r in graph.cooccurrence_links(kw, least).collect()} == want


def test_keyword_queries_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "cooccurrence", None)
    for name in ("cooccurrence_edges", "weighted_graph"):
        assert QUERIES[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("hot", [1, 4, 10**6])
def test_communities_of_keywords_are_those_of_the_listed_edges(spark, hot):
    draw = random.Random(hot)
    held = {i: {f"k{int(draw.paretovariate(0.7)) % 40}" for _ in range(draw.randrange(1, 9))} for i in range(150)}
    held |= {i: held[i - 150] for i in range(150, 170)}
    kw = spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "page_id long, keyword string")
    listed = graph.cooccurrence(kw).select("a", "b", F.col("shared").cast("double").alias("weight"))
    want = {tuple(r) for r in graph.communities(listed, rounds=3, levels=2).collect()}
    assert len(want) > 100
    assert {tuple(r) for r in graph.keyword_communities(kw, rounds=3, levels=2, hot=hot).collect()} == want
    assert graph.keyword_communities(kw.where("keyword = 'k1'"), hot=hot).isEmpty()


def test_communities_list_no_pairs_of_pages_of_a_large_group(spark, monkeypatch):
    n = 3000
    kw = spark.range(n).selectExpr("id AS page_id", "explode(array('a', 'b', concat('c', id % 1000), concat('d', id))) AS keyword")
    rows, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rows.append((out := write(df, name)).count()) or out)
    assert graph.keyword_communities(kw, rounds=2, levels=1).count() > n // 2
    assert max(rows) < 10 * n


def test_see_also_of_some_pages_ties_included(spark):
    held = {i: {f"k{(i * j) % 11}" for j in (1, 2, 3, 5)} for i in range(60)}
    kw = spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "page_id long, keyword string")
    titles = {i: f"t{i % 7}" for i in held}
    pages = spark.createDataFrame(list(titles.items()), "page_id long, title string")
    near = {i: sorted(((-len(held[i] & held[j]), titles[j], j) for j in held if j != i and len(held[i] & held[j]) >= 2))[:5] for i in held}
    want = lambda of: {(i, j, -n, place) for i in of for place, (n, _, j) in enumerate(near[i], 1)}
    shown = lambda df: {tuple(r) for r in df.select("page_id", "other_id", "shared", "place").collect()}
    assert shown(mining.see_also(kw, pages, queries=pages.where("page_id % 10 = 0"))) == want(range(0, 60, 10))
    assert shown(mining.see_also(kw, pages)) == want(held)


def test_pages_of_one_title_make_no_pairs(spark):
    n = 20_000
    pages = spark.range(n).select(F.concat(F.when(F.col("id") % 2 == 0, "x").otherwise("w"), F.col("id").cast("string")).alias("rel_path"), F.when(F.col("id") % 2 == 0, "X: A").otherwise("Web: a!").alias("title"), F.lit("b").alias("body"))
    found = quality.same_title_pairs(pages)
    assert found.count() == n and {r[0] for r in found.select("detail").distinct().collect()} == {f"w1 {n // 2}"}
    lone = spark.createDataFrame([("x", "X: A", "b"), ("y", "X: B", "b" * 2000), ("w", "Web: B", "b")], "rel_path string, title string, body string")
    assert quality.same_title_pairs(lone).count() == 0


def test_postings_of_pages_are_counted_without_a_shuffle(spark):
    pages = spark.createDataFrame([(1, "A b a, B! a"), (2, None), (3, ""), (4, "12 ?")], "page_id long, body string")
    one = lexical_index.postings(pages, {"body": 2.0}, once=True)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in lexical_index.postings(pages, {"body": 2.0}).collect()} == {(1, "a", 6.0), (1, "b", 4.0)}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("parts_of", [12, 4])
def test_first_overlapping_as_all_links_give_it(spark, parts_of, monkeypatch):
    """With parts of all lists, and with pairs where a list is longer than parts are made of."""
    draw = random.Random(parts_of)
    held = {i: sorted({f"w{int(draw.paretovariate(0.5)) % 30}" for _ in range(draw.randrange(3, 10))}) for i in range(150)}
    held = {i: ws for i, ws in held.items() if len(ws) >= 3}
    own = spark.createDataFrame(list(held.items()), "page_id long, words array<string>")
    linked = lambda a, b: 10 * len({*held[a]} & {*held[b]}) >= 6 * min(len(held[a]), len(held[b]))
    monkeypatch.setattr(mining, "PARTS_OF", parts_of)
    want = {(i, min(j for j in held if linked(i, j))) for i in held}
    assert {tuple(r) for r in mining.first_overlapping(own, 0.6, 3).collect()} == want and 10 < sum(i != j for i, j in want)


def test_titles_of_shared_words_list_no_pairs(spark, monkeypatch):
    """Each of 20,000 titles shares three of four words with all others: no pairs, and the first page is found."""
    monkeypatch.setattr(mining, "_links", None)
    own = spark.range(20_000).select(F.col("id").alias("page_id"), F.array(F.lit("one"), F.lit("two"), F.lit("three"), F.concat(F.lit("own"), (F.col("id") % 10_000).cast("string"))).alias("words"))
    assert mining.first_overlapping(own, 0.6, 3).groupBy("match_id").count().collect() == [(0, 20_000)]


def test_paragraphs_that_begin_alike_do_not_meet_and_long_ones_inside_are_found(spark, monkeypatch):
    """Texts of no pair are fetched but of those where one may be inside the other."""
    draw = random.Random(1)
    letters = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    start = "x" + letters(300)
    alike = [start + letters(400) + "x" for _ in range(60)]
    short = alike[1][20:90] + "y"
    paragraphs = [*alike, alike[0][100:550], "z" + alike[0] + "z", short, "q" + short, "tiny", ""]
    kept, made = [], mining.materialise
    monkeypatch.setattr(mining, "materialise", lambda df, name: kept.append((name, made(df, name))) or kept[-1][1])
    got = mining._inside_paragraphs(spark.createDataFrame([(p,) for p in paragraphs + paragraphs[:9]], "p string"))
    code = {r["t"]: r["p"] for r in spark.createDataFrame([(p,) for p in paragraphs], "p string").select("p", F.xxhash64("p").alias("t")).collect()}
    want = {(x, y) for x in paragraphs for y in paragraphs if len(x) >= 50 and x != y and x in y}
    assert {(code[a], code[b]) for a, b in got.collect()} == want and len(want) == 4
    assert dict(kept)["paragraphs-met"].count() < 200  # of 60 * 59 pairs that begin alike none
