"""What the fourth round's findings asked for: keyword queries whose work does not grow with the square of a group."""
import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, mining, retrieval, terms


def held_by(seed: int, n: int = 90, kinds: int = 25, most: int = 8) -> dict[int, set[str]]:
    draw = random.Random(seed)
    held = {i: {f"k{int(draw.paretovariate(0.7)) % kinds}" for _ in range(draw.randrange(1, most))} for i in range(n)}
    return held | {i: held[i - n] for i in range(n, n + 20)}


def table_of(spark, held):
    return spark.createDataFrame([(i, k) for i, ks in held.items() for k in ks], "page_id long, keyword string")


@pytest.mark.parametrize("sent", [4_000_000, 40, 3, 0])
def test_best_terms_however_few_are_sent(spark, sent):
    """Every number of pages sent, or some, or none: the rest is looked up. Terms of one score are in the words' order."""
    draw = random.Random(3)
    texts = {i: [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(draw.randrange(0, 60))] for i in range(24)} | {80: None, 81: [], 82: ["w0"]}
    pages = spark.createDataFrame(list(texts.items()), "page_id long, w array<string>")
    df = Counter(w for ws in texts.values() for w in {*(ws or ())})
    want = set()
    for i, ws in texts.items():
        scored = sorted((-round(m * math.log(len(texts) / df[w]), 6), w) for w, m in Counter(ws or ()).items())
        want |= {(i, w, -s, r) for r, (s, w) in enumerate(scored[:5], 1)}
    best = terms.best_terms(pages, F.col("w"), 5, sent)
    assert {tuple(r) for r in best.collect()} == want and len(want) > 300


def test_terms_are_not_dealt_by_page(spark, monkeypatch):
    """Of 200 terms of each page no more are written than may be among its best."""
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), (F.col("id") * (i + 7) % 5000).cast("string"))).alias("w"))
    rows, write = [], terms.materialise
    monkeypatch.setattr(terms, "materialise", lambda df, name: rows.append((name, (out := write(df, name)).count())) or out)
    assert terms.best_terms(pages, F.col("w")).count() == 500 * 10 - 9  # page 0 has one term, w0
    assert [name for name, _ in rows] == ["terms"]


@pytest.mark.parametrize("hot", [1, 4, 10**6])
def test_see_also_as_all_pairs_give_it(spark, hot, monkeypatch):
    monkeypatch.setattr(graph, "HOT_PAIR_PAGES", hot)
    held = held_by(hot)
    titles = {i: f"t{i % 7}" for i in held}
    pages = spark.createDataFrame(list(titles.items()), "page_id long, title string")
    near = {i: sorted((-len(held[i] & held[j]), titles[j], j) for j in held if j != i and len(held[i] & held[j]) >= 2)[:5] for i in held}
    got = mining.see_also(table_of(spark, held), pages, queries=pages.where("page_id % 10 = 0"))
    want = {(i, j, -n, place) for i in range(0, len(held), 10) for place, (n, _, j) in enumerate(near[i], 1)}
    assert {tuple(r) for r in got.select("page_id", "other_id", "shared", "place").collect()} == want and len(want) > 20


def test_see_also_does_not_meet_all_pages_of_a_frequent_pair(spark):
    """Each of 400 queries shares two keywords with all 20,000 pages."""
    n = 20_000
    kw = spark.range(n).selectExpr("id AS page_id", "explode(array('a', 'b', concat('c', id % 100), concat('d', id))) AS keyword")
    pages = spark.range(n).selectExpr("id AS page_id", "concat('t', id % 9) AS title")
    found = graph.nearest_by_keywords(kw, pages, pages.where("page_id % 50 = 0"), 5)
    # the 200 pages of a query's rarer pairs, and six of the frequent pair's
    assert found.count() <= 400 * (200 + 6) and found.select("page_id").distinct().count() == 400


@pytest.mark.parametrize("hot", [1, 4, 10**6])
def test_counted_walk_as_the_listed_edges_give_it(spark, hot):
    kw = table_of(spark, held_by(hot, 120, 60, 6))
    edges = graph.cooccurrence(kw).selectExpr("a AS source_id", "b AS target_id", "1.0D AS weight")
    for seeds in ([(1, 1), (5, 2), (9, 3)], [(9, 1)], [(999, 1)]):
        start = spark.createDataFrame(seeds, "page_id long, place int")
        want = {r["page_id"]: round(r["score"], 9) for r in retrieval.graph_signal(edges, start).collect()}
        assert {r["page_id"]: round(r["score"], 9) for r in graph.keyword_walk(kw, start, hot=hot).collect()} == want and (len(want) > 20 or len(seeds) == 1)


def test_walk_lists_no_edges_of_a_frequent_pair(spark, monkeypatch):
    """6,000 pages are all linked with each other: each is reached from the seed once, and from the 5,998 others."""
    n = 6000
    kw = spark.range(n).selectExpr("id AS page_id", "explode(array('a', 'b', concat('c', id % 100), concat('d', id))) AS keyword")
    rows, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rows.append((out := write(df, name)).count()) or out)
    monkeypatch.setattr(graph, "cooccurrence_near", None)
    got = graph.keyword_walk(kw, spark.createDataFrame([(0, 1)], "page_id long, place int")).groupBy("score").count().collect()
    assert [tuple(r) for r in got] == [(0.5 + 0.25 * (n - 2), n - 1)] and max(rows) < 6 * n


def test_communities_end_at_rest(spark):
    """No two communities would be better as one."""
    held = held_by(11, 60, 60, 6)
    of = {r["node"]: r["community"] for r in graph.keyword_communities(table_of(spark, held), hot=4).collect()}
    weights = {(a, b): len(held[a] & held[b]) for a, b in combinations(held, 2) if len(held[a] & held[b]) > 1}
    total, degree, between = 2 * sum(weights.values()), Counter(), Counter()
    for (a, b), w in weights.items():
        degree[of.get(a, a)] += w
        degree[of.get(b, b)] += w
        between[of.get(a, a), of.get(b, b)] += w
        between[of.get(b, b), of.get(a, a)] += w
    assert len(degree) > 3 and all(between[x, y] - degree[x] * degree[y] / total < 1e-6 for x in degree for y in degree if x != y)


def test_rounds_without_limit_do_not_go_in_circles(spark):
    """Pairs of nodes that would swap for ever if both moved at a time."""
    edges = spark.range(12).selectExpr("2 * id AS a", "2 * id + 1 AS b", "1.0D AS weight")
    found = graph.communities(edges, rounds=None, levels=None)
    assert {tuple(r) for r in found.collect()} == {(i, i - i % 2, 2) for i in range(24)}
