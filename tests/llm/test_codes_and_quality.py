"""Vector codes against a plain version and their SQL; the rule ensemble's parts, its compiled score, and held-out accuracy."""
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codebooks, quality


def plain(rows, entries, rounds):
    """rows: (id, vector). Codes and errors by id, and the digest, in Python integers."""
    whole = sorted((i, [math.floor(1024 * x) for x in v]) for i, v in rows)
    n = len(whole[0][1]) // 4
    books = [[v[p * n : p * n + n] for _, v in whole[:entries]] for p in range(4)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned(p):
        return [min(range(len(books[p])), key=lambda k: (gap(v[p * n : p * n + n], books[p][k]), k)) for _, v in whole]

    for _ in range(rounds):
        for p in range(4):
            of = assigned(p)
            moved = []
            for k, entry in enumerate(books[p]):
                own = [v[p * n : p * n + n] for (_, v), a in zip(whole, of, strict=True) if a == k]
                moved.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else entry)
            books[p] = moved
    codes = list(zip(*(assigned(p) for p in range(4)), strict=True))
    out = {i: ("".join(f"{k:02x}" for k in code), sum(gap(v[p * n : p * n + n], books[p][code[p]]) for p in range(4))) for (i, v), code in zip(whole, codes, strict=True)}
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("reach", [1.0, 1e4, 1e7])
def test_codes_are_the_plain_ones(spark, reach):
    """Components of 1e7 leave int64 in their products, so the batch goes on in Python integers; errors end at the largest long."""
    draw = random.Random(int(reach))
    rows = [(i, [draw.choice([draw.uniform(-reach, reach), 0.0, 0.5]) for _ in range(8)]) for i in range(60)]
    labels = {i: draw.choice([None, 1, 2]) for i, _ in rows}
    df = spark.createDataFrame([(i, v, labels[i]) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(5)
    got = codebooks.compress(df, entries=9, rounds=3).collect()
    want, digest = plain(rows, 9, 3)
    held = lambda e: min(e, codebooks.LONGEST)
    want = {i: (code, held(e)) for i, (code, e) in want.items()}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {digest}
    assert all(r["label_error"] == held(sum(e for i, (_, e) in want.items() if labels[i] == labels[r["vec_id"]])) for r in got)


def test_codes_are_their_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{path}')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(con.sql(f"select {', '.join(names)} from ({codebooks.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in codebooks.compress(spark.read.parquet(path)).select(*names).collect()) == want


def test_integers_and_distances_at_the_ends_of_long():
    assert codebooks.integers(np.array([-0.0001, 0.9999, 1e300, -1e300, 2.0**52])).tolist() == [-1, 1023, codebooks.MOST, -codebooks.MOST, 1 << 62]
    x, books = np.array([[1 << 62, 0]]), np.array([[-(1 << 62), 0], [1 << 61, 0], [1 << 61, 0]])
    best, far = codebooks.nearest(x, books)
    assert best.tolist() == [1] and far.tolist() == [1 << 122]


def test_statistics(spark):
    texts = ["", None, "Ab ab AB!", "x\nx\ny z%% 12.\n", "É " * 30000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(quality.statistics(F.col("t")).alias("s")).collect()
    empty, null, one, two, long = (r["s"].asDict() for r in rows)
    assert empty == null and set(empty.values()) == {0.0}
    assert one["log_words"] == pytest.approx(math.log1p(3)) and one["capital_share"] == 3 / 6 and one["vocabulary_share"] == 1 and one["calls_a_word"] == 1 / 3
    assert two["different_line_share"] == 2 / 3 and two["symbols_a_word"] == 2 / 5 and two["digit_share"] == 2 / 14 and two["ends_a_word"] == 1 / 5
    assert long["capital_share"] == 1 and long["vocabulary_share"] == 1 / 30000


def test_trees_find_a_conjunction_and_equal_rules_are_one():
    draw = np.random.default_rng(1)
    x = draw.random((600, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.4)).astype(float)
    names = ["a", "b", "c", "d"]
    model = quality.fit_rules(x, y, names)
    heaviest = max(model.rules, key=lambda r: r[1])[0]
    assert {(t.statistic, t.above) for t in heaviest} >= {("a", True), ("c", False)} and all(abs(t.cut - (0.5 if t.statistic == "a" else 0.4)) < 0.1 for t in heaviest if t.statistic in "ac")
    assert quality.fit_rules(x, y, names) == model
    t = quality.Test
    assert quality.shortest((t("a", 1.0, True), t("a", 2.0, True), t("a", 9.0, False), t("a", 5.0, False))) == (t("a", 2.0, True), t("a", 5.0, False))
    rules = quality.rules_of(x, y, names)
    rows = {np.packbits(quality.holds(r, x, names) == quality.holds(r, x, names)[0]).tobytes() for r in rules}
    assert len(rows) == len(rules) and all(len(r) <= quality.DEPTH for r in rules)


def test_lasso_is_at_its_optimum():
    """No weight can move: the slope is the penalty where a weight is, and no more than it elsewhere."""
    draw = np.random.default_rng(2)
    h = (draw.random((300, 12)) < 0.4).astype(float)
    y = (draw.random(300) < 1 / (1 + np.exp(1 - 3 * h[:, 0] + 2 * h[:, 3]))).astype(float)
    penalty = 0.02
    (b, w), = quality.lasso(h, y, [penalty], steps=5000)
    slope = (h * (y - 1 / (1 + np.exp(-(h @ w + b))))[:, None]).mean(axis=0) / h.std(axis=0)
    slope -= h.mean(axis=0) / h.std(axis=0) * (y - 1 / (1 + np.exp(-(h @ w + b)))).mean()
    assert 0 < (w == 0).sum() < 12 and np.all(np.abs(slope) <= penalty + 1e-3) and np.allclose(slope[w != 0], penalty * np.sign(w[w != 0]), atol=1e-3)


def test_compiled_score_is_the_rules_sum(spark):
    t = quality.Test
    model = quality.RuleModel(-0.5, (((t("a", 1.0, True),), 2.0), ((t("a", 3.0, False), t("b", 0.0, True)), -1.0)))
    rows = [(float(a), float(b)) for a in range(5) for b in (-1, 0, 1)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", model.score(F.struct("a", "b")).alias("s")).collect()
    for r in got:
        odds = -0.5 + 2 * (r["a"] > 1) - (r["a"] <= 3 and r["b"] > 0)
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-odds)))
    assert model.told()[0] == "+2.000 if a > 1"


def test_one_class_and_no_labels(spark):
    assert quality.fit_rules(np.zeros((0, 2)), np.zeros(0), ["a", "b"]) == quality.RuleModel(0.0)
    assert quality.fit_rules(np.ones((8, 2)), np.ones(8), ["a", "b"]).bias == pytest.approx(math.log(9))


def test_held_out_accuracy(spark):
    """Rows that no rule was learned from: the low-quality ones of sf0.01 are found and the others left alone."""
    queries = pytest.importorskip("tessera.llm.queries")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op12_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    low, high = [r for r in rows if r["quality"] == 0], [r for r in rows if r["quality"] == 1]
    assert len(rows) > 100 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == 0 for r in low) >= 0.9 * len(low) and sum(r["predicted"] == 1 for r in high) >= 0.98 * len(high)


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = quality.RuleModel(0.0, (((quality.Test("log_words", 1.0, True),), 1.0),))
    plan = docs.select(quality.quality(model, F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
