"""The pipeline against a plain version of its stages, and the registry."""
import importlib
import random

from pyspark.sql import functions as F

from .test_corpus_operators import brute_groups, brute_targets
from .test_text_operators import brute_contamination


def make_tables(spark, root):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows, labels = [], []
    items = [(k, " ".join(word() for _ in range(30))) for k in range(4)]
    for i in range(260):
        words = [word() for _ in range(rng.randrange(5, 70))]
        if i % 4 == 0:
            words.insert(3, rng.choice(("vilest", "scumbag", "wretch")))
        labels.append((i, int(i % 4 == 0), 1))
        text = " ".join(words)
        if i % 17 == 5:
            text += " " + items[i % 4][1]
        rows.append((i, text, "en", f"s{i % 5}" if i % 6 else None, len(text)))
    rows += [(300 + i, rows[4 * i + 1][1], "en", "s1", 5) for i in range(15)] + [(400, None, None, None, None), (401, "", "en", "s2", 0), (402, rows[2][1] + " extra", "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return rows, items


def test_pipeline_is_its_plain_version(spark, tmp_path):
    import corpus_pipeline

    root = str(tmp_path)
    rows, items = make_tables(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, frames = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, root)
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns), name
        docs.write.parquet(f"{root}/out-{name}")
        docs = spark.read.parquet(f"{root}/out-{name}")
        frames.append(docs.collect())
    toxic = {"vilest", "scumbag", "wretch"}
    clean = [r for r in rows if not toxic & set((r[1] or "").split())]
    assert sorted(r["doc_id"] for r in frames[0]) == sorted(r[0] for r in clean)
    groups, _ = brute_groups([r[:2] for r in clean], 5)
    left = [r for r in clean if groups[r[0]] == r[0]]
    assert sorted(r["doc_id"] for r in frames[1]) == sorted(r[0] for r in left)
    pure = [r for r in left if not brute_contamination(r[1], items)[4]]
    assert 0 < len(pure) < len(left) < len(clean) < len(rows)
    assert sorted(r["doc_id"] for r in frames[2]) == sorted(r[0] for r in pure)
    sizes, taken = {}, {}
    for r in pure:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    for r in frames[3]:
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").split())
    target = brute_targets(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= 100 for s in sizes)
    assert len(frames[4]) == len(frames[3])
    held, homes = {}, {}
    for r in frames[4]:
        held[r["shard"]] = held.get(r["shard"], 0) + len((r["text"] or "").encode()) + 1
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values()) and len(held) == 16 and max(held.values()) - min(held.values()) <= 700
    again = corpus_pipeline.run(spark, root)
    assert sorted((r["doc_id"], r["shard"]) for r in again.collect()) == sorted((r["doc_id"], r["shard"]) for r in frames[4])


def test_registry_has_all_corpus_queries():
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 13)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_operators_take_whole_tables(spark):
    entry = importlib.import_module("__spark_entry__")
    root = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{root}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op1_toxicity", "op3_pii", "op6_sharding", "op8_url_filter"):
        df = entry.queries()[name](spark, root)
        assert df.count() == n["pages" if name.startswith("op8") else "documents"] == df.select(F.col(df.columns[0])).distinct().count(), name
