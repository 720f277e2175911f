"""Decontamination, token counts, media, language identification, toxicity: against brute force, round trips, accuracy."""
import cmath
import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, media, queries, tokens, toxicity

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(text, items):
    words = WORD.findall((text or "").translate(UPPER))
    hit, names = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(UPPER))
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1 if own else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_is_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "É"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, item(30)), (2, item(5)), (3, None), (4, ""), (5, "??!"), (12, item(20)), (6, item(13))]
    texts = [None, "", "...", items[0][1].upper() + ". " + item(40), item(3) + ", " + items[1][1], item(2000) + " " + items[5][1][10:], items[6][1], items[6][1], item(12)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, words string, starts string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.judge_documents(docs, bench, "r", block_bytes=block_bytes).select("doc_id", "words", "r.*").collect()
    assert {r[0]: tuple(r)[2:] for r in got} == {i: brute_contamination(t, items) for i, t in enumerate(texts)}
    cut = {r[0]: r[1] for r in decontamination.remove_hit_spans(docs, bench, block_bytes=block_bytes).select("doc_id", "text").collect()}
    assert all((cut[i] == t) == (brute_contamination(t, items)[1] == 0) and brute_contamination(cut[i], [])[0] == sum(brute_contamination(t, items)[k] * (1, -1)[k] for k in (0, 1)) for i, t in enumerate(texts))
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_contamination(t, items)[4]}


def test_decontamination_of_nothing(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.judge_documents(docs, bench, "r").first()["r"]["contaminated"]
    assert decontamination.judge_documents(docs.limit(0), bench, "r").count() == 0


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (7, "x y")], "item_id long, text string")
    for block_bytes in (1 << 20, 1):
        got = {r[0]: r[1] for r in decontamination.judge_documents(docs, bench, "r", block_bytes=block_bytes).select("doc_id", "r").collect()}
        assert [tuple(got[1])[:3], tuple(got[2])[:3]] == [(3, 2, 0), (2, 2, 1)] and got[1]["contaminated"]
        assert got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_remove_spans():
    assert decontamination.remove_spans("One two, three FOUR.", [(1, 3)]) == "One ,  FOUR."
    assert decontamination.remove_spans(None, []) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é日▁ \n\t😀.", max_size=400))
def test_spliced_counts_are_the_librarys(text):
    whole = tokens.counter(tokens.model_path(), 1 << 20, 64)
    for chunk, overlap in ((60, 10), (25, 5)):
        assert tokens.counter(tokens.model_path(), chunk, overlap).count(text.encode()) == len(whole.model.encode(text))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aA4+zé日本語の\u9fa5😀▁q9/", max_size=300))
def test_spliced_counts_without_spaces(text):
    model = tokens.counter(tokens.model_path(), 1 << 20, 64).model
    for chunk, overlap in ((60, 10), (25, 5)):
        assert tokens.counter(tokens.model_path(), chunk, overlap).count(text.encode()) == len(model.encode(text))


def test_token_counts_are_linear_without_spaces():
    """CJK, base64 and one letter: a few times the library's own time."""
    import time

    rng, own = random.Random(4), tokens.counter(tokens.model_path(), tokens.CHUNK_BYTES, tokens.OVERLAP_BYTES)
    base64 = string.ascii_letters + string.digits + "+/"
    for text in ("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(700_000)), "".join(rng.choice(base64) for _ in range(1_000_000)), "a" * 500_000):
        began = time.time()
        want = len(own.model.encode(text, return_type="proto").pieces)
        library, began = time.time() - began, time.time()
        assert own.count(text.encode()) == want
        assert time.time() - began <= 6 * library + 1


def test_normaliser_specification():
    message = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    flag = lambda n, x: bytes([n << 3, x])
    assert tokens.keeps_characters(message(1, b"piece") + message(3, message(1, b"identity") + flag(4, 0)))
    assert not tokens.keeps_characters(message(3, message(2, b"map") + flag(4, 0))) and not tokens.keeps_characters(message(3, flag(3, 1)))
    assert not tokens.keeps_characters(message(3, flag(4, 0) + flag(5, 0))) and not tokens.keeps_characters(b"")


def test_token_query_on_nulls_and_long_texts(spark):
    texts = [None, "", "<s> hello </s>", "no spaces" * 20000, "word " * 40000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(df.select("doc_id", tokens.token_count(F.col("text"))).collect())
    model = tokens.counter(tokens.model_path(), 1 << 16, 1 << 10).model
    assert got == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_media_round_trip(spark):
    texts = [None, "", "a" * 64, "é" * 33, "tone " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    rows = df.select("doc_id", media.media_features(F.col("text")).alias("r"), media.media_column(F.col("text")).alias("wav")).select("doc_id", "wav", "r.*").collect()
    for r in rows:
        raw = (texts[r["doc_id"] % len(texts)] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert media.from_wav(bytes(r["wav"])) == padded and r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["wav"])).hexdigest() and r["media_bytes"] == len(r["wav"])
    assert all(rows[i]["feature"] == rows[i + len(texts)]["feature"] for i in range(len(texts)))
    marks = df.select(media.fingerprint_column(media.media_column(F.col("text"))).alias("m")).collect()
    assert len(marks[4]["m"]) > 10 and len(marks[0]["m"]) == 0


def plain_fingerprint(samples):
    """By the definition: a sum for each frame and bin."""
    n = media.FRAME
    frames = max(1, -(-max(0, len(samples) - n) // media.HOP) + 1)
    padded = [float(x) for x in samples] + [0.0] * ((frames - 1) * media.HOP + n - len(samples))
    found = []
    for f in range(frames):
        x = padded[f * media.HOP : f * media.HOP + n]
        mean = sum(x) / n
        x = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * t / (n - 1))) for t, v in enumerate(x)]
        m = [round(abs(sum(v * cmath.exp(-2j * math.pi * k * t / n) for t, v in enumerate(x))), 3) for k in range(n // 2 + 1)]
        best = sorted((-m[k], k) for k in range(1, n // 2) if m[k - 1] < m[k] >= m[k + 1] and m[k] > 1)[: media.PEAKS]
        found.append([k for _, k in best])
    return sorted((f, (a << 16) | (b << 4) | d) for f in range(frames) for d in range(1, media.SPAN + 1) if f + d < frames for a in found[f] for b in found[f + d])


def test_fingerprints_are_plain_transforms(spark):
    texts = ["some words of a text " * 30, "xyz" * 200, "", "q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("doc_id", media.media_features(F.col("text")).alias("r")).select("doc_id", "r.*").collect():
        want = plain_fingerprint(media.payload(texts[r["doc_id"]].encode()))
        assert [tuple(x) for x in r["fingerprint"]] == want and r["feature"].startswith(f"{len(want)}:"), r["doc_id"]


def test_peaks_do_not_depend_on_blocks(monkeypatch):
    samples = ("abc" * 3000 + "xyz" * 2000).encode()
    whole = media.fingerprint(samples).tolist()
    monkeypatch.setattr(media, "BLOCK", 7)
    assert media.fingerprint(samples).tolist() == whole


def test_language_held_out_accuracy(spark):
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def plain_profile(texts):
    """N-grams of letters and boundaries by count, then by their characters as numbers."""
    n = Counter()
    for t in texts:
        chars = "".join(c if c.isalpha() else " " for c in f" {(t or '').lower()} ")
        chars = " " + " ".join(chars.split()) + " " if chars.split() else ""
        n.update(chars[i : i + k] for k in (1, 2, 3) for i in range(len(chars) - k + 1) if chars[i : i + k] != " ")

    def code(gram):
        out = 0
        for c in gram:
            out = (out << 21) | (1 if c == " " else ord(c))
        return out

    return sorted(n, key=lambda g: (-n[g], code(g)))[: langid.RANKS]


def test_language_is_plain_out_of_place_distance(spark):
    root = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang").collect()}
    learned = {}
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 5 and r["lang"]:
            learned.setdefault(r["lang"], []).append(r["text"])
    profiles = {lang: {g: k for k, g in enumerate(plain_profile(texts))} for lang, texts in sorted(learned.items())}
    assert len(profiles) >= 4 and max(map(len, learned.values())) <= langid.TRAINING_DOCS
    for r in queries.op4_language_id(spark, root).collect():
        own = plain_profile([rows[r["doc_id"]]["text"]])
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else langid.RANKS for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - far[best] / (langid.RANKS * len(own)))


def test_language_of_odd_texts(spark):
    labelled = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(labelled)
    assert profiles.langs == ["de", "en"]
    assert profiles.predict("und der hund")[0] == "de" and profiles.predict("the dog")[0] == "en"
    assert profiles.predict(None) == ("und", 0.0) == profiles.predict("12 !? 3") and profiles.predict("the dog " * 50000)[0] == "en"
    none = langid.fit_profiles(labelled.limit(0))
    df = spark.createDataFrame([("hi",)], "text string").select(langid.predict_language(none, F.col("text")).alias("r"))
    assert df.first()["r"]["lang_pred"] == "und"


def toxic_rows():
    rng = random.Random(1)
    fill = [f"{a}{b}" for a in ("al", "be", "co", "du") for b in ("ra", "mi", "ton", "ser", "la")]
    rows = []
    for i in range(300):
        words = [rng.choice(fill) for _ in range(40)]
        bad = i % 3 == 0
        for _ in range(1 + i % 7 if bad else 0):
            words.insert(rng.randrange(40), rng.choice(("vilest", "scumbag", "zoggerei" + rng.choice(("en", "um", "ig")))))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_finds_planted_and_leaves_clean(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (902, "alra " * 30000 + "scumbag"), (903, "alra " * 30000)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 200] + [(1, None), (3, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_severity(docs, labels)
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:]))
    judged = {r[0]: r[1] for r in docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("r")).collect()}
    assert all(judged[r[0]]["toxic"] == bool(r[2]) for r in rows)
    assert not judged[900]["toxic"] and not judged[901]["toxic"] and judged[902]["toxic"] and not judged[903]["toxic"]
    many, one = model.predict("scumbag vilest zoggereien scumbag vilest scumbag"), model.predict("alra scumbag")
    assert many[0] > one[0] > model.predict("alra")[0] and many[1] >= one[1]
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in judged.values())


def plain_loss(rows, grades, w, cuts, l2):
    """Mean of -ln P(grade), P(grade <= k) = 1 / (1 + e^(x.w - cut_k)), and the L2 term."""
    total = 0.0
    for x, g in zip(rows, grades):
        eta = sum(v * w[f] for f, v in x.items())
        upto = [0.0] + [1 / (1 + math.exp(eta - c)) for c in cuts] + [1.0]
        total -= math.log(max(upto[g + 1] - upto[g], 1e-12))
    return total / len(rows) + l2 / 2 * sum(v * v for v in w)


def test_cumulative_link_is_at_its_optimum():
    import numpy as np

    rng = random.Random(2)
    rows = [{f: 1 + rng.random() for f in range(5) if rng.random() < 0.4} for _ in range(400)]
    grades = [min(3, max(0, round(sum(v * (f - 1) for f, v in x.items()) / 3 + rng.gauss(0, 0.7)))) for x in rows]
    flat = [(i, f, v) for i, x in enumerate(rows) for f, v in x.items()]
    r, c, v = (np.array(k) for k in zip(*flat))
    w, cuts = toxicity.fit_cumulative_link(r, c, v.astype(float), np.array(grades), 5, 4, steps=4000, rate=0.02)
    assert list(cuts) == sorted(cuts)
    best = plain_loss(rows, grades, w, cuts, 1e-3)
    for k in range(5):
        for d in (-0.05, 0.05):
            assert plain_loss(rows, grades, [x + d * (i == k) for i, x in enumerate(w)], cuts, 1e-3) > best
    for k in range(3):
        for d in (-0.05, 0.05):
            assert plain_loss(rows, grades, w, [x + d * (i == k) for i, x in enumerate(cuts)], 1e-3) > best


def test_severity_is_plain_arithmetic_and_verdicts_follow_grades(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit_severity(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert len(model.thresholds) == 3
    texts = dict(r[:2] for r in rows)
    for i, r in docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("r")).collect():
        found = Counter(f for word in re.findall(r"\w+", texts[i].lower()) for f in [word, *(f"{word[:n]}*" for n in range(4, 9) if len(word) >= n)] if f in model.weights)
        eta = sum(model.weights[f] * (1 + math.log(n)) for f, n in found.items())
        above = [1 / (1 + math.exp(c - eta)) for c in model.thresholds]
        assert r["expected_severity"] == pytest.approx(sum(above)) and r["p_toxic"] == pytest.approx(above[0])
        assert r["grade"] == sum(x >= 0.5 for x in above) and r["toxic"] == (r["grade"] >= 1)


def test_grades_are_chosen_by_the_other_half():
    """A word that only one half of the sample knows gives its documents no grade."""
    import numpy as np

    toxic = np.array([1] * 40 + [0] * 40)
    half = np.arange(80) % 2
    flat = [(i, 0, 1.0 + i) for i in range(0, 40)] + [(i, 1, 50.0) for i in range(0, 40, 2)]  # feature 1: one half only
    r, c, v = (np.array(k) for k in zip(*flat))
    grades = toxicity.severity_grades(r, c, v, toxic, half, np.array([[True, True], [True, False]]))
    assert set(grades[40:]) == {0} and set(grades[:40]) == {1, 2, 3}
    for k in (0, 1):
        own = np.flatnonzero((toxic == 1) & (half == k))
        assert list(grades[own]) == sorted(grades[own])


def test_evidence_is_the_plain_choice(spark):
    """The model weighs just the features that a plain count over all rows finds."""
    rows = toxic_rows()
    model = toxicity.fit_severity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    n = Counter(r[2] for r in rows)
    seen = {0: Counter(), 1: Counter()}
    for _, text, bad in rows:
        seen[bad].update({f for word in re.findall(r"\w+", text.lower()) for f in [word, *(f"{word[:k]}*" for k in range(4, 9) if len(word) >= k)]})
    odds = lambda f: math.log((seen[1][f] + 0.5) / (n[1] - seen[1][f] + 0.5)) - math.log((seen[0][f] + 0.5) / (n[0] - seen[0][f] + 0.5))
    assert set(model.weights) == {f for f, k in seen[1].items() if k >= toxicity.least_docs(n[1]) and odds(f) >= toxicity.MIN_LOG_ODDS}


def test_sample_is_bounded_by_words():
    bags = [(7, 30, 0), (3, 30, 1), (5, 30, 0)]
    assert list(toxicity._bounded(iter(bags), 60)) == bags[:2] and list(toxicity._bounded(iter(bags), 5)) == bags[:1]


def test_toxicity_without_classes(spark):
    docs, labels = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.remove_toxic(docs, labels).count() == 1
    assert toxicity.remove_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.SeverityModel({}, __import__("numpy").zeros(0)).predict("x") == (0.0, 0, 0.0, False)
