"""Near-duplicates, sharding, mixing, URL filters, personal data: against brute force."""
import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, neardup, pii, sharding, urlfilter

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_groups(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    passage = [word() for _ in range(60)]
    for g in range(6):
        base = [word() for _ in range(90)]
        for c in range(14):  # altered copies: close to the base, less so to each other
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4))):
                own[rng.randrange(90)] = word()
            rows.append((i := i + 1, " ".join(own)))
    for _ in range(40):
        rows.append((i := i + 1, " ".join([word() for _ in range(80)] + passage)))
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \n"), (i + 4, "two words"), (i + 5, "TWO  words"), (i + 6, "two"), (i + 7, rows[0][1].upper()), (i + 8, "long " + " ".join(word() for _ in range(30000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, set_bytes", [(512, 2 << 20), (5, 4000)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, block, set_bytes):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SET_BYTES", set_bytes)
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, n long, node long").repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, shingle=4).collect()}
    groups, sizes = brute_groups(rows, 4)
    assert {i: r["component_id"] for i, r in got.items()} == groups and {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == groups[i]) for i, r in got.items())


def test_ways_for_many_groups_and_hot_texts(spark, monkeypatch):
    """Joins beyond the broadcast bound, and texts with so many copies that their group is broadcast."""
    from tessera.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    rows = [(i, t) for i, t in near_rows() if i < 60]
    rows += [(1000 + k, rows[0][1]) for k in range(5)] + [(2000, rows[1][1]), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups, _ = brute_groups(rows, 5)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == groups
    assert sorted(r[0] for r in neardup.one_of_each_group(docs).collect()) == sorted(set(groups.values()))


def template_rows(n, alike=0.7):
    """Pages of one template whose sets of 4-word shingles have about that similarity, and close copies of a few of them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    template = [word() for _ in range(120)]
    own = round(120 * (1 - alike) / (2 * alike))
    rows = [(i, " ".join(template + [word() for _ in range(own)])) for i in range(n)]
    return rows + [(n + i, rows[7 * i][1] + " " + word()) for i in range(5)]


def test_pages_of_one_template(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = template_rows(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    groups, _ = brute_groups(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, shingle=4).collect()} == groups
    assert sum(i != g for i, g in groups.items()) == 5


def test_rows_go_by_row_not_by_id(spark):
    """Ids that repeat on unlike texts, and null ids."""
    a, u, b, c, q = ("some words " + " ".join(f"{x}{k}" for k in range(40)) for x in "aubcq")
    rows = [(1, a), (6, a), (6, u), (7, b), (7, c), (None, a), (None, q), (None, q), (8, ""), (8, "")]
    docs = spark.createDataFrame([(*r, {"m": 1}) for r in rows], "doc_id long, text string, gone_row map<string, int>").repartition(3)
    left = neardup.one_of_each_group(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("1", a), ("6", u), ("7", b), ("7", c), ("None", q), ("8", ""), ("8", "")])
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([("1", "1", True), ("6", "1", False), ("6", "6", True), ("7", "7", True), ("7", "7", True), ("None", "1", False), ("None", "None", True), ("None", "None", True), ("8", "8", True), ("8", "8", True)])


def test_one_of_each_group_stays(spark):
    rows = near_rows()[:60]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("kept", F.lit("mine"))
    left = neardup.one_of_each_group(docs)
    groups, _ = brute_groups(rows, 5)
    assert left.columns == docs.columns and sorted(r[0] for r in left.collect()) == sorted(set(groups.values()))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_odd_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(1))
    base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for j in (0.9, 0.8):
        n = int(1000 * 2 * (1 - j) / (1 + j) / 2)
        other = np.unique(np.concatenate([base[n:], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
        a, b = (np.array(neardup.sketch(np.unique(s))[1], np.int64).view(np.uint64) for s in (base, other))
        c = int(np.bitwise_count(a ^ b).sum())
        assert abs(1 + neardup.BITS / (4 * 180) * np.log(1 - 2 * c / neardup.BITS) - j) < 0.12


def test_sharding_is_even_whole_and_gapless(spark):
    rng = random.Random(2)
    texts = [None, None, "", "hot"] + ["x" * rng.randrange(1, 3000) for _ in range(400)] + ["hot"] * 150 + ["é" * 5]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, "hot", 7)], "doc_id long, text string, shard int")
    rows = sharding.shard_rows(docs.drop("shard")).collect()
    assert len(rows) == len(texts) + 1
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert set(size) <= set(range(16)) and max(size.values()) - min(size.values()) <= 50
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    wide = sharding.sharded_documents(docs.drop("shard"))
    assert wide.columns == ["doc_id", "text", "shard"] and wide.count() == len(texts) + 1
    assert sharding.shard_rows(docs.drop("shard").limit(0)).count() == 0


def test_differencing_in_rounds(spark):
    rng = random.Random(4)
    groups = spark.createDataFrame([(i, 1, rng.randrange(1, 1000)) for i in range(3000)], "g1 long, g2 long, bytes long")
    homes = sharding.assign_groups(groups, 16, bucket_groups=50, fan_in=4)
    sums = [r[0] for r in homes.join(groups, ["g1", "g2"]).groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert homes.count() == 3000 and len(sums) == 16 and max(sums) - min(sums) <= 200  # a fifth of the largest group


def plain_differencing(parts, shards):
    """Repeatedly the two of the largest spread (then the earlier), oppositely ordered; places are counted after sorting by sum, then place."""
    held = [[k, sorted(((x, [(k, i)] if x else []) for i, x in enumerate(p)), key=lambda y: -y[0])] for k, p in enumerate(parts)]
    made = len(parts)
    while len(held) > 1:
        held.sort(key=lambda h: (h[1][-1][0] - h[1][0][0], h[0]))
        (_, a), (_, b) = held[:2]
        joined = [(x + y, own + theirs) for (x, own), (y, theirs) in zip(a, b[::-1])]
        made += 1
        held = held[2:] + [[made, sorted(joined, key=lambda y: -y[0])]]
    return [x for x, _ in held[0][1]], [set(own) for _, own in held[0][1]]


def test_difference_is_plain_differencing():
    rng = random.Random(11)
    for shards, parts in ((2, [(8, 0), (7, 0), (6, 0), (5, 0), (4, 0)]), (3, [(rng.randrange(1, 99), 0, 0) for _ in range(60)]), (4, [tuple(rng.randrange(50) for _ in range(4)) for _ in range(40)])):
        sums, places = sharding.difference(parts, shards)
        want, members = plain_differencing(parts, shards)
        assert list(sums) == want
        for k, own in enumerate(places):
            assert all(not x or (k, i) in members[own[i]] for i, x in enumerate(parts[k]))
    assert sharding.difference([(8, 0), (7, 0), (6, 0), (5, 0), (4, 0)], 2)[0] == (16, 14)  # the textbook's example


def test_difference_keeps_sums():
    parts = [(5, 3, 0), (8, 1, 1), (0, 0, 9), (2, 2, 2)]
    sums, places = sharding.difference(parts, 3)
    total = [0, 0, 0]
    for part, own in zip(parts, places):
        assert sorted(own) == [0, 1, 2]
        for value, place in zip(part, own):
            total[place] += value
    assert tuple(total) == sums == (13, 12, 8)  # as by hand: 9 and 8 1 1 give 10 8 1; with 5 3 0, 10 11 6; with 2 2 2, this


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "c", None, "tiny"] if i % 9 else ["a"])) for i in range(900)]
    rows = [(i, t, "b" if s == "tiny" and i % 8 else s) for i, t, s in rows] + [(901, None, "a"), (902, "", None), (903, " \t", "zero"), (904, "x y", "d")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, source string, size string").repartition(3)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert got == {r["doc_id"]: r for r in mixing.mix(docs.repartition(2)).collect()} and len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        n = len((t or "").split())
        assert got[i]["size"] == n and got[i]["taken"] <= 3 * n and (not n or got[i]["taken"] % n == 0)
        sizes[s] += n
        taken[s] += got[i]["taken"]
    target = brute_targets(sizes)
    for i, t, s in rows:
        assert got[i]["source_size"] == sizes[s] and got[i]["target"] == pytest.approx(target[s])
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes)
    copies = Counter(r[0] for r in mixing.mixed_documents(docs).collect())
    assert all(copies[i] * got[i]["size"] == got[i]["taken"] for i in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_orders_sources_by_ranges(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), f"host{rng.randrange(120):03}" if i % 11 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "SOURCES_AT_ONCE", 10)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = brute_targets(sizes)
    assert all(got[i]["target"] == pytest.approx(target[s]) for i, _, s in rows)
    assert all(got[i]["taken"] == want[i]["taken"] for i in got)


def test_columns_pass_through(spark):
    """Columns named as the operators' own ones were, or would be."""
    names = ["copies", "threshold", "b_source", "_hash", "_words", "_times", "of", "again", "below", "key", "size", "times", "g1", "g2", "h1", "_g1", "SEVERITY", "severity_"]
    docs = spark.createDataFrame([(i, "word " * (i + 1), "s", *(f"{n}{i}" for n in names)) for i in range(6)], ["doc_id", "text", "source", *names])
    mixed = mixing.mixed_documents(docs)
    sharded = sharding.sharded_documents(docs)
    assert mixed.columns == docs.columns and sharded.columns == [*docs.columns, "shard"]
    for df in (mixed, sharded):
        rows = df.collect()
        assert {r["doc_id"] for r in rows} == set(range(6)) and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.ORG:80/en/1?x#y": ("a.example.org:80", "/en/1", None), "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"), "https://m.example.org/es/1": ("m.example.org", "/es/1", "example.org/es/"),
        "x://a.org/": ("a.org", "/", "org/"), "x://a.org": ("a.org", "", None), "http://b.com/fr/2": ("b.com", "/fr/2", "com/fr/"), "http://b.com/de/": ("b.com", "/de/", "com/de/"), "http://borg/": ("borg", "/", None),
        "nothing": ("", "", None), None: ("", "", None), "": ("", "", None), "a://b?c://d/e": ("b", "", None), "http://É.org/É\n/x": ("É.org", "/É\n/x", "org/"), "http://u#f/g": ("u", "", None),
    }
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id long, url string, text string")
    got = {r["page_id"]: r for r in urlfilter.judge_urls(pages).collect()}
    for i, (u, (host, path, rule)) in enumerate(cases.items()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == dict(urlfilter.RULES)[rule]
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def test_url_models_are_brute_force_and_learn(spark):
    urls = [f"http://news{i % 9}.org/story/{i}" for i in range(120)] + [f"http://bet{i % 7}.com/de/win-{i}" for i in range(120)] + ["http://zz.net/story/9", "http://zz.net/win-9"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["url"]: r for r in urlfilter.judge_urls(pages).collect()}
    assert got["http://zz.net/story/9"]["verdict"] == "allow" and got["http://zz.net/win-9"]["verdict"] == "block"
    judged = [(u, "allow" if ".org/" in u else "block") for u in ("http://a.org/x1", "http://b.org/yy", "http://c.com/de/")]
    model = urlfilter.fit_models(spark.createDataFrame(judged, "text string, verdict string"))
    text = "http://q.org/zz"
    score = urlfilter.score(spark.createDataFrame([(text,)], "text string"), model).first()["score"]

    def p(kind, gram):
        if not gram:
            return 1 / urlfilter.SYMBOLS
        seen = Counter()
        for u, k in judged:
            if k == kind:
                own = "^^" + u
                for i in range(2, len(own)):
                    if own[i - len(gram) + 1 : i] == gram[:-1]:
                        seen[own[i]] += 1
        low = p(kind, gram[1:])
        return (seen[gram[-1]] + len(seen) * low) / (sum(seen.values()) + len(seen)) if seen else low

    import math

    own = "^^" + text
    want = sum(math.log(p("allow", own[i - 2 : i + 1])) - math.log(p("block", own[i - 2 : i + 1])) for i in range(2, len(own))) / len(text)
    assert score == pytest.approx(want, abs=1e-4)


FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in FORMATS.items() for m in re.finditer(p, text or "") if ok(k, m[0])]


def test_base_spans_are_leftmost_matches(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (269) 555-3296", "x_y", " ", "-", "_d@e.f", "😀", "é", "256.1.1.1", "001.02.3.4", "5.6", "+", "0", "\n", "%"]
    texts = [None, "", "9" * 5000, "a" * 20000, "1 " * 3000, ("a@" * 3000), "+1" + " " * 5000 + "x", "a@b.c-d@e.f a@b.c_d@e.f"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    for r in pii.personal_data(docs).collect():
        want = brute_spans(texts[r["doc_id"]])
        n = Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in FORMATS] == [n[k] for k in FORMATS], texts[r["doc_id"]]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_patterns_discover_identifiers(spark):
    rows = [(i, f"please reach us at mail: user{i}@site{i}.org or call +1 (269) 555-{1000 + i} today") for i in range(30)]
    rows += [(50, "please reach us at mail: someone(at)hidden5551234 now"), (51, "the year mail 20240101 was fine"), (52, "the code 20240101999 was fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    at = rows[30][1].index("someone")
    assert got[50] == f"email:{at}:{at + len('someone(at)hidden5551234')}"
    assert got[51] == "" and got[52] == ""
    assert all(s.count(",") == 1 for i, s in got.items() if i < 30)


def test_redaction(spark):
    df = spark.createDataFrame([("ab c@d.ef gh", "email:3:9"), ("none", "")], "t string, s string")
    assert [r[0] for r in df.select(pii.redacted(F.col("t"), F.col("s"))).collect()] == ["ab [email] gh", "none"]


def plain_discovery(texts, bodies):
    """Bootstrapping with lists and dictionaries over given instances: (row, kind of a seed or None, form, start, end, value, patterns)."""
    instances = texts
    graph = {}
    for _, kind, _, _, _, value, patterns in instances:
        for p in patterns:
            key = p, value
            graph[key] = max(filter(None, (graph.get(key), kind)), default=None)
    seeds = {(v, k) for (_, v), k in graph.items() if k}
    found, score = {}, {s: 1.0 for s in seeds}
    for _ in range(pii.ROUNDS):
        sure = defaultdict(dict)
        for p in {p for p, _ in graph}:
            values = [v for q, v in graph if q == p]
            for kind in pii.KINDS:
                hit = sum(score.get((v, kind), 0) for v in values)
                if sum(graph[p, v] == kind for v in values) >= pii.MIN_SEEDS and hit / (len(values) + 1) >= pii.PATTERN_CONFIDENCE:
                    sure[p][kind] = hit / (len(values) + 1)
        found = {}
        for p, v in graph:
            for kind, c in sure[p].items():
                found[v, kind] = 1 - (1 - found.get((v, kind), 0)) * (1 - c)
        own = {v for v, _ in seeds}
        score = {s: 1.0 for s in seeds} | {k: x for k, x in found.items() if k[0] not in own}
    best = {}
    for (v, kind), x in found.items():
        if x >= pii.INSTANCE_SCORE:
            best[v] = min(best.get(v, (0, 0, "")), (-x, pii.KINDS.index(kind), kind))
    return {(row, best[v][2], s, e) for row, _, form, s, e, v, _ in instances if form and v in best and best[v][2] in pii._FORM_KINDS[form]}


def bootstrap_rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    secret = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows = []
    for i in range(60):
        parts = [word() for _ in range(12)]
        parts.insert(3, f"call me at +1 ({number(3)}) 555-{number(4)}" if i % 6 else f"call me at 555 {number(3)} {number(4)}")
        parts.insert(7, f"mail to {word()}{i}@{word()}.org" if i % 8 else f"mail to {word()} at {word()} dot com")
        parts.insert(9, f'token = "{secret(40)}"' if i % 7 else f"token = pw{i}x9z")
        parts += [f"sha256: {secret(64)}", f"room {number(8)}", f"built = r{number(3)}b"]
        rows.append((i, " ".join(parts)))
    return rows


def test_discovery_is_plain_bootstrapping(spark):
    rows = bootstrap_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = pii.materialise(pii.located(docs), "t")
    got = {tuple(r) for r in pii.discovered(spans).select("row", "kind", "s", "e").collect()}
    instances = [(r["row"], r["kind"], r["form"], r["s"], r["e"], r["value"], r["patterns"]) for r in pii._instances(spans).collect()]
    assert got == plain_discovery(instances, rows)
    texts = dict(rows)
    found = {(r["doc_id"], k): texts[r["doc_id"]][s:e] for r in pii.personal_data(docs).collect() for k, s, e in ((x.split(":")[0], *map(int, x.split(":")[1:])) for x in r["spans"].split(","))}
    for i, text in rows:
        if i % 6 == 0:
            assert found[i, "phone"].startswith("555 ") and len(found[i, "phone"]) == 12
        if i % 8 == 0:
            assert " at " in found[i, "email"] and found[i, "email"].endswith(" dot com")
        assert found[i, "secret"] in text and (found[i, "secret"] == f"pw{i}x9z" if i % 7 == 0 else len(found[i, "secret"]) == 40)
    assert sum(k in ("phone", "email", "secret") for _, k in found) == 180  # no digest, no room number, no build


@pytest.mark.parametrize("unit", ["123 ", "1.2.3.4 a1=b2c3d4 "])
def test_spans_take_time_in_proportion(spark, unit):
    """Eight times the text takes at most 24 times as long."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, unit * n)], "doc_id long, text string")
        took = []
        for _ in range(2):
            began = time.time()
            row = pii.located(df).collect()[0]
            took.append(time.time() - began)
        return min(took), sum(len(row[k]) for k in (*pii.BASE, *pii.FORMS))

    (small, a), (large, b) = seconds(5000), seconds(40_000)
    assert b in (0, 1, 8 * a, 16 * a) and large <= 24 * max(small, 0.2)


def test_many_spans_have_right_offsets(spark):
    rng = random.Random(3)
    text = "".join(rng.choice(("1.2.3.4", "x", "9.9.9.9", " ", "user@h.org", "+1 269 555 3296 1", ";")) + rng.choice((" ", "  ", "; ")) for _ in range(9000))
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(text))
    assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and row["n_ip"] > 2000
