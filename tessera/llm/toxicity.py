"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = logistic(threshold_k - x.w): one weight vector for all thresholds, which are kept in order. Features
are a text's words and their PREFIXES (so inflected forms of a word share evidence), weighted 1 + ln(count).

The classifier is fitted on at most SAMPLE labelled documents of each class, taken by a hash of the id, and on at most
SAMPLE_WORDS different words of documents (summed) of each. A feature counts as evidence if it is in enough sampled
toxic documents (see least_docs) and its smoothed log odds are at least MIN_LOG_ODDS; the regression weighs these
features only, so long clean documents gather no noise; of more than FEATURES_KEPT it weighs those of most toxic documents.

Labels are binary, so grades of severity come from how much toxic evidence a toxic document holds: 0 is not toxic; toxic
documents are graded 1 to 3 by the terciles of their hits on words of evidence that the other half of the sample has
chosen, so no document has a part in its own grade. The sample has as many toxic documents as clean ones at most, the
corpus has not, so all thresholds are then shifted by one number: the first comes to stand where the evidence x.w
separates the sampled classes best. The verdict is the grade: a text is toxic if its grade is 1 or more, that is
P(grade >= 1) >= 0.5. Every prediction reads the whole text.

Defined cases: a null or empty text has no features, so it gets the severity of the bare thresholds; texts of any
length are read whole, a long one needs more evidence only as far as it has some; without toxic or without clean
labelled documents the model is empty: severity 0, nothing toxic; labels that repeat or clash for an id count as their
maximum; null labels and ids are left out; rows that repeat an id are judged each by its own text, and all of them are
in the sample if the id is; an empty table gives an empty result; other columns pass through remove_toxic as they are,
whatever their names.
"""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, materialise, quoted, small_batches

SAMPLE, SAMPLE_WORDS, MIN_LOG_ODDS, PREFIXES = 4000, 20_000_000, 3.0, (4, 5, 6, 7, 8)
#: How many missed toxic documents, in shares of their class, one clean document judged toxic counts for.
WRONGLY = 2
#: Most features that the model weighs, those of most toxic documents first.
FEATURES_KEPT = 1 << 14
_WORD = re.compile(r"\w+")
#: Bounds a worker's cache of words.
CACHE = 100_000
RESULT = "expected_severity double, grade int, p_toxic double, toxic boolean"


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, np.float64)))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood less an L2 term, by Adam on all rows.

    Thresholds are the first one plus a running sum of exponentials, so they stay in order.
    """
    n, w = len(grades), np.zeros(n_features)
    share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n)
    start = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    theta = np.concatenate([w, raw])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, raw = theta[:n_features], theta[n_features:]
        cuts = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
        eta = np.bincount(rows, values * w[cols], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(invalid="ignore", over="ignore"):
            hi, lo = sigmoid(edges[grades + 1] - eta), sigmoid(edges[grades] - eta)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = np.bincount(cols, values * (d_hi - d_lo)[rows], minlength=n_features) / n + l2 * w
        g_cut = -np.array([d_hi[grades == k].sum() - d_lo[grades == k + 1].sum() for k in range(n_grades - 1)]) / n
        g_raw = np.concatenate([[g_cut.sum()], [g_cut[k:].sum() * np.exp(raw[k]) for k in range(1, n_grades - 1)]])
        g = np.concatenate([g_w, g_raw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w, raw = theta[:n_features], theta[n_features:]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


class SeverityModel:
    """Weights by feature, and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds
        self._cache: dict[str, tuple[str, ...]] = {}

    def evidence(self, text: str | None) -> dict[str, int]:
        """Counts of the weighted features in the text."""
        cache, found = self._cache, {}
        for word in _WORD.findall((text or "").lower()):
            own = cache.get(word)
            if own is None:
                if len(cache) >= CACHE:
                    cache.clear()
                own = cache[word] = tuple(f for f in features_of(word) if f in self.weights)
            for f in own:
                found[f] = found.get(f, 0) + 1
        return found

    def predict(self, text: str | None) -> tuple[float, int, float, bool]:
        if not len(self.thresholds):
            return 0.0, 0, 0.0, False
        eta = math.fsum(self.weights[f] * (1 + math.log(n)) for f, n in self.evidence(text).items())
        above = 1 - sigmoid(self.thresholds - eta)
        grade = int((above >= 0.5).sum())
        return float(above.sum()), grade, float(above[0]), grade >= 1

    def __getstate__(self):
        return self.weights, self.thresholds

    def __setstate__(self, state):
        self.__init__(*state)


def _sampled(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id and toxic of at most sample documents of each class."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit_severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SeverityModel:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1).

    Features are counted in the tasks that read the texts, and documents of a feature in Spark; the driver gets the features
    that are evidence in the sample or in a half of it, and where the sampled documents hold those.
    """
    spark = docs.sparkSession
    small_batches(spark)
    drawn = F.broadcast(_sampled(labels.select("doc_id", "toxic"), sample))  # 2 * sample rows at most
    labelled = docs.select("doc_id", "text").join(drawn, "doc_id").select("toxic", "doc_id", "text")

    @F.arrow_udf("words int, half int, bag binary, feature array<string>, n array<int>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, features, counts = [], [pa.array([], pa.string())], [pa.array([], pa.int32())]
            for t in batch:  # one text's features are Python objects at a time
                *own, feature, n = _counted(t.as_py())
                rows.append(own)
                features.append(pa.array(feature, pa.string()))
                counts.append(pa.array(n, pa.int32()))
            ends = pa.array(np.cumsum([len(f) for f in features]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays(x)) for x in (features, counts)]
            kinds = {"words": pa.int32(), "half": pa.int32(), "bag": pa.binary()}
            yield pa.StructArray.from_arrays([*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())), *lists], [*kinds, "feature", "n"])

    bags = materialise(labelled.select(F.monotonically_increasing_id().alias("row"), "toxic", "doc_id", counted("text").alias("c")).select("row", "toxic", "doc_id", "c.*"), "toxicity-bags")
    drawn = {k: list(_bounded((r["row"], r["words"], r["half"]) for r in bags.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "bag", "row").select("row", "words", "half").toLocalIterator())) for k in (1, 0)}
    held = [*drawn[1], *drawn[0]]
    sizes = len(drawn[1]), len(drawn[0])
    if not all(sizes):
        return SeverityModel({}, np.zeros(0))
    own = F.broadcast(spark.createDataFrame([(row, at, half) for at, (row, _, half) in enumerate(held)], "row long, at int, side int"))
    each = bags.join(own, "row").select("at", "side", "toxic", F.explode(F.arrays_zip("feature", "n")).alias("x")).select("at", "side", "toxic", F.col("x.feature").alias("feature"), F.col("x.n").alias("n"))
    counts = {(t, h): F.count_if((F.col("toxic") == t) & (F.col("side") == h)).alias(f"{'ba'[t]}{h}") for t in (1, 0) for h in (0, 1)}
    found = each.groupBy("feature").agg(*counts.values())
    in_half = {(t, h): sum(1 for *_, half in drawn[t] if half == h) for t in (1, 0) for h in (0, 1)}
    whole = _is_evidence(F.col("a0") + F.col("a1"), F.col("b0") + F.col("b1"), *sizes)
    enough = F.col("a0") + F.col("a1") >= least_docs(sizes[0])
    part = [enough & _is_evidence(F.col(f"a{h}"), F.col(f"b{h}"), in_half[1, h], in_half[0, h]) for h in (0, 1)]
    chosen = found.select("feature", (F.col("a0") + F.col("a1")).alias("a"), whole.alias("whole"), *(p.alias(f"half{h}") for h, p in enumerate(part)))
    chosen = materialise(chosen.where("whole or half0 or half1").orderBy(F.desc("a"), "feature").limit(2 * FEATURES_KEPT), "toxicity-features")
    features = chosen.orderBy("feature").collect()
    if not any(r["whole"] for r in features):
        return SeverityModel({}, np.zeros(0))
    number = F.broadcast(spark.createDataFrame([(r["feature"], k) for k, r in enumerate(features)], "feature string, k int"))
    held_features = each.join(number, "feature").select("at", "k", "n").toArrow()
    at, k, n = (held_features.column(c).to_numpy() for c in ("at", "k", "n"))
    order = np.lexsort((k, at))
    half = np.array([h for *_, h in held])
    toxic = (np.arange(len(held)) < sizes[0]).astype(np.int64)
    flags = np.array([[r["whole"], r["half0"], r["half1"]] for r in features], bool)
    most = np.array([r["a"] for r in features])
    return fit_from_evidence(at[order].astype(np.int64), k[order], 1 + np.log(n[order]), toxic, half, [r["feature"] for r in features], flags, most)


def _counted(text: str | None) -> tuple[int, int, bytes, list[str], list[int]]:
    """Different words, the half that the document is in, a digest of its words, and its features with their counts."""
    words = Counter(_WORD.findall((text or "").lower()))
    features: dict[str, int] = {}
    for w, n in words.items():
        for f in features_of(w):
            features[f] = features.get(f, 0) + n
    bag = "\n".join(sorted(f"{n} {w}" for w, n in words.items())).encode()
    return len(words), zlib.crc32(bag) & 1, hashlib.md5(bag).digest(), list(features), list(features.values())


def _bounded(rows: Iterator[tuple[int, int, int]], most: int = SAMPLE_WORDS) -> Iterator[tuple[int, int, int]]:
    """Rows (row, words, half) up to the one with which they hold more than so many words; the first one always."""
    held = 0
    for row in rows:
        held += row[1]
        if held > most and held > row[1]:
            return
        yield row


def _is_evidence(a: Column, b: Column, n_toxic: int, n_clean: int) -> Column:
    """Of features in a toxic and b clean documents."""
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_clean - b + 0.5))
    return (a >= least_docs(n_toxic)) & (odds >= MIN_LOG_ODDS)


def least_docs(n_toxic: int) -> int:
    """In how many of the sampled toxic documents a feature must be: one in 16, 3 at least and 8 at most."""
    return min(8, max(3, n_toxic // 16))


def severity_grades(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, toxic: np.ndarray, half: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """0 for clean documents; toxic ones 1 to 3 by the terciles of their evidence, chosen by the half (0 or 1) that they are not in.

    chosen: for each feature and half whether that half has chosen it.
    """
    grades = toxic.copy()
    for k in (0, 1):
        held = np.bincount(rows, values * chosen[cols, 1 - k], minlength=len(toxic))
        own = np.flatnonzero((half == k) & (toxic == 1))
        if len(own):
            grades[own] = 1 + np.searchsorted(np.quantile(held[own], [1 / 3, 2 / 3]), held[own], "left")
    _, grades = np.unique(grades, return_inverse=True)  # without gaps
    return grades


def fit_from_evidence(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, toxic: np.ndarray, half: np.ndarray, names: list[str], chosen: np.ndarray, a: np.ndarray) -> SeverityModel:
    """rows, cols, values: which documents hold which features; chosen: whether the sample and either half has chosen a feature; a: its toxic documents."""
    grades = severity_grades(rows, cols, values, toxic, half, chosen[:, 1:])
    kept = np.flatnonzero(chosen[:, 0])
    kept = kept[np.argsort(-a[kept], kind="stable")][:FEATURES_KEPT]
    column = np.full(len(names), -1)
    column[kept] = np.arange(len(kept))
    at = column[cols] >= 0
    rows, cols, values = rows[at], column[cols[at]], values[at]
    w, thresholds = fit_cumulative_link(rows, cols, values, grades, len(kept), int(grades.max()) + 1)
    cut = best_cut(np.bincount(rows, values * w[cols], minlength=len(toxic)), toxic)
    if cut == np.inf:
        return SeverityModel({}, np.zeros(0))
    return SeverityModel({names[int(k)]: float(x) for k, x in zip(kept, w)}, thresholds - thresholds[0] + cut)


def best_cut(eta: np.ndarray, toxic: np.ndarray) -> float:
    """The lowest evidence that counts as toxic: it maximises true less false positive rate over the sample. No evidence (0) is never toxic."""
    order = np.argsort(-eta, kind="stable")
    gain = np.cumsum(np.where(toxic[order] == 1, 1 / max(1, toxic.sum()), -WRONGLY / max(1, (toxic == 0).sum())))
    at = np.flatnonzero((eta[order] > 0) & (np.append(eta[order][1:], -np.inf) < eta[order]))
    if not len(at):
        return np.inf
    best = at[np.argmax(gain[at])]
    below = eta[order][best + 1] if best + 1 < len(eta) else 0.0
    return float((eta[order][best] + max(0.0, below)) / 2)


def severity(model: SeverityModel, text: Column) -> Column:
    """A struct of RESULT: expected grade, the grade reached with at least even odds, P(grade >= 1), and whether that grade is 1 or more."""
    spark_model = model

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [spark_model.predict(t) for t in batch.to_pylist()]
            kinds = [pa.float64(), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["expected_severity", "grade", "p_toxic", "toxic"])

    return predict(text)


def remove_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents that aren't judged toxic, with their own columns."""
    own, (found,) = quoted(docs), fresh(docs, "severity")
    model = fit_severity(docs, labels, sample)
    return docs.withColumn(found, severity(model, F.col("text"))).where(~F.col(f"{found}.toxic")).select(*own)
