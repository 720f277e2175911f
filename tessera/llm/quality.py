"""Quality classifier: a sparse ensemble of conjunctive rules over statistics of a text.

Shallow trees are grown on labelled rows, each on half of them and on some of the statistics; every path from a root is
a rule, a conjunction of `statistic <= cut` and `statistic > cut`. A lasso logistic regression over all rules leaves few
of them, and these are compiled into one Spark column expression over the statistics, which are expressions over the
text themselves: scoring runs in the JVM and reads the whole text.

The classifier is fitted on at most SAMPLE labelled rows of each class, taken by a hash of the id: what the driver holds
are their statistics, a few numbers a row. The strength of the penalty is chosen on every third sampled row, which is
held out from the fits that it is chosen by. Scores are probabilities for classes as frequent as they are in the sample.

Defined cases: a null or empty text has the statistics of no characters (all 0) and is scored by them; texts of any
length are read whole; without labelled rows the score is 0.5, with one class it is that class's smoothed share; labels
that repeat or clash for an id count as their maximum; null labels and ids are left out; rows that repeat an id are
judged each by its own text, and all of them are in the sample if the id is; equal gains go to the earlier statistic and
the lower cut, so reruns agree; an empty table gives an empty result. Of documents only doc_id and text are read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows of each class at most.
SAMPLE = 3000
TREES, DEPTH, LEAST_ROWS, CUTS = 40, 3, 10, 24
#: Shares of the least penalty that leaves no rule, strongest first; and rounds of the descent at each.
PENALTIES, STEPS = (0.1, 0.03, 0.01, 0.003), 300
#: Weights below this are none.
LEAST_WEIGHT = 1e-3


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _share(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1.0))


def statistics(text: Column) -> Column:
    """A struct of numbers, one pass or a few over the text each."""
    text = F.coalesce(text, F.lit(""))
    words, lines = F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    size = lambda a: F.size(a).cast("double")
    counts = F.struct(
        F.length(text).cast("double").alias("chars"), size(words).alias("words"), size(F.array_distinct(words)).alias("vocabulary"), size(lines).alias("lines"), size(F.array_distinct(lines)).alias("different_lines"),
        F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double").alias("longest"), _count(text, r"\p{L}+").alias("runs"), _count(text, r"\p{L}").alias("letters"), _count(text, r"\p{Lu}").alias("capitals"),
        _count(text, r"[0-9]").alias("digits"), _count(text, r"[.,;:!?]").alias("points"), _count(text, r"[!?]").alias("calls"), _count(text, r"""[^\p{L}\p{N}\s.,;:!?'"()-]""").alias("symbols"), _count(text, r"[.!?](?=\s|$)").alias("ends"),
    )

    def shares(c: Column) -> Column:
        return F.struct(
            F.log1p(c["chars"]).alias("log_chars"), F.log1p(c["words"]).alias("log_words"), _share(c["letters"], c["runs"]).alias("run_length"), F.log1p(c["longest"]).alias("log_longest"), _share(c["letters"], c["chars"]).alias("letter_share"),
            _share(c["capitals"], c["letters"]).alias("capital_share"), _share(c["digits"], c["chars"]).alias("digit_share"), _share(c["points"], c["words"]).alias("points_a_word"), _share(c["calls"], c["words"]).alias("calls_a_word"),
            _share(c["symbols"], c["words"]).alias("symbols_a_word"), _share(c["ends"], c["words"]).alias("ends_a_word"), _share(c["vocabulary"], c["words"]).alias("vocabulary_share"),
            _share(F.log1p(c["vocabulary"]), F.log1p(c["words"])).alias("vocabulary_growth"), F.log1p(c["lines"]).alias("log_lines"), _share(c["different_lines"], c["lines"]).alias("different_line_share"), _share(c["words"], c["lines"]).alias("words_a_line"),
        )

    # an array of one struct: what is counted once is used by all shares
    return F.element_at(F.transform(F.array(counts), shares), 1)


@dataclass(frozen=True, order=True)
class Test:
    """statistic > cut if above, else statistic <= cut."""
    statistic: str
    cut: float
    above: bool

    def on(self, stats: Column) -> Column:
        return stats[self.statistic] > F.lit(self.cut) if self.above else stats[self.statistic] <= F.lit(self.cut)


@dataclass(frozen=True)
class RuleModel:
    """Log odds of label 1: bias plus the weights of the rules that hold."""
    bias: float
    rules: tuple[tuple[tuple[Test, ...], float], ...] = ()

    def score(self, stats: Column) -> Column:
        """The whole ensemble as one column."""
        odds = F.lit(self.bias)
        for tests, weight in self.rules:
            held = tests[0].on(stats)
            for t in tests[1:]:
                held = held & t.on(stats)
            odds = odds + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    def told(self) -> list[str]:
        """The rules as text, heaviest first."""
        side = lambda t: f"{t.statistic} {'>' if t.above else '<='} {t.cut:.6g}"
        return [f"{w:+.3f} if {' and '.join(map(side, tests))}" for tests, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def grow(x: np.ndarray, y: np.ndarray, names: list[str], columns: np.ndarray, depth: int = DEPTH) -> list[tuple[Test, ...]]:
    """Paths of a tree by least squares; a split leaves LEAST_ROWS on either side. Cuts lie between quantiles of the rows."""
    out: list[tuple[Test, ...]] = []

    def split(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        if len(path) == depth or len(rows) < 2 * LEAST_ROWS or y[rows].min() == y[rows].max():
            return
        best = (1e-9, -1, 0.0)
        for j in columns:
            v = np.sort(x[rows, j])
            at = np.unique(np.linspace(LEAST_ROWS, len(v) - LEAST_ROWS, CUTS).astype(int))
            for cut in np.unique((v[at - 1] + v[at]) / 2):
                low = x[rows, j] <= cut
                n = int(low.sum())
                if LEAST_ROWS <= n <= len(rows) - LEAST_ROWS:
                    a, b = y[rows[low]], y[rows[~low]]
                    gain = n * (len(rows) - n) / len(rows) * (a.mean() - b.mean()) ** 2
                    if gain > best[0] + 1e-12:
                        best = (gain, int(j), float(cut))
        _, j, cut = best
        if j < 0:
            return
        for above in (False, True):
            own = rows[(x[rows, j] > cut) == above]
            longer = (*path, Test(names[j], cut, above))
            out.append(longer)
            split(own, longer)

    split(np.arange(len(y)), ())
    return out


def holds(rule: tuple[Test, ...], x: np.ndarray, names: list[str]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for t in rule:
        held &= (x[:, names.index(t.statistic)] > t.cut) == t.above
    return held


def shortest(rule: tuple[Test, ...]) -> tuple[Test, ...]:
    """The same rule with one test a statistic and side, the tightest."""
    tightest: dict[tuple[str, bool], Test] = {}
    for t in rule:
        other = tightest.setdefault((t.statistic, t.above), t)
        if (t.cut > other.cut) == t.above:
            tightest[t.statistic, t.above] = t
    return tuple(sorted(tightest.values()))


def rules_of(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES) -> list[tuple[Test, ...]]:
    """Different rules of all trees: of rules that hold for the same rows, or for just the others, the shortest stays."""
    draw, found = np.random.default_rng(7), {}
    for _ in range(trees):
        rows = np.sort(draw.permutation(len(y))[: max(2 * LEAST_ROWS, len(y) // 2)])
        columns = np.sort(draw.permutation(len(names))[: max(2, len(names) // 3)])
        for rule in grow(x[rows], y[rows], names, columns):
            held = holds(rule, x, names)
            if 0 < held.sum() < len(y):
                key, rule = np.packbits(held == held[0]).tobytes(), shortest(rule)
                if key not in found or (len(rule), rule) < (len(found[key]), found[key]):
                    found[key] = rule
    return sorted(found.values(), key=lambda r: (len(r), r))


def lasso(h: np.ndarray, y: np.ndarray, penalties: list[float], steps: int = STEPS) -> list[tuple[float, np.ndarray]]:
    """Bias and weights of the logistic regression with an L1 penalty, for each penalty in turn, by accelerated proximal descent.

    h holds 0 and 1. Rules are weighed in units of their deviation, so rare ones aren't held down more than common ones.
    """
    mean, scale = h.mean(axis=0), np.maximum(h.std(axis=0), 1e-3)
    z = (h - mean) / scale
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b, out = np.zeros(z.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for penalty in penalties:
        ahead_w, ahead_b, pace = w, b, 1.0
        for _ in range(steps):
            off = 1 / (1 + np.exp(-(z @ ahead_w + ahead_b))) - y
            moved = ahead_w - rate * (z.T @ off) / len(y)
            new_w, new_b = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0), ahead_b - rate * off.mean()
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead_w, ahead_b = new_w + (pace - 1) / faster * (new_w - w), new_b + (pace - 1) / faster * (new_b - b)
            still = np.abs(new_w - w).max(initial=0) < 1e-6
            w, b, pace = new_w, new_b, faster
            if still:
                break
        out.append((b - float((w / scale) @ mean), w / scale))
    return out


def _penalties(h: np.ndarray, y: np.ndarray) -> list[float]:
    z = (h - h.mean(axis=0)) / np.maximum(h.std(axis=0), 1e-3)
    return [float(np.abs(z.T @ (y - y.mean())).max() / len(y) * share) for share in PENALTIES]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """x: rows by statistics; y: 0 or 1."""
    y = np.asarray(y, np.float64)
    n, ones = len(y), float(y.sum())
    prior = RuleModel(float(np.log((ones + 1) / (n - ones + 1))))
    if not 0 < ones < n:
        return prior
    out = np.arange(n) % 3 == 2
    share = PENALTIES[-1]
    if 0 < y[~out].sum() < (~out).sum() and out.any():
        tried = rules_of(x[~out], y[~out], names)
        if tried:
            h = np.stack([holds(r, x, names) for r in tried], axis=1).astype(np.float64)
            losses = []
            for b, w in lasso(h[~out], y[~out], _penalties(h[~out], y[~out])):
                odds = h[out] @ w + b
                losses.append(float(np.mean(np.logaddexp(0, odds) - y[out] * odds)))
            share = PENALTIES[int(np.argmin(losses))]
    rules = rules_of(x, y, names)
    if not rules:
        return prior
    h = np.stack([holds(r, x, names) for r in rules], axis=1).astype(np.float64)
    weights = _penalties(h, y)[: PENALTIES.index(share) + 1]
    b, w = lasso(h, y, weights)[-1]
    return RuleModel(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) >= LEAST_WEIGHT))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1), the rows to learn from."""
    own = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    parts = [own.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    drawn = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * sample rows at most
    rows = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "quality", statistics(F.col("text")).alias("s"))
    names = rows.schema["s"].dataType.names
    held = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "s").limit(4 * sample).collect()  # bounded too if ids repeat
    return fit_rules(np.array([list(r["s"]) for r in held], np.float64).reshape(-1, len(names)), np.array([r["quality"] for r in held]), names)


def quality(model: RuleModel, text: Column) -> Column:
    """The score of a text, between 0 and 1."""
    return F.element_at(F.transform(F.array(statistics(text)), model.score), 1)
