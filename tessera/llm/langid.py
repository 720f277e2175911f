"""Language identification by rank-order profiles.

A profile is the RANKS most frequent character n-grams (1 to ORDER letters, words set off by a boundary mark) of one
language, most frequent first. A document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of differences in rank, an n-gram missing from the profile costing RANKS.

Profiles are a classifier fitted on at most about TRAINING_DOCS labelled documents of each language, taken by a hash of the
id; predictions read whole texts and nothing else. A model has RANKS rows a language, as has what a worker holds of it.

Defined cases: a null text, or one without a letter, gives 'und' and score 0; without any labelled document every
prediction is 'und'; equal distances go to the smaller language code; equal counts of n-grams go to the smaller n-gram;
a null id counts as the empty text, so the query holds its document out; repeated rows are predicted, and learned from,
each for itself; texts of any length are read whole; an empty table gives an empty result; no column but doc_id, text
and lang is read, whatever its name.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, small, small_batches

ORDER, RANKS, TRAINING_DOCS = 3, 300, 1500
UNKNOWN = "und"
_SHIFT = np.int64(21)  # a code point has 21 bits, so three fit into a long
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams and their counts, by code. Runs of other characters are one boundary, which is a symbol of its own (1), so that "a" at the start of a word isn't "a"."""
    c = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c = np.where(_is_letter()[c], c, 1)
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (c[:-1] << _SHIFT) | c[1:]
    codes = np.concatenate([c[c > 1], two, (two[:-1] << _SHIFT) | c[2:]])
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:ranks]]


class Profiles:
    """Ranks by n-gram: for each code those languages that have it, with its rank in each."""

    def __init__(self, by_lang: dict[str, list[int]], ranks: int = RANKS):
        self.langs, self.ranks = sorted(by_lang), ranks
        held = [np.asarray(by_lang[lang], np.int64) for lang in self.langs]
        code = np.concatenate([*held, np.zeros(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.lang = np.repeat(np.arange(len(held)), [len(h) for h in held])[order]
        self.rank = np.concatenate([*map(np.arange, map(len, held)), np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.ranks)
        at = np.searchsorted(self.codes, own)
        k = np.flatnonzero((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own))
        n = self.first[at[k] + 1] - self.first[at[k]]
        entry = np.repeat(self.first[at[k]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        nearer = self.ranks - np.abs(self.rank[entry] - np.repeat(k, n))  # than an n-gram that is missing
        total = self.ranks * len(own) - np.bincount(self.lang[entry], nearer, len(self.langs))
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.ranks * len(own)))


def fit_profiles(labelled: DataFrame, ranks: int = RANKS, training_docs: int = TRAINING_DOCS) -> Profiles:
    """labelled: doc_id, text, lang. Counts are summed on the executors; the driver gets the top ranks of each language."""
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = small(materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages"))
    share = F.least(F.lit(1.0), F.lit(float(training_docs)) / F.col("size"))
    drawn = labelled.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = grams(text)
                sums.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), counts.tolist())))
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], ["lang", "code", "n"])

    counted = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    by_lang: dict[str, list[int]] = {}
    for r in counted.withColumn("p", place).where(F.col("p") <= ranks).orderBy("lang", "p").collect():
        by_lang.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by_lang, ranks)


def predict_language(profiles: Profiles, text: Column) -> Column:
    """A struct: lang_pred, score."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [profiles.predict(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["lang_pred", "score"])

    return predict(text)
