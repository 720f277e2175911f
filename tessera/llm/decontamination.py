"""Benchmark decontamination: a broadcast index of benchmark windows, scanned over token windows of documents.

A window is WINDOW consecutive words of a benchmark item; an item with fewer words, but not none, is one window of
its own length. The index holds each block of the benchmark as word numbers plus sorted 64-bit window hashes; a hash
hit counts only after the words themselves have been compared. The benchmark is broadcast in blocks of at most
BLOCK_BYTES of text, one block at a time, so what is broadcast stays bounded; with several blocks each scans all
documents, its broadcast is destroyed, and the intervals found are merged per document.

Defined cases: a null text has no words and no hits; an empty benchmark hits nothing; a null item text is no window; an
item without an id hits words but is not among the items; item ids that repeat count once; texts of any length are
read whole; repeated documents give repeated rows; an empty table gives an empty result; other columns pass through as
they are, whatever their names.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, materialise, quoted, small_batches, utf8

WINDOW = 13
BLOCK_BYTES = 16 << 20
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_HITS = "starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and any non-ASCII characters."""
    return text.translate(_WORD_BYTES).split() if text else []


def _hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = (h ^ ids[at + j]) * _BASE
        h ^= h >> np.uint64(29)
    return h


class WindowIndex:
    """Windows of benchmark items, by length: sorted hashes, and where each window stands in the flat words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        places: dict[int, list[tuple[int, int]]] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.items)} | {None: -1}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            n, base = min(window, len(words)), len(flat)
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            places.setdefault(n, []).extend((p, number[item]) for p in range(base, base + len(words) - n + 1))
        self.flat = np.array(flat, np.uint64)
        self.by_length = {}
        for n, found in places.items():
            at, owner = np.array(found, np.int64).T
            h = _hashes(self.flat, at, n)
            order = np.argsort(h, kind="stable")
            self.by_length[n] = h[order], at[order], owner[order]

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Starts and ends of hit windows, and numbers of the items they come from."""
        starts, ends, items = [], [], set()
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, (hashes, at, owner) in self.by_length.items():
            if len(ids) < n:
                continue
            here = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(here):
                continue
            h = _hashes(ids, here, n)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for p, a, b in zip(here[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                own = [int(owner[k]) for k in range(a, b) if np.array_equal(self.flat[at[k] : at[k] + n], ids[p : p + n])]
                if own:
                    starts.append(p)
                    ends.append(p + n)
                    items.update(k for k in own if k >= 0)
        return starts, ends, items


def covered(n_words: int, starts, ends) -> int:
    """Words inside any of the intervals."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, np.asarray(starts, np.int64), 1)
    np.add.at(step, np.asarray(ends, np.int64), -1)
    return int((np.cumsum(step) > 0).sum())


def summary(n_words: int, n_hit: int, items: list[str]) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def _columns(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


_RESULT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """Items in blocks of about block_bytes of text; the driver holds one at a time."""
    block, held = [], 0
    for item, text in benchmark.select("item_id", utf8("text").alias("text")).toLocalIterator():
        block.append((None if item is None else str(item), bytes(text) if text is not None else None))
        held += len(text or b"")
        if held >= block_bytes:
            yield block
            block, held = [], 0
    yield block


def _one_block(index, text):
    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at = index.value
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                words = words_of(t)
                starts, ends, items = at.scan(words)
                rows.append(summary(len(words), covered(len(words), starts, ends) if starts else 0, [at.items[k] for k in items]))
            yield _columns(rows, _RESULT)

    return judge(utf8(text))


def _hits(index, text):
    @F.arrow_udf(_HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at = index.value
        kinds = [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
        for batch in batches:
            yield _columns([(s, e, [at.items[k] for k in i]) for s, e, i in (at.scan(words_of(t)) for t in batch.to_pylist())], kinds)

    return hits(utf8(text))


def _merged(text, starts, ends, items):
    @F.arrow_udf(RESULT)
    def merge(text: pa.Array, starts: pa.Array, ends: pa.Array, items: pa.Array) -> pa.Array:
        rows = []
        for t, s, e, i in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), items.to_pylist()):
            n = len(words_of(t))
            rows.append(summary(n, covered(n, s, e) if s else 0, sorted(set(i or []))))
        return _columns(rows, _RESULT)

    return merge(utf8(text), starts, ends, items)


def judge_documents(docs: DataFrame, benchmark: DataFrame, result: str = "contamination", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column: n_words, n_hit, n_items, items_sha256, contaminated."""
    small_batches(docs.sparkSession)
    own, context = quoted(docs), docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if not second:
        return docs.withColumn(result, _one_block(context.broadcast(WindowIndex(first, window)), F.col("text")))
    wide, names = _with_intervals(docs, chain((first, second), blocks), window)
    return wide.select(*own, _merged(F.col("text"), *map(F.col, names)).alias(result))


def _with_intervals(docs: DataFrame, blocks: Iterable[list], window: int) -> tuple[DataFrame, list[str]]:
    """docs with starts, ends and items of hits in all blocks (null: none), and the names of these columns. Equal texts have equal hits, so a text's hash is the key."""
    context, found = docs.sparkSession.sparkContext, None
    key, length, key_2, length_2, *names = fresh(docs, "key", "length", "key_2", "length_2", "starts", "ends", "items")
    sides = F.xxhash64("text"), F.length("text")
    for block in blocks:
        index = context.broadcast(WindowIndex(block, window))
        one = docs.select(sides[0].alias(key_2), sides[1].alias(length_2), _hits(index, F.col("text")).alias("h")).where(F.size("h.starts") > 0)
        one = one.select(key_2, length_2, *(F.col(f"h.{k}").alias(n) for k, n in zip(("starts", "ends", "items"), names))).dropDuplicates([key_2, length_2])
        one = materialise(one, "window-hits")
        index.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy(key_2, length_2).agg(*(F.flatten(F.collect_list(n)).alias(n) for n in names))
    wide = docs.withColumns({key: sides[0], length: sides[1]}).join(found, (F.col(key) == F.col(key_2)) & (F.col(length) == F.col(length_2)), "left")
    return wide, names


def remove_hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words of all hit windows taken out of their texts; other texts stay as they are."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([t if not s else remove_spans(t, list(zip(s, e))) for t, s, e in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist())], pa.string())

    wide, (starts, ends, _) = _with_intervals(docs, _blocks(benchmark, block_bytes), window)
    text = cut(F.col("text"), F.col(starts), F.col(ends)).alias("text")
    return wide.select(*(text if name == "text" else c for name, c in zip(docs.columns, quoted(docs))))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    (found,) = fresh(docs, "contamination")
    return judge_documents(docs, benchmark, found).where(~F.col(f"{found}.contaminated")).select(*quoted(docs))


def remove_spans(text: str | None, intervals: list[tuple[int, int]]) -> str | None:
    """The text without the words of the intervals (word numbers, end exclusive); what stands between words stays."""
    if text is None:
        return None
    gone = set()
    for s, e in intervals:
        gone.update(range(s, e))
    out, last = [], 0
    for k, m in enumerate(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)):
        if k in gone:
            out.append(text[last : m.start()])
            last = m.end()
    return "".join(out) + text[last:]


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM sized, unnest(range(1, len(w) - n + 2)) AS t(i)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, n, i, item FROM places JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hits), unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
