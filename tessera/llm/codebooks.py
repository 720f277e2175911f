"""Vector code compression: product codes from integer codebooks, learned and applied exactly.

A component x becomes the integer floor(1024 x). Vectors are cut into PARTS equal consecutive parts; each part position
has a codebook of at most ENTRIES entries, at first that part of the vectors of the smallest ids. A round assigns every
part to its nearest entry and moves each entry to floor(sum / count) of its parts. The codebooks (ENTRIES x dimension
integers) are broadcast; Arrow batches compute |x|^2 - 2 x.c + |c|^2 by int64 matrix products and take the first least;
each task sums the parts of an entry before a grouped shuffle adds up the tasks' sums, and the driver sees one row an entry.
No row is collected or cached: a round reads the vectors again where they lie.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; a vector of another length
than that of the smallest id, or of a length that PARTS doesn't divide, has a null code and error and takes no part in
the codebooks; the smallest id is looked for among vectors of a positive length that PARTS divides; null ids never give
entries, but are coded; of rows with one id the smaller vectors come first, repeated rows are each coded and counted;
with fewer than ENTRIES vectors the codebooks have as many entries, with none the result is empty; equal distances go
to the lower entry. Batches whose components are too large for int64 distances are computed in exact Python integers;
components are held to +-2^62 and errors to the largest long. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, small, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers are held to this magnitude, results to the largest long.
MOST, LONGEST = 1 << 62, (1 << 63) - 1
#: Rows of an Arrow batch that meet the codebook at a time; a distance table has so many rows.
ROWS = 1024


def is_whole(vector: Column) -> Column:
    """Not null, and all components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held to +-MOST; exact for doubles, as SCALE is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * SCALE)
    return np.where(scaled >= MOST, MOST, np.where(scaled <= -MOST, -MOST, np.clip(scaled, -MOST, MOST - 1024).astype(np.int64)))


def _fits(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether no distance over all components, and no sum of a batch, can leave int64."""
    most = max((int(np.abs(a).max()) if a.size else 0) for a in (x, c))
    return 4 * x.shape[1] * max(most, 1) ** 2 < LONGEST


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: n x length, entries: k x length. The first nearest entry of each row, and the squared distance to it."""
    if not _fits(x, entries):
        x, entries = x.astype(object), entries.astype(object)
    part = (entries * entries).sum(axis=1)[None, :] - 2 * (x @ entries.T)
    best = np.argmin(part, axis=1) if part.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in part], np.int64)
    return best, (x * x).sum(axis=1) + part[np.arange(len(x)), best]


def _vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        rows = batch.slice(at, ROWS)
        yield rows, integers(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, width))


def _partial_sums(df: DataFrame, books: np.ndarray) -> DataFrame:
    """Of each task and entry that it met: part, entry, count and the sum of each position."""
    parts, _, length = books.shape
    sent = df.sparkSession.sparkContext.broadcast(books)
    names = [f"s{i}" for i in range(length)]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *((s, pa.decimal128(38, 0)) for s in names)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, object)
        for batch in batches:
            for _, x in _vectors(batch, parts * length):
                for p in range(parts):
                    own = x[:, p * length : (p + 1) * length]
                    best, _ = nearest(own, books[p])
                    order = np.argsort(best, kind="stable")
                    met, first = np.unique(best[order], return_index=True)
                    # sums of at most ROWS components below 2^52 stay in int64; larger ones are added as Python integers
                    held = own[order] if not own.size or int(np.abs(own).max()) < 1 << 52 else own[order].astype(object)
                    total[p, met] += np.add.reduceat(held, first, axis=0).astype(object)
                    n[p] += np.bincount(best, minlength=n.shape[1])
        at = np.argwhere(n > 0)
        if len(at):
            sums = total[at[:, 0], at[:, 1]]
            columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n[n > 0], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([int(s) for s in sums[:, i]], pa.decimal128(38, 0)) for i in range(length))], schema=schema)

    return df.select("v").mapInArrow(task, f"part int, entry int, n long, {', '.join(f'{s} decimal(38,0)' for s in names)}")


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """vectors: id, v (whole vectors). parts x k x length, k the number of entries."""
    spark = vectors.sparkSession
    small_batches(spark)
    able = vectors.where((F.size("v") > 0) & (F.size("v") % parts == 0) & F.col("id").isNotNull())
    ids = able.select("id").orderBy("id").limit(entries)
    last = ids.agg(F.max("id").alias("id")).first()["id"]
    if last is None:
        return np.zeros((parts, 0, 0), np.int64)
    # ids first, then the vectors up to the last of them: the scan can leave out what lies beyond
    width = able.where(F.col("id") <= last).orderBy("id", "v").select(F.size("v").alias("n")).first()["n"]
    fit = able.where(F.size("v") == width)
    last = fit.select("id").orderBy("id").limit(entries).agg(F.max("id").alias("id")).first()["id"]
    first = fit.where(F.col("id") <= last).orderBy("id", "v").limit(entries).select("v").collect()
    whole = integers(np.array([r["v"] for r in first], np.float64))
    books = np.ascontiguousarray(whole.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    read = vectors.where(F.size("v") == width)
    for _ in range(rounds):
        merged = _partial_sums(read, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(books.shape[2])))
        books = books.copy()
        for row in merged.collect():  # one row an entry
            books[row["part"], row["entry"]] = [int(s) // row["n"] for s in row[3:]]
    return books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _codes(books: np.ndarray, best: list[np.ndarray]) -> list[str]:
    digits = max(2, math.ceil(math.log(max(2, books.shape[1]), 16)))
    return ["".join(f"{k:0{digits}x}" for k in row) for row in np.stack(best, axis=1).tolist()] if best else []


def encode(books: np.ndarray, vectors: DataFrame) -> DataFrame:
    """vectors: id, label, v (whole vectors). id, label, code and error, which are null where the length doesn't fit."""
    small_batches(vectors.sparkSession)
    parts, _, length = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = pa.schema([("code", pa.string()), ("error", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            for rows, x in _vectors(batch, parts * length):
                found = [nearest(x[:, p * length : (p + 1) * length], books[p]) for p in range(parts)]
                error = sum(d.astype(object) for _, d in found)
                columns = [pa.array(_codes(books, [best for best, _ in found]), pa.string()), pa.array([min(int(e), LONGEST) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), *columns], schema=pa.schema([rows.schema.field("id"), rows.schema.field("label"), *kinds]))

    id_kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))
    fits = F.size("v") == parts * length
    coded = vectors.where(fits).select("id", "label", "v").mapInArrow(task, f"id {id_kind}, label {label_kind}, code string, error long")
    return coded.unionByName(vectors.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors: vec_id, embedding, label. vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    own = vectors.select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("v")).where(is_whole(F.col("v")))
    books = fit_codebooks(own, parts, entries, rounds)
    coded = materialise(encode(books, own), "codes")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("long").alias("label_error"))
    sums = materialise(sums.withColumnRenamed("label", "l"), "label-errors")
    out = coded.join(small(sums), F.col("label").eqNullSafe(F.col("l")), "left")
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after another, as DuckDB says them."""
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * {SCALE})::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, e, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part) WHERE e < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT vec_id, p, v, e, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, c)])::BIGINT AS d FROM part JOIN c{k} USING (p)) GROUP BY vec_id, p)")
        if k < ROUNDS:
            floor = "((s - ((s % n) + n) % n) // n)"
            steps.append(f"m{k} AS (SELECT p, e, list({floor}::BIGINT ORDER BY i) AS c FROM (SELECT p, e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"


ORACLE_SQL = _oracle()
