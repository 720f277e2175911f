"""Approximate nearest neighbours by an inverted file: vectors lie by the cell of their nearest centre, a query looks into a few cells.

Centres are fitted on a bounded sample; every vector is placed. What is found in the cells that are looked into is ranked by
exact distances, so only a neighbour in another cell can be missed; more probes miss fewer. graph.nearest_edges is exact.

Equal vectors are one entry with the smallest of their pages, so a vector that very many pages have costs one row, and a
cell is searched in blocks, so no task holds a cell.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import ship
from ..sources.scratch import materialise

#: Vectors that centres are fitted on; centres at most; vectors in a block.
SAMPLE, MOST_CELLS, BLOCK = 50_000, 4096, 4096


@dataclass
class Index:
    """centres: cell by dimension. entries: cell, block, code (of the vector), vector, pages (the smallest of those that have it)."""
    centres: np.ndarray
    entries: DataFrame
    kept: int

    def save(self, path: str) -> None:
        rows = [(k, c.tolist()) for k, c in enumerate(self.centres)]
        self.entries.sparkSession.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        # cells in ranges of files, so that a few cells are a few files
        self.entries.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block").write.mode("overwrite").parquet(f"{path}/entries")


def load(spark: SparkSession, path: str, kept: int = 6) -> Index:
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS rows at most
    return Index(np.array([r["centre"] for r in centres], np.float64), spark.read.parquet(f"{path}/entries"), kept)


def _cells_of(centres: np.ndarray, vector: Column, n: int) -> Column:
    """The n nearest cells, nearest first."""
    held = (centres * centres).sum(axis=1)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), centres.shape[1])
            far = held[None, :] - 2 * (x @ centres.T)
            yield pa.array(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)), pa.list_(pa.int32()))

    return run(vector)


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, kept: int = 6, seed: int = 42) -> Index:
    """vectors: page_id, embedding (null ones are left out; all of one length). cells: the root of the number of vectors if None.

    kept: how many pages of equal vectors an entry names; it bounds how many neighbours a search can ask for, less one.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ship.send(vectors.sparkSession.sparkContext)
    own = vectors.where("embedding is not null and page_id is not null").select("page_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    # the smallest page of each vector, then the next one, so that no task gathers the pages of a vector that very many have
    one = _smallest(own, kept)
    entries = materialise(one.withColumn("code", F.xxhash64("vector")), "vector-entries")
    n = entries.count()
    cells = max(1, min(MOST_CELLS, cells or int(round(n ** 0.5))))
    if n == 0:
        return Index(np.zeros((0, 0)), entries.select(F.lit(0).alias("cell"), F.lit(0).alias("block"), "code", "vector", "pages"), kept)
    drawn = entries.orderBy("code").limit(sample).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=8).fit(materialise(drawn, "vector-sample"))
    centres = np.array([np.asarray(c) for c in model.clusterCenters()])
    placed = entries.withColumn("cell", F.get(_cells_of(centres, F.col("vector"), 1), F.lit(0)))
    placed = materialise(placed, "vector-cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # one row a cell
    blocks = F.ceil(F.col("n") / BLOCK)
    return Index(centres, placed.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.col("code"), blocks).cast("int").alias("block"), "code", "vector", "pages"), kept)


def _smallest(own: DataFrame, kept: int) -> DataFrame:
    """vector, pages: its kept smallest pages in order. Tasks cut each vector's pages to so many before they are dealt by vector."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("page_id"))
    few = own.distinct().withColumn("r", rank).where(F.col("r") <= kept)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("page_id")).alias("pages"))


def search(index: Index, queries: DataFrame, k: int = 5, probes: int = 8) -> DataFrame:
    """queries: page_id, embedding. The k nearest other pages of each that are found in its probes nearest cells: source_id,
    target_id, distance, place. Equal distances go by page."""
    if k >= index.kept:
        raise ValueError(f"the index names {index.kept} pages of equal vectors, so k can be {index.kept - 1} at most")
    ship.send(queries.sparkSession.sparkContext)
    key = dict(queries.dtypes)["page_id"]
    if not len(index.centres):
        return queries.select(F.col("page_id").alias("source_id"), F.col("page_id").alias("target_id"), F.lit(0.0).alias("distance"), F.lit(1).alias("place")).limit(0)
    own = queries.where("embedding is not null").select(F.col("page_id").alias("source_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    asked = own.withColumn("code", F.xxhash64("vector"))
    one = materialise(asked.select("code", "vector").dropDuplicates(["code", "vector"]).withColumn("cells", _cells_of(index.centres, F.col("vector"), min(probes, len(index.centres)))), "vector-queries")
    looked = one.select(F.explode("cells").alias("cell"), "code", "vector")
    sizes = materialise(looked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / BLOCK).alias("q")), "vector-asked")
    of = F.pmod(F.col("code"), F.col("q")).cast("int")
    q = looked.join(F.broadcast(sizes), "cell").select("cell", of.alias("part"), F.lit(-1).alias("block"), "code", "vector", F.array().cast(f"array<{key}>").alias("pages"))
    t = index.entries.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), (F.col("q") - 1).cast("int"))).alias("part"), "block", "code", "vector", "pages")
    dealt = q.unionByName(t).repartition("cell", "part").sortWithinPartitions("cell", "part", "block")
    found = dealt.mapInArrow(_best_in_cells(k), f"code long, vector array<double>, distance double, pages array<{key}>")
    met = own.withColumn("code", F.xxhash64("vector")).join(found, ["code", "vector"]).select("source_id", "distance", F.explode("pages").alias("target_id")).where("source_id != target_id")
    near = met.groupBy("source_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "target_id"))), 1, k).alias("best"))  # probes * k * kept rows at most
    return near.select("source_id", F.posexplode("best").alias("i", "x")).select("source_id", "x.target_id", "x.distance", (F.col("i") + 1).alias("place"))


def _best_in_cells(k: int):
    """Of rows sorted by (cell, part, block) those of block -1 are the queries, the others pass by; k + 1 entries a query are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, best, schema = None, [], [], None

        def matrix(column) -> np.ndarray:
            flat = column.flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(len(column), -1)

        def done():
            rows = [(code, x, d, pages) for (code, x), held in zip(asked, best, strict=True) for d, pages in held]
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.float64(), schema]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["code", "vector", "distance", "pages"])

        for batch in batches:
            schema = batch.schema.field("pages").type
            cell, part, block = (batch.column(c).to_numpy() for c in ("cell", "part", "block"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | ((block[1:] < 0) != (block[:-1] < 0))) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                rows = batch.slice(int(a), int(b - a))
                if (cell[a], part[a]) != group:
                    if asked:
                        yield done()
                    group, asked, best = (cell[a], part[a]), [], []
                if block[a] < 0:
                    asked += list(zip(rows.column("code").to_pylist(), rows.column("vector").to_pylist(), strict=True))
                    best += [[] for _ in range(len(rows))]
                elif asked:
                    t, pages = matrix(rows.column("vector")), rows.column("pages").to_pylist()
                    x = np.array([v for _, v in asked])
                    tt = (t * t).sum(axis=1)
                    for at in range(0, len(x), 256):
                        far = tt[None, :] - 2 * (x[at : at + 256] @ t.T)
                        near = np.argpartition(far, min(k, len(t) - 1), axis=1)[:, : k + 1]
                        for i, js in enumerate(near):
                            cut = far[i, js].max() + 1e-9 * (1 + abs(far[i, js]).max())
                            js = np.flatnonzero(far[i] <= cut)  # all that may tie
                            d = np.sqrt(np.cumsum((t[js] - x[at + i]) ** 2, axis=1)[:, -1])
                            best[at + i] = sorted(best[at + i] + [(float(e), pages[j]) for e, j in zip(d, js, strict=True)])[: k + 1]
        if asked:
            yield done()

    return run


def probes_for(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.9, measured: int = 400) -> int:
    """The fewest probes with which that share of the k nearest neighbours of at most so many query pages is found.

    queries: page_id. Their exact neighbours are looked up, and each neighbour's cell in the order in which its query looks
    into cells. So the index is measured before it is used; vectors without clusters may need a large part of the cells.
    """
    from . import graph

    if not len(index.centres):
        return 1
    own = vectors.where("embedding is not null").select("page_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    drawn = materialise(queries.select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(measured), "measured-queries")
    exact = graph.nearest_edges(vectors, drawn, k).select("source_id", "target_id")
    order = own.join(F.broadcast(drawn), "page_id", "left_semi").select(F.col("page_id").alias("source_id"), _cells_of(index.centres, F.col("vector"), len(index.centres)).alias("order"))
    placed = exact.join(F.broadcast(order), "source_id").join(own.withColumnRenamed("page_id", "target_id"), "target_id")
    rank = F.array_position("order", F.get(_cells_of(index.centres, F.col("vector"), 1), F.lit(0)))
    ranks = sorted(r["rank"] for r in placed.select(rank.alias("rank")).collect())  # k * measured rows at most
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) if ranks else 1
