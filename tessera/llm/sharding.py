"""Sharding by Karmarkar-Karp differencing: near-equal bytes in each shard, groups of equal texts never divided.

A partial partition is a tuple of one sum for each shard, largest first. Differencing repeatedly takes the two partial
partitions with the largest spread and combines them oppositely ordered: the largest sum of one with the smallest of
the other. It starts from one partial partition for each group, with the group's bytes in the first place.

It runs in rounds. Groups are reduced to one row each (hot groups by partial sums), dealt into buckets of about
BUCKET_GROUPS by their key, and each bucket is differenced on its own into one partial partition. The partial
partitions of buckets are then differenced again, in buckets of FAN_IN, until one is left, so no task and not the
driver ever holds all groups, at any size. The combinations are followed back to each group by joins.

Sizes are the UTF-8 bytes of the text plus 1. Slots number the rows of a shard without gaps from 0, by hash range of
the row and then by id; counts of hash ranges give each range's first slot.

Defined cases: null and empty texts have size 1 and form a group each; repeated rows get slots of their own; an empty
table gives an empty result; if one group is larger than a shard's share it fills a shard alone as far as possible; texts
of any length count whole; ties go to the smaller key; other columns pass through as they are, whatever their names,
but a column named shard is replaced.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, materialise, quoted, small, small_batches, utf8

SHARDS, BUCKET_GROUPS, FAN_IN, SLOT_ROWS = 16, 20_000, 512, 50_000


def difference(parts: list[tuple[int, ...]], shards: int) -> tuple[tuple[int, ...], list[list[int]]]:
    """Combines partial partitions (sums by place, any order) into one, largest sum first.

    Returns its sums, and for each part the place of the result that each of the part's places went to.
    """
    if not parts:
        return (0,) * shards, []
    heap = []
    for k, sums in enumerate(parts):
        order = sorted(range(shards), key=lambda i: (-sums[i], i))
        held = [[(k, i)] if sums[i] else [] for i in order]
        ordered = [sums[i] for i in order]
        heap.append((ordered[-1] - ordered[0], k, ordered, held))
    heapq.heapify(heap)
    n = len(parts)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        joined = []
        for i in range(shards):
            x, y = in_a[i], in_b[shards - 1 - i]
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            joined.append((-(a[i] + b[shards - 1 - i]), i, x))
        joined.sort(key=lambda j: j[:2])
        n += 1
        heapq.heappush(heap, (joined[0][0] - joined[-1][0], n, [-j[0] for j in joined], [j[2] for j in joined]))
    _, _, sums, held = heap[0]
    places = [[-1] * shards for _ in parts]
    for place, members in enumerate(held):
        for k, i in members:
            places[k][i] = place
    for own in places:  # places of sum 0 take the places that are left, so that every place goes somewhere
        left = [p for p in range(shards) if p not in own]
        for i, p in enumerate(own):
            if p < 0:
                own[i] = left.pop(0)
    return tuple(sums), places


def _read(batches: Iterator[pa.RecordBatch]) -> dict[str, list]:
    out: dict[str, list] = {}
    for batch in batches:
        for name, column in zip(batch.schema.names, batch.columns):
            out.setdefault(name, []).extend(column.to_pylist())
    return out


def _first_round(groups: DataFrame, buckets: int, shards: int) -> DataFrame:
    """groups: g1, g2, bytes. Returns g1, g2, node and place, and on one row a node its sums."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bytes", "g1", "g2", "node"))), reverse=True)
        sums, places = difference([(r[0],) + (0,) * (shards - 1) for r in rows], shards)
        return pa.table([
            pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
            pa.array([p[0] for p in places], pa.int32()), pa.array([list(sums)] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
        ], ["g1", "g2", "node", "place", "sums"])

    dealt = groups.withColumn("node", F.pmod(F.col("g1"), F.lit(buckets)))
    return dealt.groupBy("node").applyInArrow(run, "g1 long, g2 long, node long, place int, sums array<long>")


def _next_round(nodes: DataFrame, buckets: int, shards: int) -> DataFrame:
    """nodes: node, sums. Returns node, parent, to (place by place), and on one row a parent its sums."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("node").to_pylist(), table.column("sums").to_pylist(), table.column("parent").to_pylist()))
        sums, places = difference([tuple(r[1]) for r in rows], shards)
        return pa.table([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(places, pa.list_(pa.int32())),
            pa.array([list(sums)] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
        ], ["node", "parent", "to", "sums"])

    return nodes.withColumn("parent", F.pmod(F.col("node"), F.lit(buckets))).groupBy("parent").applyInArrow(run, "node long, parent long, to array<int>, sums array<long>")


def assign_groups(groups: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """groups: g1, g2 (a group's key, both long) and bytes. Returns g1, g2 and shard."""
    small_batches(groups.sparkSession)
    groups = materialise(groups, "shard-groups")
    buckets = max(1, -(-groups.count() // bucket_groups))
    placed = materialise(_first_round(groups, buckets, shards), "shard-nodes")
    nodes = placed.where("sums is not null").select("node", "sums")
    placed = placed.select("g1", "g2", "node", "place")
    while buckets > 1:
        buckets = -(-buckets // fan_in)
        joined = materialise(_next_round(nodes, buckets, shards), "shard-nodes")
        nodes = joined.where("sums is not null").select(F.col("parent").alias("node"), "sums")
        step = joined.select(F.col("node").alias("_n"), "parent", "to")
        placed = placed.join(step, F.col("node") == F.col("_n")).select("g1", "g2", F.col("parent").alias("node"), F.element_at("to", F.col("place") + 1).alias("place"))
    return placed.select("g1", "g2", F.col("place").alias("shard"))


def with_slots(rows: DataFrame, n_rows: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """rows: doc_id, shard, g1 and others. Adds slot. Rows are dealt by a hash of all that tells them apart."""
    ranges = max(1, -(-n_rows // slot_rows))
    rows = rows.withColumn("_range", F.pmod(F.xxhash64("doc_id", "g1"), F.lit(ranges)).cast("int"))
    counts = rows.groupBy("shard", "_range").count()
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    rows = rows.join(first, (F.col("shard") == F.col("_s")) & (F.col("_range") == F.col("_r")))
    own = Window.partitionBy("shard", "_range").orderBy(F.col("doc_id").asc_nulls_first(), "g1")
    return rows.withColumn("slot", F.col("_first") + F.row_number().over(own) - 1).drop("_range", "_s", "_r", "_first")


def group_key() -> dict:
    """Key of a group of equal texts. Different texts with one key (2**-64) only stay together."""
    return {"g1": F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()), "g2": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1}


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, g1, shard and slot of each row."""
    key = group_key()
    sized = docs.select("doc_id", key["g1"].alias("g1"), key["g2"].alias("size"), F.crc32(F.coalesce(utf8("text"), F.lit(b""))).alias("text_crc32"))
    sized = materialise(sized, "shard-sizes")
    groups = sized.groupBy("g1", F.col("size").alias("g2")).agg(F.sum("size").alias("bytes"))
    homes = assign_groups(groups, shards).select(F.col("g1").alias("_g1"), F.col("g2").alias("_g2"), "shard")
    placed = materialise(sized.join(homes, (F.col("g1") == F.col("_g1")) & (F.col("size") == F.col("_g2"))).drop("_g1", "_g2"), "shard-homes")
    return with_slots(placed, placed.count())


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard (in place of a column of that name); texts that are equal share one. Slots are given where rows are few columns: see shard_rows."""
    docs, key = docs.drop("shard"), group_key()
    own = quoted(docs)
    a, b, c, d = fresh(docs, "g1", "g2", "h1", "h2")
    sized = materialise(docs.select(key["g1"].alias("g1"), key["g2"].alias("g2")).groupBy("g1", "g2").agg(F.sum("g2").alias("bytes")), "shard-sizes")
    homes = materialise(assign_groups(sized, shards).select(F.col("g1").alias(c), F.col("g2").alias(d), "shard"), "shard-homes")
    wide = docs.withColumns({a: key["g1"], b: key["g2"]}).join(small(homes), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)))
    return wide.select(*own, "shard")
