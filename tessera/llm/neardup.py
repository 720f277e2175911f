"""Near-duplicates by MinHash: banded candidates, odd sketches to verify them, full sets to confirm links.

A document's set holds its distinct shingles of SHINGLE consecutive words (64-bit hashes; fewer words: the whole
sequence is one). Two documents are linked if 100 * intersection >= PERCENT * union.

* Documents with equal sets are one node, keyed by a 64-bit hash of the set; their copies are never paired.
* BANDS bands of ROWS MinHash samples give buckets. At the similarity 0.8 a pair shares no bucket with a probability of
  (1 - 0.8**5)**36 = 6e-7.
* An odd sketch holds the parity of all samples folded into BITS bits. The population count c of two sketches' XOR
  estimates the similarity as 1 + BITS / (4 k) * ln(1 - 2 c / BITS), k = BANDS * ROWS. A candidate passes at an estimate of
  0.6 or more, over four standard deviations below 0.8.
* Candidates are the pairs of a bucket that pass. They are never listed: a bucket's lead is the node whose buckets are
  largest, so the original of a group of altered copies; each node is tried against the lead that it shares most buckets
  with. Where that leaves a bucket in several components, its nodes are compared sketch by sketch if they are at most
  BLOCK, and each bucket sends a spanning forest of what passes; the nodes of a larger bucket count as candidates of each
  other. So clusters, the components of all candidates, are found whole.
* Pairs with a lead are confirmed on the full sets, made again from the texts of the clusters' nodes. A cluster that
  falls into several components is then compared set by set: the nodes outside its largest component against all
  others, in blocks (of BLOCK nodes and SET_BYTES at most, about), each sending a spanning forest of its links.
* A cluster of more than one block is first divided, so that pages of one template, which are all candidates but seldom
  links, cost no more than their number. Shingles are ordered by how many nodes of such clusters hold them (counted in
  SLOTS slots), rarest first. Two linked sets of n >= m shingles share at least o = PERCENT (n + m) / (100 + PERCENT), so
  the smaller has one shared shingle among its first m - o + 1 <= m - o(m, m) + 1, the larger among its first
  n - o + 1 <= n - o(n, PERCENT n / 100) + 1. Nodes that meet at such a shingle, are in different components and
  whose odd sketches pass make the parts that are compared set by set. A template's own shingles come last in the order.

So no step emits the pairs of a group, and no link between two components goes untried.

Defined cases: null texts and texts without words have empty sets and are linked with nothing; rows that repeat an
id and text are copies of each other; rows of one id with different texts are different documents that share an id; a
null id is never the smallest of a group that has other ids; texts of any length are read whole, shingle by shingle; an
empty table gives an empty result; columns other than doc_id and text are not read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, materialise, quoted, small, small_batches, utf8
from .graph import components, contracted

SHINGLE, PERCENT, BANDS, ROWS, BITS, BLOCK, SET_BYTES = 5, 80, 36, 5, 512, 512, 2 << 20
#: Counters of shingles that order them; a power of two.
SLOTS = 1 << 20
#: Copies of one text from which its rows find their group by a broadcast of it (there are at most rows / HOT_ROWS such texts).
HOT_ROWS = 100_000
LEAST_ESTIMATE = 0.6
_CACHE = 100_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.Generator(np.random.PCG64(7))
_MULTIPLIERS = (_SEEDS.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_OFFSETS = _SEEDS.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]
_words: dict[bytes, int] = {}
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def most_bits(estimate: float = LEAST_ESTIMATE) -> int:
    """The population count that stands for an estimate."""
    return int(BITS / 2 * (1 - np.exp(-4 * BANDS * ROWS * (1 - estimate) / BITS)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _PRIME
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of shingles of white-space separated words, A-Z lower-cased."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > _CACHE:
        _words.clear()
    get, ids = _words.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    ids = np.array(ids, np.uint64)
    n = min(shingle, len(ids))
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h ^ ids[j : len(ids) - n + 1 + j])
    return np.unique(h)


def sketch(s: np.ndarray) -> tuple[list[int], list[int]]:
    """Bucket keys of the bands, and the odd sketch as 64-bit words (both signed)."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[None, at : at + 1024] * _MULTIPLIERS + _OFFSETS).min(axis=1), out=low)
    rows = low.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key ^ rows[:, r])
    place = _mix(low.astype(np.uint64) | (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32))) >> np.uint64(40)
    odd = np.packbits((np.bincount(place.astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8))
    return _mix(key).view(np.int64).tolist(), odd.view(np.int64).tolist()


def node_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sketches(text: Column, shingle: int) -> Column:
    @F.arrow_udf("n long, node long, bands array<long>, odd array<long>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            rows = []
            for t in batch.to_pylist():
                s = shingle_set(t, shingle)
                rows.append((len(s), node_key(s), *sketch(s)) if len(s) else (0, None, None, None))
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), longs, longs))], ["n", "node", "bands", "odd"])

    return make(utf8(text))


def _sets(text: Column, shingle: int) -> Column:
    @F.arrow_udf("node long, members binary")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([node_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])

    return make(utf8(text))


def _linked(left: Column, right: Column, percent: int) -> Column:
    @F.arrow_udf("boolean")
    def judge(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return judge(left, right)


def _full_sets(docs: DataFrame, clusters: DataFrame, shingle: int) -> DataFrame:
    """node, members of the nodes of clusters (node, row); docs: row, text. Only one document of each node is read again."""
    made = docs.join(small(clusters.select("row")), "row", "left_semi").select(_sets(F.col("text"), shingle).alias("s")).select("s.*")
    return materialise(made.dropDuplicates(["node"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
    return both.where(_linked(F.col("of_a"), F.col("of_b"), percent)).select("a", "b")


def _passes(percent: int) -> Column:
    apart = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (apart <= most_bits())


def spanning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of edges between labels x[k] and y[k], the numbers k of a spanning forest."""
    labels, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    edge = np.full((len(labels), len(labels)), -1)
    edge[x, y] = edge[y, x] = np.arange(len(x))
    seen, kept = np.zeros(len(labels), bool), []
    for root in range(len(labels)):
        if seen[root]:
            continue
        seen[root] = True
        todo = [root]
        while todo:
            u = todo.pop()
            near = np.flatnonzero((edge[u] >= 0) & ~seen)
            seen[near] = True
            kept.append(edge[u, near])
            todo.extend(near.tolist())
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def similar_sketches(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Whether pairs of two sides (sizes n, sketches as rows of 64-bit words) pass."""
    apart = np.zeros((len(a[0]), len(b[0])), np.int64)
    for k in range(BITS // 64):
        apart += np.bitwise_count(a[1][:, k, None] ^ b[1][None, :, k])
    n, m = a[0][:, None], b[0][None, :]
    return (apart <= most_bits()) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)


def similar_sets(a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Whether pairs of two sides' sets are links. Hashes that only one set has are left out, the others multiplied as 0/1 matrices in slices."""
    sets = [np.frombuffer(x, np.uint64) for x in (*a, *b)]
    n = np.array([len(x) for x in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (first, first + 4096))
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[lo:hi], column[lo:hi] - first] = 1
        both += x[: len(a)] @ x[len(a) :].T
    both = both.astype(np.int64)
    return 100 * both >= percent * (n[: len(a), None] + n[None, len(a) :] - both)


def _compared(dealt: DataFrame, payload: str, percent: int) -> DataFrame:
    """dealt: k, i, j (a block pair), own (the row's block), node, label, and by payload members, n and odd, or n, odd and first.

    Rows a, b, marked: for each block pair a spanning forest, over labels, of the pairs of different labels that are similar
    (labels a and b, marked false). With the payload first, also each node a with its label b that such a pair holds (marked true).
    """
    dealt = dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")

    def judged(left: list[tuple], right: list[tuple]) -> np.ndarray:
        if payload == "members":
            return similar_sets([r[6] for r in left], [r[6] for r in right], percent)
        sides = [(np.array([r[6] for r in side], np.int64), np.array([r[7] for r in side], np.int64).view(np.uint64)) for side in (left, right)]
        ok = similar_sketches(*sides, percent)
        if payload == "first":
            n, m = sides[0][0][:, None], sides[1][0][None, :]
            x, y = (np.array([r[8] for r in side], bool) for side in (left, right))
            ok &= ((n <= m) & x[:, None]) | ((m <= n) & y[None, :])
        return ok

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch | None:
            _, i, j = held[0][:3]
            left = [r for r in held if r[3] == i]
            right = left if i == j else [r for r in held if r[3] == j]
            if not left or not right:
                return None
            labels = [np.array([r[5] for r in side], np.int64) for side in (left, right)]
            differ = labels[0][:, None] != labels[1][None, :]
            if not differ.any():
                return None
            x, y = np.nonzero(judged(left, right) & differ)
            if not len(x):
                return None
            kept = spanning(labels[0][x], labels[1][y])
            a, b = labels[0][x[kept]], labels[1][y[kept]]
            marked = np.zeros(len(a), bool)
            if payload == "first":
                for side, at, own in ((left, np.unique(x), labels[0]), (right, np.unique(y), labels[1])):
                    a, b = np.concatenate([a, [side[k][4] for k in at.tolist()]]), np.concatenate([b, own[at]])
                marked = np.arange(len(a)) >= len(marked)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(marked)], ["a", "b", "marked"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    if (out := flush()) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := flush()) is not None:
            yield out

    return dealt.mapInArrow(compare, "a long, b long, marked boolean").distinct()


def _met(rows: DataFrame, *payload: str) -> DataFrame:
    """rows: k, node, label, inner, outer_blocks, inner_blocks and the payload. Each row once for each block pair that its block is in.

    Blocks of the outer nodes are numbered from 0, those of the inner ones after them. Outer blocks meet all blocks.
    """
    own = F.when(F.col("inner"), F.col("outer_blocks") + F.pmod(F.xxhash64("node"), F.col("inner_blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer_blocks"))).cast("int")
    others = F.when(F.col("inner"), F.col("outer_blocks")).otherwise(F.col("outer_blocks") + F.col("inner_blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), others - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.withColumns({"own": own, "m": F.explode(meets)}).select("k", "m.i", "m.j", "own", "node", "label", *payload)


def _clusters(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs with a bucket's lead, and node, cluster of all nodes that have a candidate."""
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = materialise(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-buckets")
    members = materialise(dealt.join(small(shared), "bucket"), "near-members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    lead = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("lead"))
    # of the leads of its buckets each node tries the one that it shares most buckets with
    common = members.join(lead, "bucket").where("node != lead").groupBy("lead", "node").agg(F.count(F.lit(1)).alias("buckets"))
    star = common.groupBy("node").agg(F.max(F.struct("buckets", "lead"))["lead"].alias("a")).select("a", F.col("node").alias("b"))
    sides = [nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("odd").alias(f"odd_{k}")) for k in "ab"]
    star = materialise(star.join(sides[0], "a").join(sides[1], "b").where(_passes(percent)).select("a", "b"), "near-star")
    labels = components(star)
    labelled = members.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("held")).where("low != high")
    split = materialise(split.select("bucket", "low", "held"), "near-split")
    one = F.lit(1).cast("long")
    little = labelled.join(small(split.where(F.col("held") <= BLOCK).select("bucket")), "bucket").withColumnRenamed("bucket", "k")
    little = little.join(nodes.select("node", "n", "odd"), "node").withColumns({"inner": F.lit(False), "outer_blocks": one, "inner_blocks": one * 0})
    joints = _compared(_met(little, "n", "odd"), "odd", percent).select("a", "b")
    large = labelled.join(small(split.where(F.col("held") > BLOCK).select("bucket", "low")), "bucket").where("label != low")
    joints = joints.unionByName(large.select(F.col("low").alias("a"), F.col("label").alias("b")).distinct())
    return star, contracted(labels, joints).withColumnRenamed("label", "cluster")


def _blocks(parts: DataFrame) -> DataFrame:
    """parts: cluster, label, node, bytes. cluster, largest, outer_blocks and inner_blocks of the clusters of several labels."""
    sums = parts.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("held"), F.sum("bytes").alias("bytes"))
    whole = sums.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.sum("held").alias("held"), F.sum("bytes").alias("bytes"), F.max(F.struct("held", "label", "bytes")).alias("most")).where("parts > 1")

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / SET_BYTES), F.lit(1))

    return whole.select("cluster", F.col("most.label").alias("largest"), blocks(F.col("held") - F.col("most.held"), F.col("bytes") - F.col("most.bytes")).alias("outer_blocks"), blocks(F.col("most.held"), F.col("most.bytes")).alias("inner_blocks"))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many of n ordered members a linked set of the same size or larger, and one of any size, must meet."""
    def shared(m: int) -> int:
        return -(-percent * (n + m) // (100 + percent))

    return n - shared(n) + 1, n - shared(-(-percent * n // 100)) + 1


def _slots(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(8)) & np.uint64(SLOTS - 1)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a member of each slot (about: a set counts each of its members); SLOTS numbers at any size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                held += np.bincount(_slots(np.frombuffer(m, np.uint64)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for slot, n in sets.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[slot] = n
    return out


def _divided(large: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """large: cluster, node, label. cluster (a part's), node and label of the nodes that may be linked with one of another label."""
    held = materialise(large.join(sets, "node").select("members", "cluster", "node", "label"), "near-large")
    counts = held.sparkSession.sparkContext.broadcast(_slot_counts(held))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            for members, cluster, node, label in zip(*(c.to_pylist() for c in batch.columns)):
                m = np.frombuffer(members, np.uint64)
                short, long = prefix_lengths(len(m), percent)
                m = m[np.lexsort((m, order[_slots(m).astype(np.int64)]))[:long]]
                key = _mix(m ^ _mix(np.array([cluster], np.int64).view(np.uint64))).view(np.int64)
                one = lambda x: pa.array(np.full(len(key), x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), one(node), one(label), pa.array(np.arange(len(key)) < short)], ["k", "node", "label", "first"])

    keyed = materialise(held.mapInArrow(prefixes, "k long, node long, label long, first boolean"), "near-prefixes")
    useful = keyed.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if("first").alias("outer"), F.count(F.lit(1)).alias("held")).where("outer > 0 and low != high")
    useful = materialise(useful.select("k", F.ceil(F.col("outer") / BLOCK).alias("outer_blocks"), F.ceil((F.col("held") - F.col("outer")) / BLOCK).alias("inner_blocks")), "near-useful")
    rows = keyed.join(small(useful), "k").withColumn("inner", ~F.col("first")).join(nodes.select("node", "n", "odd"), "node")
    found = materialise(_compared(_met(rows, "n", "odd", "first"), "first", percent), "near-meets")
    parts = components(found.where("not marked"))
    marked = found.where("marked").select(F.col("a").alias("node"), F.col("b").alias("label")).distinct()
    return marked.join(parts.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label").select("cluster", "node", "label")


def _rest(clusters: DataFrame, nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between the components (labels: node, label) that a cluster still falls into, as label pairs a, b: a spanning forest of each block pair."""
    sized = sets.select("node", F.octet_length("members").cast("long").alias("bytes"))
    labelled = clusters.select("cluster", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sized, "node")
    labelled = materialise(labelled.select("cluster", "node", "label", "bytes"), "near-parts")
    whole = materialise(_blocks(labelled), "near-whole")
    alone = (F.col("outer_blocks") == 1) & (F.col("inner_blocks") == 1)

    def dealt(parts: DataFrame, blocks: DataFrame) -> DataFrame:
        rows = parts.join(blocks, "cluster").join(sets, "node").withColumns({"inner": F.col("label") == F.col("largest"), "k": F.col("cluster")})
        return _met(rows, "members")

    todo = dealt(labelled, whole.where(alone))
    if not whole.where(~alone).isEmpty():
        large = labelled.join(whole.where(~alone).select("cluster"), "cluster", "left_semi")
        parts = materialise(_divided(large, sets, nodes, percent).join(sized, "node"), "near-divided")
        todo = todo.unionByName(dealt(parts, _blocks(parts)))
    return _compared(todo, "members", percent).select("a", "b")


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows with one key are the same in all of them."""
    return F.xxhash64(*(c for c, f in zip(quoted(docs), docs.schema) if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))))


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """docs: doc_id, text, row (a long that is the same only on rows with equal id and text). doc_id, row, n (shingles) and best
    of each: the id and row of its group's first row (by id, nulls last, then row); null without shingles."""
    small_batches(docs.sparkSession)
    made = materialise(docs.select("doc_id", "row", _sketches(F.col("text"), shingle).alias("s")).select("doc_id", "row", "s.*"), "near-sketches")
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    nodes = made.where("n > 0").groupBy("node").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    nodes = materialise(nodes, "near-nodes")
    star, clusters = _clusters(nodes, percent)
    clusters = materialise(clusters.join(nodes.select("node", F.col("best.row").alias("row")), "node"), "near-clusters")
    sets = _full_sets(docs.select("row", "text"), clusters, shingle)
    labels = components(_confirmed(star, sets, percent))
    labels = contracted(labels, _rest(clusters, nodes, sets, labels, percent))

    known = materialise(nodes.select("node", "best", "rows").join(labels, "node"), "near-known")
    lowest = known.groupBy("label").agg(F.min("best").alias("best"))
    groups = known.drop("best").join(lowest, "label").select("node", "best", "rows")
    copied = nodes.where("rows > 1").select("node", "best", "rows").join(labels.select("node"), "node", "left_anti")
    groups = materialise(groups.unionByName(copied), "near-groups")
    # a row whose node has no other row and no link is its own group; groups of hot texts are broadcast, so no task gets all copies
    alone = F.when(F.col("n") > 0, first)
    hot = groups.where(F.col("rows") >= HOT_ROWS).select("node", F.col("best").alias("hot"))
    rows = made.select("doc_id", "row", "n", "node").join(F.broadcast(hot), "node", "left")
    rest = groups.where(F.col("rows") < HOT_ROWS).select("node", "best")
    near = small(rest)
    if near is not rest:
        return rows.join(near, "node", "left").select("doc_id", "row", "n", F.coalesce("hot", "best", alone).alias("best"))
    cold = rows.where("n > 0 and hot is null").join(rest, "node", "left").select("doc_id", "row", "n", F.coalesce("best", alone).alias("best"))
    return cold.unionByName(rows.where("n = 0 or hot is not null").select("doc_id", "row", "n", F.col("hot").alias("best")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document (kept: it has the smallest id of its group)."""
    judged = _judged(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")), shingle, percent)
    component = F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    out = judged.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group: that of the smallest id, then of the smallest hash of all its columns.

    Rows are told apart by id and that hash, so a row never goes because another has its id; rows that are equal in
    all columns stay once; rows without shingles all stay.
    """
    own = quoted(docs)
    row, gone_id, gone_row = fresh(docs, "row", "gone_id", "gone_row")
    keyed = docs.withColumn(row, _row_key(docs))
    judged = materialise(_judged(keyed.select("doc_id", "text", F.col(row).alias("row")), shingle, percent), "near-judged")
    best = (F.col("row") == F.col("best.row")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    named = [F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row)]
    gone = materialise(judged.where((F.col("n") > 0) & ~best).select(*named).distinct(), "near-gone")
    again = materialise(judged.where((F.col("n") > 0) & best).select(*named).groupBy(gone_id, gone_row).count().where("count > 1").drop("count"), "near-again")
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(row) == F.col(gone_row))
    left = keyed.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return left.select(*own)
    repeated = left.join(small(again), same, "left_semi").dropDuplicates(["doc_id", row])
    return left.join(small(again), same, "left_anti").unionByName(repeated).select(*own)


#: For four-word shingles.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN groups USING (doc_id)
"""
