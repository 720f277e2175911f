"""Link graphs: building edges, traversal, orphans, one-way references, membership, communities."""
from __future__ import annotations

from collections.abc import Iterable
from itertools import count
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ship, text as T
from ..sources.scratch import materialise

#: Query pages that a task holds, and vectors that pass it at a time.
VECTOR_BLOCK = 4096
#: Pages of one keyword up to which they are paired for that keyword alone.
HOT_PAGES = 2000
#: Pages of two keywords up to which they are paired for those; with more they are counted by families.
HOT_PAIR_PAGES = 1000
#: Frequent pairs of keywords that may be sent to every task.
BROADCAST_KEYS = 1_000_000


def names(pages: DataFrame) -> DataFrame:
    """name, page_id: titles and file stems. Of pages with one name the last by path counts."""
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.md$", "")
    both = pages.select("page_id", "rel_path", F.explode(F.array(F.col("title"), stem)).alias("name"))
    return both.where("name is not null").groupBy("name").agg(F.max_by("page_id", F.struct("rel_path", "page_id")).alias("page_id"))


def link_edges(pages: DataFrame) -> DataFrame:
    """pages: page_id, rel_path, title, body, related (array). source_id, target_id, edge_type, weight.

    Related pages are linked in both directions with weight 2, links in the body in their own with weight 1. Links to
    nothing and to the page itself are left out; equal links of a type count once.
    """
    known = names(pages).withColumnRenamed("page_id", "target_id")
    clean = F.transform(F.coalesce("related", F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), r"""^["'\[]+|["'\]]+$""", ""), r"\|.*$", "")))
    related = pages.select(F.col("page_id").alias("source_id"), F.explode(clean).alias("name"), F.lit("related").alias("edge_type"), F.lit(2.0).alias("weight"))
    inner = pages.select(F.col("page_id").alias("source_id"), F.explode(T.wikilinks(F.col("body"))).alias("name"), F.lit("wikilink").alias("edge_type"), F.lit(1.0).alias("weight"))
    found = related.unionByName(inner).join(known, "name").where("source_id != target_id").select("source_id", "target_id", "edge_type", "weight")
    back = found.where("edge_type = 'related'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "edge_type", "weight")
    return found.unionByName(back).dropDuplicates(["source_id", "target_id", "edge_type"])


def cooccurrence(keywords: DataFrame, least: int = 2, hot: int | None = None, hot_pages: int = HOT_PAGES) -> DataFrame:
    """keywords: page_id, keyword. Pairs a < b with at least so many keywords in common: a, b, shared.

    Keywords of up to hot_pages pages pair their pages, and pairs are counted; so rows made grow with the keywords, not
    with a keyword's square. Pages of a keyword that more hold don't meet for it alone: they meet at a keyword of few
    pages or, if least is 2 or more, at two hot keywords; what they share of the hot ones is then added. Two pages with two
    hot keywords in common are an edge, so edges of a group that shares two keywords are as many as its pairs.
    hot leaves out keywords of more than so many pages; None keeps all.
    """
    own = keywords.select("page_id", "keyword").distinct()
    if hot is not None:
        own = own.join(own.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hot).select("keyword"), "keyword", "left_semi")
    own = materialise(own, "keyword-pairs")
    many = materialise(own.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_pages).select("keyword"), "hot-keywords")
    if least < 2 or many.isEmpty():
        return _met(own).where(F.col("shared") >= least)
    few, held = own.join(many, "keyword", "left_anti"), own.join(many, "keyword", "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_list("keyword")).alias("held"))
    held = materialise(held, "hot-held")
    two = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    by_two = _met(held.select("page_id", F.explode(two).alias("keyword"))).withColumn("shared", F.lit(0).cast("long"))
    met = _met(few).unionByName(by_two).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for side in ("a", "b"):
        met = met.join(held.select(F.col("page_id").alias(side), F.col("held").alias(f"held_{side}")), side, "left")
    both = F.coalesce(F.size(F.array_intersect("held_a", "held_b")), F.lit(0))
    return met.select("a", "b", (F.col("shared") + F.greatest(both, F.lit(0))).alias("shared")).where(F.col("shared") >= least)


def _met(own: DataFrame) -> DataFrame:
    """a, b, shared: how many keys (keyword) two pages have in common."""
    a, b = own.select(F.col("page_id").alias("a"), "keyword"), own.select(F.col("page_id").alias("b"), "keyword")
    return a.join(b, "keyword").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def cooccurrence_links(keywords: DataFrame, least: int = 2) -> DataFrame:
    """keywords: page_id, keyword. One row a page with keywords: page_id, class_id (the smallest page with just the same ones), n_links (how
    many pages have at least so many keywords in common with it) and shared (how many they have, all together), as counting cooccurrence says.

    Pairs are not listed. Pages with the same keywords are one class; of other classes it is counted how many pages hold each set of the
    class' keywords. A page with s keywords in common holds C(s, j) sets of j, so sums over sets, weighed by inclusion and exclusion, count
    each page once. Sets grow by a keyword at a time, and only those go on that another class holds too. Rows grow with the pages.
    """
    own = keywords.select("page_id", "keyword").distinct()
    lists = materialise(own.groupBy("page_id").agg(F.array_sort(F.collect_list("keyword")).alias("held")), "keyword-lists")
    classes = materialise(lists.groupBy("held").agg(F.min("page_id").alias("class_id"), F.count(F.lit(1)).alias("size")), "keyword-classes")
    ids = materialise(classes.select(F.explode("held").alias("keyword")).distinct().withColumn("last", F.monotonically_increasing_id()), "keyword-ids")
    prefix = F.array().cast("array<bigint>").alias("prefix")
    sets = classes.select("class_id", "size", F.explode("held").alias("keyword")).join(ids, "keyword").select("class_id", "size", prefix, "last")
    inside = F.when(F.size("held") >= least, F.col("size") - 1).otherwise(0).cast("long")
    sums = classes.select("class_id", inside.alias("n_links"), (inside * F.size("held")).alias("shared"))
    j = 0
    while True:
        j += 1
        held = sets.groupBy("prefix", "last").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        kept = materialise(sets.join(held, ["prefix", "last"]).select("class_id", "size", "prefix", "last", (F.col("n") - F.col("size")).alias("others")), "keyword-sets")
        if kept.isEmpty():
            break
        # what a set of j is worth, so that C(s, j) of them come to 1, or to s, for s in common
        ones, many = (sum((-1) ** (j - s) * comb(j, s) * f(s) for s in range(least, j + 1)) for f in (lambda s: 1, lambda s: s))
        if ones or many:
            sums = sums.unionByName(kept.groupBy("class_id").agg(F.sum("others").alias("others")).select("class_id", (F.col("others") * ones).alias("n_links"), (F.col("others") * many).alias("shared")))
        wider = kept.groupBy("class_id", "size", "prefix").agg(F.array_sort(F.collect_list("last")).alias("lasts")).where(F.size("lasts") > 1)
        two = F.flatten(F.transform("lasts", lambda x, i: F.transform(F.slice("lasts", i + 2, F.size("lasts")), lambda y: F.struct(F.concat("prefix", F.array(x)).alias("prefix"), y.alias("last")))))
        sets = wider.select("class_id", "size", F.explode(two).alias("z")).select("class_id", "size", "z.prefix", "z.last")
    found = sums.groupBy("class_id").agg(F.sum("n_links").alias("n_links"), F.sum("shared").alias("shared"))
    return lists.join(classes.select("held", "class_id"), "held").join(found, "class_id").select("page_id", "class_id", "n_links", "shared")


def cooccurrence_near(keywords: DataFrame, seeds: DataFrame, depth: int = 2, least: int = 2) -> DataFrame:
    """The edges of cooccurrence that a walk of so many steps from the seeds (page_id) can take: source_id, target_id, weight 1.

    Pairs are made only from pages that the walk has reached, so the whole graph is never built.
    """
    own = keywords.select("page_id", "keyword").distinct()
    other = own.select(F.col("page_id").alias("target_id"), "keyword")
    reached = seeds.select("page_id").distinct()
    for step in range(depth):
        pairs = own.join(reached, "page_id", "left_semi").join(other, "keyword").where("page_id != target_id").groupBy(F.col("page_id").alias("source_id"), "target_id").agg(F.count(F.lit(1)).alias("shared"))
        edges = materialise(pairs.where(F.col("shared") >= least).select("source_id", "target_id", F.lit(1.0).alias("weight")), "near-edges")
        reached = reached.unionByName(edges.select(F.col("target_id").alias("page_id"))).distinct()
    return edges


def first_linked(keywords: DataFrame, k: int, least: int = 2, batch: int = 256) -> DataFrame:
    """page_id: the k smallest pages that have an edge of cooccurrence. Pages are asked in order, each time twice as many, until k are found; the whole graph is never built."""
    own = materialise(keywords.select("page_id", "keyword").distinct(), "keyword-pairs")
    other = own.select(F.col("page_id").alias("other"), "keyword")
    found, rest = None, own
    while True:
        asked = materialise(rest.select("page_id").distinct().orderBy("page_id").limit(batch), "pages-asked")
        last = asked.agg(F.max("page_id")).first()[0]
        pairs = own.join(asked, "page_id", "left_semi").join(other, "keyword").where("page_id != other").groupBy("page_id", "other").agg(F.count(F.lit(1)).alias("shared"))
        linked = materialise(pairs.where(F.col("shared") >= least).select("page_id").distinct(), "pages-linked")
        found = linked if found is None else found.unionByName(linked)
        if last is None or found.count() >= k:
            return found.orderBy("page_id").limit(k)
        rest, batch = rest.where(F.col("page_id") > last), batch * 2


def weighted_graph(edges: DataFrame, keywords: DataFrame, per_keyword: float = 0.1, vectors: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Undirected a < b with summed weights: links, shared keywords (two at least), and, if vectors (page_id, embedding) are given,
    the k nearest of each page that neither touches, by 1 / (1 + distance)."""
    links = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "weight")
    shared = cooccurrence(keywords).select("a", "b", (F.col("shared") * per_keyword).alias("weight"))
    both = links.unionByName(shared)
    if vectors is not None:
        both = materialise(both, "weighted-edges")
        lone = isolated(vectors, both.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")))
        near = nearest_edges(vectors, lone, k).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), (1 / (1 + F.col("distance"))).alias("weight"))
        both = both.unionByName(near.dropDuplicates(["a", "b"]))  # two lone pages that are near each other make one edge
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def isolated(pages: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.explode(F.array("source_id", "target_id")).alias("page_id")).distinct()
    return pages.select("page_id").join(touched, "page_id", "left_anti")


def nearest_edges(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5) -> DataFrame:
    """vectors: page_id, embedding; queries: page_id. The k nearest others of each query page (of every page if None): source_id, target_id, distance, place.

    Exact at any number of query pages: a task holds one block of them, and the blocks of all vectors pass by.
    """
    ship.send(vectors.sparkSession.sparkContext)
    vectors = vectors.where("embedding is not null").select("page_id", "embedding")
    wanted = vectors if queries is None else vectors.join(queries.select("page_id").distinct(), "page_id", "left_semi")
    key = dict(vectors.dtypes)["page_id"]
    sources, targets = (_vector_blocks(df) for df in (wanted, vectors))
    n = max(1, -(-wanted.count() // VECTOR_BLOCK))
    met = sources.select("block", F.lit(-1).alias("other"), "ids", "flat").unionByName(targets.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.col("block").alias("other"), "ids", "flat"))
    dealt = met.repartition(n, "block").sortWithinPartitions("block", "other")
    return dealt.mapInArrow(_nearest_of_blocks(k), f"source_id {key}, target_id {key}, distance double, place int")


def _vector_blocks(vectors: DataFrame) -> DataFrame:
    """block, ids, flat: about VECTOR_BLOCK vectors in a row, one after another."""
    block = F.pmod(F.xxhash64("page_id"), F.lit(max(1, -(-vectors.count() // VECTOR_BLOCK)))).cast("int")
    return vectors.groupBy(block.alias("block")).agg(F.collect_list("page_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("flat"))


def _nearest_of_blocks(k: int):
    """Of rows sorted by (block, other) the first of a block has the queries. Products screen; what may be among the k is measured term by term, so that equal vectors tie."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def better(held, x, x_id, t, t_id):
            """The best k (distance, id) of each query so far and of these targets."""
            tt = (t * t).sum(axis=1)
            out = []
            for start in range(0, len(x), 256):
                q, q_id = x[start : start + 256], x_id[start : start + 256]
                qq = (q * q).sum(axis=1)
                far = qq[:, None] + tt[None, :] - 2 * (q @ t.T)
                far[q_id[:, None] == t_id[None, :]] = np.inf
                place = min(k, len(t)) - 1
                cut = np.partition(far, place, axis=1)[:, place]
                known = np.array([h[0][-1] ** 2 if len(h[0]) == k else np.inf for h in held[start : start + 256]])
                cut = np.minimum(cut, known) + 1e-9 * (qq + tt.max() + 1)
                for i in range(len(q)):
                    at = np.flatnonzero((far[i] <= cut[i]) & (far[i] < np.inf))
                    distance, ids = held[start + i]
                    if len(at):
                        distance = np.concatenate([distance, np.sqrt(np.cumsum((t[at] - q[i]) ** 2, axis=1)[:, -1])])
                        ids = np.concatenate([ids, t_id[at]])
                        best = np.lexsort((ids, distance))[:k]
                        distance, ids = distance[best], ids[best]
                    out.append((distance, ids))
            return out

        def found(held, x_id):
            n = [len(h[0]) for h in held]
            return pa.RecordBatch.from_pydict({"source_id": np.repeat(x_id, n), "target_id": np.concatenate([h[1] for h in held]), "distance": np.concatenate([h[0] for h in held]), "place": np.concatenate([np.arange(1, m + 1, dtype="int32") for m in n])})

        block, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["ids"][i].values.to_numpy(zero_copy_only=False)
                ids = ids.astype("U") if ids.dtype == object else ids
                flat = batch["flat"][i].values.to_numpy(zero_copy_only=False).astype("float64").reshape(len(ids), -1)
                if batch["other"][i].as_py() == -1:
                    if held:
                        yield found(held, x_id)
                    block, x, x_id, held = batch["block"][i].as_py(), flat, ids, [(np.empty(0), ids[:0])] * len(ids)
                elif batch["block"][i].as_py() == block:
                    held = better(held, x, x_id, flat, ids)
        if held:
            yield found(held, x_id)

    return run


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pages within depth links of the seeds (page_id, distance), and the edges that leave them, ends outside included."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct()
    reached = seeds.select("page_id").distinct().withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        near = both.join(reached.where(F.col("distance") == d - 1), both.a == reached.page_id).select(F.col("b").alias("page_id")).distinct()
        reached = reached.unionByName(near.join(reached, "page_id", "left_anti").withColumn("distance", F.lit(d)))
    kept = both.join(reached.select(F.col("page_id").alias("a")), "a", "left_semi")
    return reached, kept


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Least distance of each page within depth links, in the links' direction: a step for each link, each page once."""
    own = edges.select(F.col("source_id").alias("page_id"), "target_id").distinct()
    reached = materialise(seeds.select("page_id").distinct().withColumn("distance", F.lit(0)), "reached")
    for d in range(1, depth + 1):
        near = own.join(reached.where(F.col("distance") == d - 1), "page_id").select(F.col("target_id").alias("page_id")).distinct()
        near = materialise(near.join(reached, "page_id", "left_anti").withColumn("distance", F.lit(d)), "reached")
        if near.isEmpty():
            break
        reached = reached.unionByName(near)
    return reached


def inbound(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Links that point at each page, from itself included."""
    counts = edges.groupBy(F.col("target_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("inbound"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    return pages.select("page_id").join(edges.select(F.col("target_id").alias("page_id")).distinct(), "page_id", "left_anti")


def one_way(edges: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Links whose reverse is missing; links from and to hubs are exempt."""
    own = edges.select("source_id", "target_id").distinct()
    back = own.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    out = own.join(back, ["source_id", "target_id"], "left_anti")
    for side in ("source_id", "target_id") if hubs is not None else ():
        out = out.join(hubs.select(F.col("page_id").alias(side)), side, "left_anti")
    return out


def related_neighbours(pages: DataFrame, page: Column | str) -> DataFrame:
    """Resolved related pages of one page, itself left out, by title."""
    own = pages.where(F.col("title") == page)
    linked = own.select(F.explode(F.transform("related", lambda x: F.regexp_replace(x, r"^\[\[|\]\]$", ""))).alias("name"), F.col("page_id").alias("_from"))
    return linked.join(names(pages), "name").where("page_id != _from").select("page_id").distinct().join(pages.select("page_id", "title"), "page_id").orderBy("title")


def hub_members(pages: DataFrame) -> DataFrame:
    """hub, member names: from front matter, table rows and bullets of hub pages."""
    by_field = pages.select(F.explode(F.transform("related", lambda x: F.regexp_replace(x, r"^\[\[|\]\]$", ""))).alias("hub"), F.col("title").alias("member"))
    hubs = pages.where("source_type = 'topic'")
    rows = hubs.select(F.col("title").alias("hub"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^\|\s*\[\[([^\]|]+)"), 1)).alias("member"))
    bullets = hubs.select(F.col("title").alias("hub"), F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^[-*]\s*\[\[([^\]|]+)"), 1)).alias("member"))
    topics = hubs.select(F.col("title").alias("hub"))
    return by_field.join(topics, "hub", "left_semi").unionByName(rows).unionByName(bullets).select("hub", F.trim("member").alias("member")).distinct()


class _Turns:
    """Whose turn it is to move. At most so many rounds: nodes are dealt by a hash into two parts, and a round moves one of them. With None rounds go on
    until no node moves: one moves nodes to communities of smaller names and the next to those of larger ones, so that two never swap. Whenever a
    turn of all moved no fewer nodes than the last, each part is halved by a hash: single nodes only ever move to a better community or an equal
    one of a smaller name, so rest is reached."""

    def __init__(self, rounds: int | None, level: int):
        self.rounds, self.level, self.parts, self.at, self.still, self.moved, self.last = rounds, level, 2 if rounds is not None else 1, 0, 0, 0, None

    def now(self) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(self.level)), F.lit(self.parts)) == self.at % self.parts

    def move(self) -> Column:
        """Where a node goes that is at now and best at best."""
        if self.rounds is not None:
            return F.col("best")
        return F.least("best", "now") if self.at < self.parts else F.greatest("best", "now")

    def ended(self, moved: int) -> bool:
        turns = self.parts * (1 if self.rounds is not None else 2)
        self.still, self.moved, self.at = 0 if moved else self.still + 1, self.moved + moved, (self.at + 1) % turns
        if self.rounds is not None:
            self.rounds -= 1
        if self.still == turns or self.rounds == 0:
            return True
        if self.rounds is None and self.at == 0:
            if self.last is not None and self.moved >= self.last:
                self.parts, self.still = 2 * self.parts, 0
            self.last, self.moved = self.moved, 0
        return False


def communities(graph: DataFrame, rounds: int | None = 6, resolution: float = 1.0, levels: int | None = 3) -> DataFrame:
    """graph: a, b, weight. node, community (its smallest member) and members, of two nodes at least.

    Local moving by modularity gain, then communities become the nodes of a smaller graph (edges inside one weigh on it
    itself) and move again, until a level moves nothing. In a round some nodes move at a time (_Turns),
    so that neighbours don't swap; ties go to the smallest community. Rounds end when all parts rest, or after so many, and levels after so many; None
    is no limit. Reruns agree; this is not the compared library's random order.
    """
    edges = graph.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight")).where("a != b")
    edges = materialise(edges, "louvain-graph")
    total = 2 * (edges.agg(F.sum("weight")).first()[0] or 0.5)
    return _grown(None, edges, total, rounds, resolution, count() if levels is None else range(levels))


def _grown(placed: DataFrame | None, edges: DataFrame, total: float, rounds: int | None, resolution: float, levels: Iterable[int]) -> DataFrame:
    """What communities returns, from where placed (node, community) has got to."""
    for level in levels:
        state = _moved(edges, total, rounds, resolution, level)
        placed = state if placed is None else materialise(placed.select("node", F.col("community").alias("c")).join(state.select(F.col("node").alias("c"), "community"), "c").select("node", "community"), "louvain-placed")
        if state.where("node != community").isEmpty():
            break
        edges = materialise(_between(edges, state), "louvain-graph")
    sized = placed.groupBy("community").agg(F.min("node").alias("label"), F.count(F.lit(1)).alias("members")).where("members >= 2")
    return placed.join(sized, "community").select("node", F.col("label").alias("community"), "members")


def _between(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Edges of the communities; that of a community with itself keeps its weight, so that degrees stay the same."""
    sides = [state.select(F.col("node").alias(k), F.col("community").alias(f"c{k}")) for k in "ab"]
    joined = edges.join(sides[0], "a").join(sides[1], "b")
    return joined.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))


def _sets_of(family: Column | str) -> Column:
    """All sets of two or more of a family's keywords."""
    masks = F.filter(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(family)) - 1), lambda m: F.bit_count(m) > 1)
    return F.transform(masks, lambda m: F.filter(family, lambda _, i: F.getbit(m, i) == 1))


def nearest_by_keywords(keywords: DataFrame, pages: DataFrame, queries: DataFrame, k: int, hot: int | None = None) -> DataFrame:
    """page_id, other_id, shared: of each query page (queries: page_id) others that share two keywords or more, the k among them that
    share most, ties by title and id (pages: page_id, title), and some more.

    Pages that meet at a pair of keywords which at most hot pages (HOT_PAIR_PAGES if None) hold are listed. Others share what their
    families share, so of all that hold a set of frequent keywords the first k + 1 by title and id are enough, and of those of all sets of a
    family the best k + 1: whoever comes behind them is behind k others. So what is made for a query does not grow with the frequent pairs' pages.
    """
    lists, asked = _numbered(keywords, queries)
    met, many = _met_at_pairs(lists, asked, HOT_PAIR_PAGES if hot is None else hot)
    found = _pairs_of(asked).withColumnRenamed("node", "page_id").join(_rare(met, many), ["x", "y"]).select("page_id", F.col("node").alias("other_id"))
    if not many.isEmpty():
        nodes = _families(met, many)
        first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:], "title", "other_id"))).where(F.col("place") <= k + 1).drop("place")
        titled = nodes.select("family", F.col("node").alias("other_id")).join(pages.select(F.col("page_id").alias("other_id"), "title"), "other_id")
        titled = materialise(first(titled, "family"), "keyword-family-first")
        own = materialise(nodes.join(asked.select("node"), "node", "left_semi"), "keyword-families-asked")
        sets = materialise(own.select("family").distinct().select("family", F.explode(_sets_of("family")).alias("set")), "keyword-sets-asked")
        of_set = titled.select("other_id", "title", F.explode(_sets_of("family")).alias("set")).join(sets.select("set").distinct(), "set", "left_semi")
        best = sets.join(first(of_set, "set"), "set").groupBy("family", "other_id", "title").agg(F.max(F.size("set")).alias("common"))
        best = first(best, "family", F.desc("common")).select("family", "other_id")
        found = found.unionByName(own.select(F.col("node").alias("page_id"), "family").join(best, "family").select("page_id", "other_id"))
    found = found.where("page_id != other_id").distinct()
    for side, df in (("other_id", lists), ("page_id", asked)):
        found = found.join(df.select(F.col("node").alias(side), F.col("held").alias(f"held_{side}")), side)
    return found.select("page_id", "other_id", F.size(F.array_intersect("held_other_id", "held_page_id")).cast("long").alias("shared"))


def _numbered(keywords: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and held, of each page its keywords that asked pages (page_id) and two pages or more have, as numbers, if it has two or more; and those of the asked pages."""
    own, wanted = keywords.select("page_id", "keyword").distinct(), asked.select(F.col("page_id").alias("node")).distinct()
    theirs = own.withColumnRenamed("page_id", "node").join(wanted, "node", "left_semi").select("keyword").distinct()
    ids = own.join(theirs, "keyword", "left_semi").groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("keyword", F.monotonically_increasing_id().alias("k"))
    lists = own.join(materialise(ids, "keyword-ids"), "keyword").groupBy(F.col("page_id").alias("node")).agg(F.array_sort(F.collect_list("k")).alias("held"))
    lists = materialise(lists.where(F.size("held") > 1), "keyword-lists")
    return lists, materialise(lists.join(wanted, "node", "left_semi"), "keyword-asked")


def _pairs_of(lists: DataFrame) -> DataFrame:
    """node, x, y: the pairs of a page's keywords."""
    two = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return lists.select("node", F.explode(two).alias("z")).select("node", "z.x", "z.y")


def _met_at_pairs(lists: DataFrame, asked: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """node, x, y: the pairs of keywords of all pages that asked pages hold; and those pairs (x, y) that more than hot pages hold."""
    met = materialise(_pairs_of(lists).join(_pairs_of(asked).select("x", "y").distinct(), ["x", "y"], "left_semi"), "keyword-pairs-met")
    many = materialise(met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("x", "y"), "keyword-pairs-hot")
    return met, F.broadcast(many) if many.count() <= BROADCAST_KEYS else many


def _rare(met: DataFrame, many: DataFrame) -> DataFrame:
    return met.join(many, ["x", "y"], "left_anti")


def _families(met: DataFrame, many: DataFrame) -> DataFrame:
    """node, family: of pages that hold frequent pairs the keywords in them."""
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("x", "y")))))
    return materialise(met.join(many, ["x", "y"], "left_semi").groupBy("node").agg(both.alias("family")), "keyword-families")


def keyword_walk(keywords: DataFrame, seeds: DataFrame, decay: float = 0.5, hot: int | None = None) -> DataFrame:
    """page_id, score: what retrieval.graph_signal gives for two steps from the seeds (page_id, place) on the edges of cooccurrence, of weight 1.

    The edges of the second step are counted, not listed, but for those of pages that meet at a pair of keywords which at most hot pages
    (HOT_PAIR_PAGES if None) hold. Of the others it is counted how many pages of the first step hold each set of frequent keywords; by inclusion and
    exclusion over its own sets that says how many share two or more with a family. Counts are whole numbers, by the place of the seed that was nearest.
    """
    own, starts = keywords.select("page_id", "keyword").distinct(), materialise(seeds.select("page_id", "place"), "walk-seeds")
    away = lambda df: df.join(F.broadcast(starts.select("page_id")), "page_id", "left_anti")
    one = own.join(F.broadcast(starts.select(F.col("page_id").alias("seed"), "place")), F.col("page_id") == F.col("seed")).select("place", "keyword").join(own, "keyword")
    one = materialise(away(one.groupBy("page_id", "place").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1").select("page_id", "place")), "walk-first")
    firsts = materialise(one.groupBy(F.col("page_id").alias("node")).agg(F.min("place").alias("place")), "walk-nodes")

    lists, asked = _numbered(keywords, firsts.select(F.col("node").alias("page_id")))
    met, many = _met_at_pairs(lists, asked, HOT_PAIR_PAGES if hot is None else hot)
    pair = _pairs_of(asked).withColumnRenamed("node", "first").join(_rare(met, many), ["x", "y"]).where("first != node").select("first", "node").distinct()
    two = None
    if not many.isEmpty():
        nodes = _families(met, many)
        for side in ("first", "node"):
            pair = pair.join(nodes.select(F.col("node").alias(side), F.col("family").alias(f"family_{side}")), side, "left")
        pair = pair.where(F.coalesce(F.size(F.array_intersect("family_first", "family_node")), F.lit(0)) < 2)
        theirs = nodes.join(firsts, "node").groupBy("family", "place").agg(F.count(F.lit(1)).alias("n"))
        sets = theirs.select("place", "n", F.explode(_sets_of("family")).alias("set")).groupBy("set", "place").agg(F.sum("n").alias("n"))
        # what a set of j is worth, so that the sets of s in common come to 1, be s two or more
        worth = F.when(F.size("set") % 2 == 0, 1).otherwise(-1) * (F.size("set") - 1)
        near = nodes.select("family").distinct().select("family", F.explode(_sets_of("family")).alias("set")).join(materialise(sets, "walk-sets"), "set")
        near = materialise(near.groupBy("family", "place").agg(F.sum(F.col("n") * worth).alias("n")), "walk-families")
        itself = nodes.join(firsts, "node").select("node", "place", F.lit(-1).cast("long").alias("n"))
        two = nodes.join(near, "family").select("node", "place", "n").unionByName(itself)
    counted = pair.join(firsts.withColumnRenamed("node", "first"), "first").groupBy("node", "place").agg(F.count(F.lit(1)).alias("n"))
    two = away((counted if two is None else counted.unionByName(two)).withColumnRenamed("node", "page_id")).groupBy("page_id", "place").agg(F.sum("n").alias("n"))
    both = one.select("page_id", (decay / F.col("place")).alias("own")).unionByName(two.where("n > 0").select("page_id", (F.col("n") * decay**2 / F.col("place")).alias("own")))
    return both.groupBy("page_id").agg(F.sum("own").alias("score"))


def keyword_communities(keywords: DataFrame, rounds: int | None = None, resolution: float = 1.0, levels: int | None = None, hot: int | None = None) -> DataFrame:
    """communities of the graph that cooccurrence(keywords) lists, weighed by shared keywords: the same result, and no list of all edges.

    A page's family are its keywords that stand in a pair of keywords which more than hot pages (HOT_PAIR_PAGES if None) hold. Two
    pages share what their families share, but for pages that meet at a rarer pair: those are listed with what they share beyond it,
    at most hot of them a page and pair. Links of a page to a community are then the sum of its family's, counted by families,
    and of its own. Of the communities that only its family links it to, none is better than those that no two others
    surpass in links and in degrees alike; so these, its listed ones and its own are all that a page weighs. The next level
    lists edges between communities, which may be as many as the pairs of those that share a hot pair.
    """
    hot = HOT_PAIR_PAGES if hot is None else hot
    own = keywords.select("page_id", "keyword").distinct()
    ids = materialise(own.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("keyword", F.monotonically_increasing_id().alias("k")), "keyword-ids")
    lists = own.join(ids, "keyword").groupBy(F.col("page_id").alias("node")).agg(F.array_sort(F.collect_list("k")).alias("held"))
    two = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = materialise(lists.select("node", F.explode(two).alias("z")).select("node", "z.x", "z.y"), "keyword-pairs")
    met = pairs.join(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["x", "y"])
    met = materialise(met, "keyword-pairs-met")
    some = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    both = F.array("x", "y")
    nodes = materialise(met.groupBy("node").agg(some(both).alias("held"), some(F.when(F.col("n") > hot, both)).alias("family")), "keyword-nodes")
    families = materialise(nodes.where(F.size("family") > 0).groupBy("family").agg(F.count(F.lit(1)).alias("pages")).withColumn("f", F.monotonically_increasing_id()), "keyword-families")
    held = families.select("f", F.explode("family").alias("k"))
    alike = held.join(held.select(F.col("f").alias("g"), "k"), "k").groupBy("f", "g").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
    alike = materialise(alike, "keyword-families-alike")

    rare = met.where(F.col("n") <= hot).select("node", "x", "y").join(nodes, "node")
    sides = [rare.select("x", "y", F.col("node").alias(c), F.col("held").alias(f"held_{c}"), F.col("family").alias(f"family_{c}")) for c in "ab"]
    common = F.size(F.array_intersect("family_a", "family_b"))
    beyond = F.size(F.array_intersect("held_a", "held_b")) - F.when(common > 1, common).otherwise(0)
    listed = sides[0].join(sides[1], ["x", "y"]).where("a < b").select("a", "b", beyond.cast("double").alias("weight")).where("weight > 0").dropDuplicates(["a", "b"])
    listed = materialise(listed, "keyword-listed")

    ways = materialise(listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).select(F.col("a").alias("node"), F.col("b").alias("other"), "weight"), "keyword-ways")
    # a page's family is alike to itself by all its keywords; the page is no neighbour of itself
    by_family = alike.join(families.select(F.col("f").alias("g"), "pages"), "g").groupBy("f").agg(F.sum(F.col("w") * F.col("pages")).alias("near"))
    by_family = families.join(by_family, "f").select("family", "f", F.size("family").cast("double").alias("self"), (F.col("near") - F.size("family")).cast("double").alias("near"))
    degree = nodes.select("node", "family").join(by_family, "family", "left").join(ways.groupBy("node").agg(F.sum("weight").alias("listed")), "node", "left")
    degree = degree.select("node", F.col("node").alias("community"), (F.coalesce("near", F.lit(0.0)) + F.coalesce("listed", F.lit(0.0))).alias("degree"), "f", F.coalesce("self", F.lit(0.0)).alias("self"))
    state = materialise(degree, "louvain-degrees")
    total = state.agg(F.sum("degree")).first()[0] or 1.0
    state, turns, ended = state.where("degree > 0"), _Turns(rounds, 0), False
    while not ended:
        state = materialise(_moved_by_family(state, ways, alike, total, resolution, turns), "louvain-state")
        ended = turns.ended(state.where("community != now").count())
        state = state.drop("now")
    placed = state.select("node", "community")
    if (levels is not None and levels < 2) or state.where("node != community").isEmpty():
        return _grown(placed, listed, total, rounds, resolution, range(0))
    inside = state.where("f is not null").groupBy("f", "community").agg(F.count(F.lit(1)).alias("n"), F.sum("self").alias("self"))
    inside = materialise(inside, "louvain-families")
    whole = inside.select("f", F.col("community").alias("a"), "n").join(_links_of_families(inside, alike).select("f", F.col("community").alias("b"), "links"), "f").where("a <= b")
    whole = whole.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("links")).alias("weight"))
    own = inside.groupBy(F.col("community").alias("a")).agg(F.sum("self").alias("self"))
    whole = whole.join(own, "a").select("a", "b", F.when(F.col("a") == F.col("b"), (F.col("weight") - F.col("self")) / 2).otherwise(F.col("weight")).cast("double").alias("weight"))
    edges = whole.unionByName(_between(listed, placed)).groupBy("a", "b").agg(F.sum("weight").alias("weight")).where("weight > 0")
    return _grown(placed, materialise(edges, "louvain-graph"), total, rounds, resolution, count(1) if levels is None else range(1, levels))


def _links_of_families(inside: DataFrame, alike: DataFrame) -> DataFrame:
    """f, community, links: what a page of the family shares with all pages of the community, by families alone. inside: f, community, n."""
    return inside.select(F.col("f").alias("g"), "community", "n").join(alike, "g").groupBy("f", "community").agg(F.sum(F.col("n") * F.col("w")).cast("double").alias("links"))


def _moved_by_family(state: DataFrame, ways: DataFrame, alike: DataFrame, total: float, resolution: float, turns: _Turns) -> DataFrame:
    """One round of _moved at level 0: node, community, degree, f, self and now, where the node was."""
    sums = state.groupBy("community").agg(F.sum("degree").alias("held"))
    inside = state.where("f is not null").groupBy("f", "community").agg(F.count(F.lit(1)).alias("n"))
    links = materialise(_links_of_families(inside, alike).join(sums, "community"), "louvain-family-links")
    order = Window.partitionBy("f").orderBy(F.desc("links"), "held", "community").rowsBetween(Window.unboundedPreceding, -1)
    first = links.withColumn("least", F.min("held").over(order)).withColumn("first", F.col("least").isNull() | (F.col("held") < F.col("least")))
    least = first.withColumn("least", F.min(F.when(~F.col("first"), F.col("held"))).over(order))
    # those that none surpasses, and those that none but one of these does: a page may be in one of them itself
    best = materialise(least.where("first or least is null or held < least").select("f", "community"), "louvain-family-best")
    moves = turns.now()
    movers = state.where(moves).select("node", F.col("community").alias("now"), "degree", "f", "self")
    zero = F.lit(0.0).alias("listed")
    by_page = ways.where(moves).join(state.select(F.col("node").alias("other"), "community"), "other").select("node", "community", F.col("weight").alias("listed"))
    options = by_page.unionByName(movers.select("node", F.col("now").alias("community"), zero)).unionByName(movers.join(best, "f").select("node", "community", zero))
    options = options.groupBy("node", "community").agg(F.sum("listed").alias("listed")).join(movers, "node")
    options = options.join(links.select("f", "community", "links"), ["f", "community"], "left").join(sums, "community")
    here = F.col("community") == F.col("now")
    options = options.withColumn("links", F.col("listed") + F.coalesce("links", F.lit(0.0)) - F.when(here, F.col("self")).otherwise(0.0)).where(here | (F.col("links") > 0))
    gain = F.col("links") - resolution * F.col("degree") * (F.col("held") - F.when(here, F.col("degree")).otherwise(0.0)) / total
    found = options.withColumn("gain", F.round(gain, 9)).groupBy("node").agg(F.min_by("community", F.struct(-F.col("gain"), "community")).alias("best"))
    return state.withColumnRenamed("community", "now").join(found, "node", "left").select("node", F.coalesce(turns.move(), "now").alias("community"), "degree", "f", "self", "now")


def _moved(edges: DataFrame, total: float, rounds: int | None, resolution: float, level: int) -> DataFrame:
    """node, community after local moving on edges a <= b (a = b: a node with itself, counted twice in its degree)."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    both = materialise(both, "louvain-edges")
    degree = materialise(both.groupBy("node").agg(F.sum("weight").alias("degree")), "louvain-degrees")
    both, turns, ended = both.where("node != other"), _Turns(rounds, level), False
    state = degree.select("node", F.col("node").alias("community"), "degree")
    while not ended:
        sums = state.groupBy("community").agg(F.sum("degree").alias("held"))
        near = both.join(state.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("links"))
        stay = state.select("node", "community").withColumn("links", F.lit(0.0))
        options = near.unionByName(stay).groupBy("node", "community").agg(F.sum("links").alias("links")).join(sums, "community").join(state.select("node", F.col("community").alias("now"), "degree"), "node")
        gain = F.col("links") - resolution * F.col("degree") * (F.col("held") - F.when(F.col("community") == F.col("now"), F.col("degree")).otherwise(0.0)) / total
        best = options.withColumn("gain", F.round(gain, 9)).groupBy("node", "now", "degree").agg(F.min_by("community", F.struct(-F.col("gain"), "community")).alias("best"))
        state = materialise(best.select("node", F.when(turns.now(), turns.move()).otherwise(F.col("now")).alias("community"), "degree", F.col("now")), "louvain-state")
        ended = turns.ended(state.where("community != now").count())
        state = state.drop("now")
    return state.select("node", "community")


def modularity(graph: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))
    m = membership.select("node", "community")
    inner = both.join(m, "node").join(m.select(F.col("node").alias("other"), F.col("community").alias("c2")), "other")
    total = both.agg(F.sum("weight")).first()[0] or 1.0
    inside = inner.where("community = c2").agg(F.sum("weight")).first()[0] or 0.0
    spread = both.join(m, "node").groupBy("community").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0] or 0.0
    return inside / total - resolution * spread / total**2


def community_labels(membership: DataFrame, keywords: DataFrame) -> DataFrame:
    """community, page_count, top_keywords (five by count, then name) and label (the first three)."""
    counts = membership.join(keywords.where("rank <= 10").select(F.col("page_id").alias("node"), "keyword"), "node").groupBy("community", "keyword").count()
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("count"), "keyword"))
    tops = counts.withColumn("p", place).where("p <= 5").groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "keyword"))), lambda x: x["keyword"]).alias("top_keywords"))
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("page_count"))
    return sizes.join(tops, "community", "left").withColumn("label", F.array_join(F.slice("top_keywords", 1, 3), ", ")).orderBy(F.desc("page_count"), "community")


def community_suggestions(labels: DataFrame, topics: DataFrame, least: int = 3) -> DataFrame:
    """Communities of three pages or more whose label no topic title holds or is held by."""
    wide = labels.where(F.col("page_count") >= least)
    low = topics.select(F.lower("title").alias("t"))
    covered = wide.join(low, F.contains(F.lower("label"), F.col("t")) | F.contains(F.col("t"), F.lower("label")), "left_semi").select("community")
    return wide.join(covered, "community", "left_anti")
