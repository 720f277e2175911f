"""Ranked retrieval: BM25 over weighted fields, title, vector, graph and keyword signals, and their fusion.

Query terms are few and known when the plan is built, so term counts are columns made in the scan; no postings table is
shuffled for a query. Statistics are one aggregated row. All rankings end their sort keys with the page id.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ship, stemming, text as T
from ..sources.scratch import materialise

#: Fields and weights: title, summary, tags, body. The second set is what the weights are declared to be elsewhere.
WEIGHTS = {"title": 5.0, "summary": 3.0, "tags": 1.0, "body": 1.0}
DECLARED_WEIGHTS = {"title": 10.0, "summary": 5.0, "tags": 3.0, "body": 1.0}
K1, B, RRF_K, SIGNAL_ROWS, AND_BOOST, TITLE_BOOST, SPECIFIC_IDF, SEEDS = 1.2, 0.75, 60, 20, 5.0, 3.0, 4.0, 5


def single_row(df: DataFrame) -> DataFrame:
    """An aggregate without keys has one row, which is what makes its broadcast bounded."""
    return F.broadcast(df)


def top(df: DataFrame, k: int, by: str = "score", key: str = "page_id") -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(k)


def bm25(pages: DataFrame, terms: list[str], fields: dict[str, float] = WEIGHTS, letters: str = T.ASCII, k1: float = K1, b: float = B, stem: bool = False) -> DataFrame:
    """page_id, matched (number of terms found) and score of pages with at least one term.

    stem: compare Porter stems. idf is floored at 1e-6; term frequencies are summed over fields by weight; lengths are of all fields together.
    """
    terms = list(dict.fromkeys(stemming.stem(t.lower()) if stem else t.lower() for t in terms))
    kinds = dict(pages.dtypes)
    text = {f: F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f) for f in fields}
    if stem:
        text = {f: stemming.stemmed(c) for f, c in text.items()}
    own = pages.select("page_id", *(F.lower(F.coalesce(c, F.lit(""))).alias(f"_{f}") for f, c in text.items()))
    length = sum((T.token_number(F.col(f"_{f}"), letters) for f in fields), F.lit(0))
    counts = {f"tf{i}": sum((T.token_hits(F.col(f"_{f}"), t, letters) * F.lit(w) for f, w in fields.items()), F.lit(0.0)) for i, t in enumerate(terms)}
    counted = own.select("page_id", length.cast("long").alias("len"), *(c.alias(n) for n, c in counts.items()))
    counted = materialise(counted, "bm25-counts")  # texts are read once for statistics and scores
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.sum((F.col(c) > 0).cast("long")).alias(f"d_{c}") for c in counts))
    joined = counted.crossJoin(single_row(stats))
    score, matched = F.lit(0.0), F.lit(0)
    for c in counts:
        idf = F.greatest(F.log((F.col("n") - F.col(f"d_{c}") + 0.5) / (F.col(f"d_{c}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("len") / F.col("avg")))
        matched = matched + (F.col(c) > 0).cast("int")
    return joined.select("page_id", matched.alias("matched"), score.alias("score")).where("matched > 0")


def title_idf(pages: DataFrame, terms: list[str], missing: str = "floor") -> tuple[DataFrame, list[Column], Column]:
    """One row with the idf of each term over titles (as substrings), at most 5.

    missing: 'floor' counts a term in no title as in one; 'one' gives it the idf 1.
    """
    low = F.lower(F.coalesce("title", F.lit("")))
    stats = pages.agg(F.count(F.lit(1)).alias("tn"), *(F.sum(F.contains(low, F.lit(t)).cast("long")).alias(f"td{i}") for i, t in enumerate(terms)))
    idf = []
    for i in range(len(terms)):
        own = F.least(F.lit(5.0), F.log(F.greatest("tn", F.lit(1)) / F.greatest(f"td{i}", F.lit(1))) + 1)
        idf.append(F.when(F.col(f"td{i}") == 0, 1.0).otherwise(own) if missing == "one" else own)
    return stats, idf, sum(idf, F.lit(0.0))


def _title_share(idf: list[Column], whole: Column, terms: list[str]) -> Column:
    low = F.lower(F.coalesce("title", F.lit("")))
    return sum((F.when(F.contains(low, F.lit(t)), i).otherwise(0.0) for t, i in zip(terms, idf)), F.lit(0.0)) / whole


def lexical(pages: DataFrame, query: str, k: int = SIGNAL_ROWS, fields: dict[str, float] = WEIGHTS, letters: str = T.ASCII, titles: DataFrame | None = None) -> DataFrame:
    """page_id and score: pages with all terms count five times and once more among those with any; titles add up to three times.

    titles: page_id and title of the same pages, if they lie apart from the texts.
    """
    terms = [t.lower() for t in T.query_terms(query)]
    scored = bm25(pages, terms, fields, letters)
    parts = top(scored, 2 * k).select("page_id", "score")
    if len(terms) > 1:
        every = top(scored.where(F.col("matched") == len(set(terms))), k)
        parts = parts.unionByName(every.select("page_id", (F.col("score") * AND_BOOST).alias("score")))
    summed = parts.groupBy("page_id").agg(F.sum("score").alias("score"))  # 3 k rows at most
    titles = pages.select("page_id", "title") if titles is None else titles
    stats, idf, whole = title_idf(titles, terms)
    titled = titles.join(F.broadcast(summed), "page_id").crossJoin(single_row(stats))
    bonus = 1 + _title_share(idf, whole, terms) * TITLE_BOOST
    return top(titled.select("page_id", (F.col("score") * bonus).alias("score")), k)


def title_signal(pages: DataFrame, query: str, k: int = SIGNAL_ROWS) -> DataFrame:
    """page_id and score: the share of the terms' idf that is found in the title."""
    terms = [t.lower() for t in T.query_terms(query)]
    stats, idf, whole = title_idf(pages, terms, missing="one")
    scored = pages.select("page_id", "title").crossJoin(single_row(stats)).select("page_id", _title_share(idf, whole, terms).alias("score"))
    return top(scored.where("score > 0"), k)


def vector_signal(chunks: DataFrame, query: list[float], k: int = SIGNAL_ROWS) -> DataFrame:
    """chunks: page_id, embedding. The best of the 3 k nearest chunks (Euclidean) of each page, as 1 / (1 + distance)."""
    far = T.l2_distance(F.col("embedding"), T.literals([float(x) for x in query]))
    nearest = chunks.where("embedding is not null").select("page_id", far.alias("distance")).orderBy("distance", "page_id").limit(3 * k)
    return top(nearest.groupBy("page_id").agg(F.max(1 / (1 + F.col("distance"))).alias("score")), k)


def keyword_signal(keywords: DataFrame, query: str, k: int = SIGNAL_ROWS) -> DataFrame:
    """keywords: page_id, keyword, score. Whole keywords equal to a term: their number times their total score."""
    terms = [t.lower() for t in T.query_terms(query)]
    hit = keywords.where(F.lower("keyword").isin(*terms)).groupBy("page_id").agg((F.count(F.lit(1)) * F.sum("score")).alias("score"))
    return top(hit, k)


def graph_signal(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.5) -> DataFrame:
    """Breadth-first scores around ranked seeds (page_id, place from 1).

    A neighbour gets the node's score * decay * weight from every arrival; only the first arrival (by place of the node
    in its level, neighbour, weight) goes on. Both directions count; equal neighbour and weight count once.
    """
    both = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"), "weight").unionByName(edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("next"), "weight")).distinct()
    start = seeds.select(F.col("page_id").alias("node"), "place", (1.0 / F.col("place")).alias("own"))
    level, visited, arrivals = start, start.select(F.col("node").alias("next")), None
    for step in range(depth):
        arrived = both.join(level, "node").join(start.select(F.col("node").alias("next")), "next", "left_anti")
        arrived = arrived.select("next", "place", "weight", (F.col("own") * decay * F.col("weight")).alias("own"))
        sums = arrived.select("next", "own")
        arrivals = sums if arrivals is None else arrivals.unionByName(sums)
        if step + 1 < depth:
            # the smallest (place, weight) of each new neighbour; places of the next level are in the order of first arrival,
            # and being compared only they needn't be counted: where its first node stood, then the page itself
            first = arrived.join(visited, "next", "left_anti").groupBy("next").agg(F.min(F.struct("place", "weight", "own")).alias("f"))
            level = first.select(F.col("next").alias("node"), F.struct(F.col("f.place").alias("of"), F.col("next").alias("page")).alias("place"), F.col("f.own").alias("own"))
            visited = visited.unionByName(first.select("next"))
    return arrivals.groupBy(F.col("next").alias("page_id")).agg(F.sum("own").alias("score"))


def fuse(signals: list[tuple[str, DataFrame, int]], k: int = RRF_K) -> DataFrame:
    """page_id, score and signals: 1 / (k + rank) plus the share of the list's best score / (k + 1), summed over lists.

    signals: name, list, and how many times it counts. A list that is cut has a column rank of its own.
    """
    parts = None
    for name, frame, times in signals:
        whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        best = F.max("score").over(whole)
        rank = F.col("rank") if "rank" in frame.columns else F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "page_id"))
        own = frame.select("page_id", F.lit(name).alias("signal"), (times * (1.0 / (k + rank) + F.col("score") / F.when(best == 0, 1.0).otherwise(best) / (k + 1))).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("page_id").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


def hybrid(pages: DataFrame, query: str, chunks: DataFrame | None = None, query_vector: list[float] | None = None, edges: DataFrame | Callable[[DataFrame], DataFrame] | None = None, keywords: DataFrame | None = None, k: int = 10, specific: bool | None = None, fields: dict[str, float] = WEIGHTS) -> DataFrame:
    """page_id, title, score, signals of the best k pages over all signals that there is input for.

    specific: whether a term is rare enough in titles (idf of 4 or more) for lexical hits to count twice and titles three
    times; None reads it from the titles (one small row). edges: all of them, or a function of the seeds that gives what graph_signal would.
    """
    terms = [t.lower() for t in T.query_terms(query)]
    heads = materialise(pages.select("page_id", "title"), "titles")  # texts are read once more, by the lexical signal
    words = lexical(pages, query, fields=fields, titles=heads)
    titles = title_signal(heads, query)
    if specific is None:
        stats, idf, _ = title_idf(heads, terms, missing="one")
        specific = bool(stats.select(F.greatest(*idf, F.lit(0.0)).alias("m")).first()["m"] >= SPECIFIC_IDF)
    lists = [("lexical", words, 2 if specific else 1), ("title", titles, 3 if specific else 1)]
    if chunks is not None and query_vector is not None:
        lists.append(("vector", vector_signal(chunks, query_vector), 1))
    if keywords is not None:
        lists.append(("keyword", keyword_signal(keywords, query), 1))
    if edges is not None:
        lists = [(name, materialise(frame, f"{name}-signal"), times) for name, frame, times in lists]
        seeds = top(lists[0][1], SEEDS).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "page_id")))
        walked = materialise((edges(seeds) if callable(edges) else graph_signal(edges, seeds)).withColumn("score", F.round("score", 12)), "graph-signal")
        lists.append(("graph", _ranked(walked, [frame for _, frame, _ in lists], k), 1))
    best = fuse(lists).withColumn("_key", F.round("score", 9)).orderBy(F.desc("_key"), "page_id").limit(k).drop("_key")
    return top(heads.join(F.broadcast(best), "page_id"), k)


def _ranked(walked: DataFrame, others: list[DataFrame], k: int) -> DataFrame:
    """Of a long list those rows that can be among the best k of a fusion with short lists, each with its rank in the whole list.

    A page that is in no other list can only be there if it is one of the first k here.
    """
    known = others[0].select("page_id")
    for frame in others[1:]:
        known = known.unionByName(frame.select("page_id"))
    kept = top(walked, k).unionByName(walked.join(F.broadcast(known.distinct()), "page_id", "left_semi")).distinct()
    kept = materialise(kept, "graph-best")
    own = kept.select(F.col("page_id").alias("own_id"), F.col("score").alias("own_score"))
    ahead = walked.join(F.broadcast(own), (F.col("score") > F.col("own_score")) | ((F.col("score") == F.col("own_score")) & (F.col("page_id") < F.col("own_id"))))
    return kept.join(ahead.groupBy(F.col("own_id").alias("page_id")).agg(F.count(F.lit(1)).alias("n")), "page_id", "left").select("page_id", "score", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def fallback_scan(files: DataFrame, query: str) -> DataFrame:
    """Where there is no index: files whose content holds the query, all with score 0."""
    return files.where(F.contains(F.lower("content"), F.lower(F.lit(query)))).select("path", F.lit(0.0).alias("score"))


def search_or_scan(index: DataFrame | None, files: DataFrame, query: str, **options) -> DataFrame:
    return fallback_scan(files, query) if index is None else hybrid(index, query, **options)


def phrase_counts(text: str | None, phrases: list[str]) -> list[int]:
    """How often each phrase stands in a text, without overlaps, in one pass over the text however many phrases there are."""
    import ahocorasick

    found, free = [0] * len(phrases), [0] * len(phrases)
    machine = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        machine.add_word(phrase, k)
    if text and len(machine):
        machine.make_automaton()
        for end, k in machine.iter(text):
            start = end - len(phrases[k]) + 1
            if start >= free[k]:
                found[k], free[k] = found[k] + 1, end + 1
    return found


def promising(pages: DataFrame, candidates: int = 200) -> DataFrame:
    """page_id and _p: the candidate phrases of a page with the highest frequency * (1 + words / 2), as (s, p), s being negative."""
    ship.send(pages.sparkSession.sparkContext)

    def best(text: str | None, phrases: list[str] | None) -> list[dict] | None:
        if phrases is None:
            return None
        scored = sorted((-(n * (1 + len(p.split(" ")) * 0.5)), p) for n, p in zip(phrase_counts(text, phrases), phrases, strict=True))
        return [{"s": s, "p": p} for s, p in scored[:candidates]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.float64()), ("p", pa.string())]))
        for batch in batches:
            rows = [best(t.as_py(), p.as_py()) for t, p in zip(batch.column("low"), batch.column("p"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(rows, kind)], ["page_id", "_p"])

    own = pages.select("page_id", F.lower("body").alias("low"), T.candidate_phrases(F.col("body")).alias("p"))
    return own.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, _p array<struct<s:double,p:string>>")


def _uncovered(ordered: Column, most: int) -> Column:
    """Of phrases (s, p) in order those that stay: a phrase more than 70 % of whose words are in phrases before it goes. A fold inside one row."""

    def step(acc: Column, x: Column) -> Column:
        words = F.split(x["p"], " ")
        seen = F.size(F.array_intersect(F.array_distinct(words), acc["words"])) / F.size(F.array_distinct(words))
        full = (F.size(acc["kept"]) >= most) | ((F.size(acc["words"]) > 0) & (seen > 0.7))
        return F.when(full, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), F.array_union(acc["words"], words).alias("words")))

    zero = F.struct(F.array().cast("array<struct<s:double,p:string>>").alias("kept"), F.array().cast("array<string>").alias("words"))
    return F.aggregate(ordered, zero, step, lambda a: a["kept"])


def _ranked_phrases(own: DataFrame, most: int) -> DataFrame:
    kept = own.select("page_id", F.posexplode(_uncovered(F.col("_p"), most)).alias("i", "x"))
    return kept.select("page_id", F.col("x.p").alias("keyword"), (-F.col("x.s")).alias("score"), (F.col("i") + 1).alias("rank"), (F.col("i") < 10).alias("is_top"))


def keywords_by_frequency(pages: DataFrame, most: int = 50, candidates: int = 200) -> DataFrame:
    """page_id, keyword, score, rank, is_top: phrases by frequency * (1 + words / 2), without a model."""
    return _ranked_phrases(promising(pages, candidates), most)


def keywords_by_similarity(pages: DataFrame, embed: Callable[[Column], Column], most: int = 50, candidates: int = 200, head: int = 2000) -> DataFrame:
    """page_id, keyword, score, rank, is_top: a page's promising phrases by the cosine of their vectors with the page's.

    embed makes a vector column of a text column. Each phrase is embedded once, whatever number of pages has it; a page is
    embedded by its title and the first head characters of its body. Scores are compared to 9 places, equal ones by phrase.
    """
    found = materialise(promising(pages, candidates), "promising-phrases").select("page_id", F.explode("_p.p").alias("p"))
    known = materialise(found.select("p").distinct().withColumn("v", embed(F.col("p"))), "phrase-vectors")
    whole = pages.select("page_id", embed(F.concat("title", F.lit("\n\n"), F.substring("body", 1, head))).alias("w"))
    near = found.join(known, "p").join(whole, "page_id").select("page_id", F.struct((-F.round(T.cosine(F.col("v"), F.col("w")), 9)).alias("s"), "p").alias("x"))
    return _ranked_phrases(near.groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("_p")), most)  # candidates rows a page at most


def snippets(sections: DataFrame, ranked: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Sections of ranked pages that answer a query: term hits, two more for a table; sections under 30 characters don't count."""
    terms = [t.lower() for t in T.query_terms(query)]
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    scored = sections.join(F.broadcast(ranked.select("page_id", "title")), "page_id").where(F.length("text") >= 30)
    scored = scored.withColumn("score", hits + F.when(F.col("text").rlike(r"(?m)^\s*\|.*\|\s*$"), 2).otherwise(0)).where(hits > 0)
    one = Window.partitionBy("title", "heading").orderBy(F.desc("score"), "page_id", "position")
    return scored.withColumn("_r", F.row_number().over(one)).where("_r = 1").orderBy(F.desc("score"), "title", "heading").limit(k).drop("_r")


def index_status(pages: DataFrame, chunks: DataFrame, edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """Counts of each index table in one row."""
    parts = [pages.agg(F.count(F.lit(1)).alias("pages")), chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("page_id").alias("chunked_pages")), edges.agg(F.count(F.lit(1)).alias("edges")), keywords.agg(F.countDistinct("page_id").alias("keyword_pages"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(single_row(p))
    return out
