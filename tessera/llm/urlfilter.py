"""URL filters: rules, and a character language-model ratio for the URLs that no rule fits; built-in functions only.

Two smoothed variable-order Markov models over the bytes of a URL, one of accepted URLs (those a rule allows) and one of
rejected URLs (those a rule blocks), are counted over all pages. A model predicts a character from up to ORDER
characters before it: the estimate of each order is blended with the next lower one by Witten-Bell weights, down to a
uniform distribution. A URL's score is the difference of its log likelihoods under the two models, divided by its
length. The cut is calibrated on rule-judged URLs that the models did not see (one in HELD by a hash): it maximises the
sum of the two classes' hit rates over a histogram of scores.

Characters are folded to 40 symbols (letters lower-cased, digits to 0, the usual punctuation, all else to one), so a
model has 40**(ORDER + 1) rows at most and may be broadcast; the bound is proven by the alphabet, not by the data.

Rules: a rule fits its host and all subdomains if the URL's path starts with the rule's; the longest rule wins.

Defined cases: a null URL, or one without '://', has empty host and path, fits no rule and is blocked if null or empty,
else judged by its characters; equal URLs get equal verdicts, and rows that repeat are each judged; a URL of any length is
scored by all of its characters, in rows that grow with its length; equal scores at the cut are allowed; if there are no accepted or no
rejected URLs to learn from the cut is 0; an empty table gives an empty result; no column but page_id and url is read,
whatever its name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

ORDER, HELD, BINS = 2, 5, 200
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEPT = "/:.?&=#-_%+~"
#: Letters, one digit, punctuation and one symbol for all else; the mark before the first character is not predicted.
SYMBOLS = len(_LOWER) + 1 + len(_KEPT) + 1
_START = "^"


def host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def folded(url: Column) -> Column:
    """The URL in the models' alphabet."""
    lower = F.translate(url, _UPPER + "123456789", _LOWER + "000000000")
    return F.regexp_replace(lower, r"[^a-z0/:.?&=#\-_%+~]", "*")


def _grams(urls: DataFrame, text: str, order: int) -> DataFrame:
    """A row for each character of each folded text: gram, the character with the order characters before it."""
    padded = F.concat(F.lit(_START * order), F.col(text))
    return urls.withColumn("_p", padded).withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr("_p", i, F.lit(order + 1))))).drop("_p")


def fit_models(judged: DataFrame, order: int = ORDER) -> DataFrame:
    """judged: text (folded, not empty), verdict. Returns gram, ratio: ln P(allow) - ln P(block) of its last character.

    All grams over the alphabet that occur in either class have a row; see backoff() for the others.
    """
    counts = _grams(judged, "text", order).groupBy("gram").agg(*(F.sum((F.col("verdict") == k).cast("long")).alias(k) for k in ("allow", "block")))
    counts = materialise(counts, "url-counts")
    levels = counts
    tables = []
    for n in range(order, -1, -1):  # from the longest context to none
        tables.append(levels)
        levels = levels.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    tables.reverse()
    below = None
    for n, level in enumerate(tables):
        context = F.substring("gram", 1, n)
        whole = level.groupBy(context.alias("context")).agg(*(F.sum(k).alias(f"{k}_all") for k in ("allow", "block")), *(F.sum((F.col(k) > 0).cast("long")).alias(f"{k}_kinds") for k in ("allow", "block")))
        own = level.withColumn("context", context).join(whole, "context")
        if below is None:
            own = own.withColumns({f"p_{k}_low": F.lit(1.0 / SYMBOLS) for k in ("allow", "block")})
        else:
            own = own.withColumn("low", F.substring("gram", 2, n)).join(below.select(F.col("gram").alias("low"), *(F.col(f"p_{k}").alias(f"p_{k}_low") for k in ("allow", "block"))), "low")
        blended = {}
        for k in ("allow", "block"):
            seen = F.col(f"{k}_all") + F.col(f"{k}_kinds")
            blended[f"p_{k}"] = F.when(seen > 0, (F.col(k) + F.col(f"{k}_kinds") * F.col(f"p_{k}_low")) / seen).otherwise(F.col(f"p_{k}_low"))
            blended[f"w_{k}"] = F.when(seen > 0, F.col(f"{k}_kinds") / seen).otherwise(F.lit(1.0))
        below = own.select("gram", *(c.alias(name) for name, c in blended.items()))
        tables[n] = below
    return materialise(_all_levels(tables), "url-model")


def _all_levels(tables: list[DataFrame]) -> DataFrame:
    """Grams of every order in one table: gram, p_allow, p_block, and the weights that its context leaves to lower orders."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def score(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """urls: text (folded, distinct). Returns text and score, the mean log ratio of its characters.

    A character whose longest gram was never seen takes the estimate of the next shorter one, weighed by what its context
    leaves to lower orders.
    """
    # characters are counted under a number, so that a text's length goes into the rows made, not into each of them
    texts = materialise(urls.select("text").withColumn("row", F.monotonically_increasing_id()), "url-texts")
    chars = _grams(texts, "text", order).select("row", "gram").groupBy("row", "gram").count()
    estimates = {k: F.lit(1.0 / SYMBOLS) for k in ("allow", "block")}
    for n in range(order + 1):
        gram = F.substring("gram", order + 1 - n, n + 1)
        # by gram, if it was seen; by its context, for the weight that is left to lower orders
        seen = F.broadcast(model.where(F.length("gram") == n + 1).select(F.col("gram").alias(f"g{n}"), *(F.col(f"p_{k}").alias(f"p{n}_{k}") for k in estimates)))
        context = F.broadcast(model.where(F.length("gram") == n + 1).groupBy(F.substring("gram", 1, n).alias(f"c{n}")).agg(*(F.first(f"w_{k}").alias(f"w{n}_{k}") for k in estimates)))
        chars = chars.join(seen, gram == F.col(f"g{n}"), "left").join(context, F.substring("gram", order + 1 - n, n) == F.col(f"c{n}"), "left")
        estimates = {k: F.coalesce(F.col(f"p{n}_{k}"), F.coalesce(F.col(f"w{n}_{k}"), F.lit(1.0)) * e) for k, e in estimates.items()}
    ratio = F.log(estimates["allow"]) - F.log(estimates["block"])
    # sums of rounded terms do not depend on the order of rows
    scored = chars.groupBy("row").agg((F.sum(F.round(ratio * 1e6).cast("long") * F.col("count")) / F.sum("count") / 1e6).alias("score"))
    return texts.join(scored, "row").select("text", "score")


def calibrated_cut(scored: DataFrame, bins: int = BINS) -> float:
    """scored: score, verdict. The cut with the best sum of hit rates; the driver reads one number."""
    binned = scored.groupBy(F.greatest(F.lit(-bins // 2), F.least(F.lit(bins // 2), F.floor(F.col("score") * 20))).alias("bin")).agg(
        *(F.sum((F.col("verdict") == k).cast("long")).alias(k) for k in ("allow", "block")))
    upto, everything = Window.orderBy("bin"), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gain = F.sum("block").over(upto) / F.sum("block").over(everything) - F.sum("allow").over(upto) / F.sum("allow").over(everything)
    # the cut stands midway between a bin and the next one that holds scores
    after = F.lead("bin").over(Window.orderBy("bin"))
    cut = (F.col("bin") + 1 + F.coalesce("after", F.col("bin") + 1)) / 40
    best = binned.withColumns({"gain": gain, "after": after}).where("gain is not null").orderBy(F.desc("gain"), F.abs(cut), "bin").select(cut.alias("cut")).limit(1).collect()
    return best[0]["cut"] if best else 0.0


def judge_urls(pages: DataFrame, rules: tuple = RULES, order: int = ORDER) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of each page."""
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = own.withColumns({"rule": name, "by_rule": verdict, "text": folded(F.coalesce("url", F.lit("")))})
    own = materialise(own, "url-rows")
    judged = own.where("by_rule is not null").select("text", "by_rule", F.pmod(F.xxhash64("url"), F.lit(HELD)).alias("part"))
    model = fit_models(judged.where("part != 0").select("text", F.col("by_rule").alias("verdict")), order)
    # equal folded texts have equal scores: each is scored once
    scores = materialise(score(own.where("text != ''").select("text").distinct(), model, order), "url-scores")
    cut = calibrated_cut(judged.where("part = 0").join(scores, "text").select("score", F.col("by_rule").alias("verdict")))
    by_model = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    # empty texts have no score, and don't meet at one
    known, empty = own.where("text != ''").join(scores, "text", "left"), own.where("text = ''").withColumn("score", F.lit(None).cast("double"))
    out = known.unionByName(empty)
    return out.select("page_id", "url", "host", "path", "rule", "score", F.coalesce("by_rule", by_model).alias("verdict"))
