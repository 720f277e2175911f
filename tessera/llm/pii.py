"""Personal data: fixed formats, and bootstrapped contextual extraction around them; built-in functions only.

Base spans are leftmost non-overlapping matches of four formats, each checked after matching. They seed the method:

1. Instances are base spans, and candidates that no base span overlaps. Candidates are of a form: numbers (7 to 19 digits,
   in groups that up to two separators join), names (a token with an at sign, "user at host dot com" or "user (at) host") and values
   (letters and digits after an equals sign or a colon, 6 characters at least). Values of SEED_VALUE characters or more that
   are not labelled as a digest are the seeds of a fifth kind, secret.
2. The lexical patterns of an instance are the last word before it and the last two words before it. Signs that end a
   label belong to its word.
3. Distinct patterns and instances form a graph over all documents. ROUNDS times, a pattern's confidence in a kind is the
   sum of its instances' scores over their number plus one, and an instance's score is 1 - product(1 - confidence) over
   its patterns of at least PATTERN_CONFIDENCE with MIN_SEEDS different seeds. Seeds keep the score 1 in the rounds.
4. Candidates whose score reaches INSTANCE_SCORE become spans of their likeliest kind, if that kind goes with their form:
   email with names, secret with values, the others with numbers. Values that seed secrets need that score, too: a
   format alone does not make a secret. Base spans stay.

The regular expressions hold possessive quantifiers and anchors to the start of a run, and offsets are sums over blocks
of blocks of matches, so the time for a text grows with its length; none of this changes what leftmost greedy matching
finds. Offsets are code points, ends exclusive.

Defined cases: null counts as the empty text; equal texts get equal spans; rows that repeat are judged each; a value of
several kinds gets the one of the highest score, then the first in the order of KINDS; texts of any length are read
whole; an empty table gives an empty result; no column but doc_id and text is read, whatever its name.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, small

ROUNDS, MIN_SEEDS, PATTERN_CONFIDENCE, INSTANCE_SCORE, SEED_VALUE = 3, 3, 0.8, 0.9, 20
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Of the formats [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ;
#: [0-9]([\x20-]?[0-9])+ ; \+[0-9][\x20().0-9-]+[0-9]. Runs with too few digits for a card or a phone are not matched at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+(?=[0-9](?:[\x20().-]*+[0-9]){8,}+)[0-9][\x20().0-9-]+[0-9]",
}
#: Forms of candidates, in the order in which they are tried at a place.
FORMS = {
    "name": r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D]*+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: at [A-Za-z0-9-]++(?= dot )| ?[(\[]at[)\]] ?[A-Za-z0-9-]++)(?:(?: dot | ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)*+",
    "value": r"(?:(?<=[=:])|(?<=[=:][\x20\x22\x27])|(?<=[=:]\x20[\x22\x27]))(?=[0-9_+/.-]*+[A-Za-z])(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_+/.-]{5,}+",
    "number": r"(?<![A-Za-z0-9])[+(]?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
}
_FORM_KINDS = {"name": ("email",), "value": ("secret",), "number": ("ip", "card", "phone")}
# Labels of digests, which are no secrets.
_DIGEST = r"(?i)(?:sha-?[0-9]*|md[0-9]|crc[0-9]*|commit|digest|checksum|etag|rev|revision|hash|uuid|guid|version)[^A-Za-z0-9]*$"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CONTEXT, _BLOCK = 64, 64
_SPAN = "struct<s:int,e:int,v:string,before:string>"


# Expressions over arrays are written as SQL text: one call each, where column functions would be hundreds.

def _let(value: str, name: str, then: str) -> str:
    """then, in which name stands for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _sums(lengths: str, start: str) -> str:
    """start plus the sum of all lengths up to each, by an accumulator that grows: for few lengths."""
    step = "(acc, n) -> named_struct('at', acc.at + n, 'out', concat(acc.out, array(acc.at + n)))"
    return f"aggregate({lengths}, named_struct('at', {start}, 'out', cast(array() AS array<int>)), {step}, acc -> acc.out)"


def _in_blocks(x: str, name: str) -> str:
    return f"transform(sequence(0, cast(floor((size({x}) - 1) / {_BLOCK}) AS int)), {name} -> slice({x}, {name} * {_BLOCK} + 1, {_BLOCK}))"


def _ends(lengths: str, levels: int = 2) -> str:
    """The sum of lengths up to each: by blocks of _BLOCK, whose own sums are taken by blocks again."""
    if not levels:
        return _sums(lengths, "0")
    x, b, e = f"x{levels}", f"b{levels}", f"e{levels}"
    before = _ends(f"transform({b}, q -> aggregate(q, 0, (s, n) -> s + n))", levels - 1)
    own = _sums(f"p{levels}", f"if(k{levels} > 0, get({e}, k{levels} - 1), 0)")
    joined = f"flatten({_let(before, e, f'transform({b}, (p{levels}, k{levels}) -> {own})')})"
    few = f"size({x}) <= {_BLOCK}"
    return _let(lengths, x, f"CASE WHEN {few} THEN {_sums(x, '0')} ELSE {_let(_in_blocks(x, f'j{levels}'), b, joined)} END")


def _located(text: str, pattern: str) -> Column:
    """All matches in a column with offsets, and the end of what stands between a match and the one before."""
    steps = f"zip_with(f, slice(split({text}, r'{pattern}', -1), 1, size(f)), (v, b) -> named_struct('v', v, 'gap', length(b), 'before', right(b, {_CONTEXT})))"
    spans = f"zip_with(y, {_ends('transform(y, z -> z.gap + length(z.v))')}, (z, e) -> named_struct('s', e - length(z.v), 'e', e, 'v', z.v, 'before', z.before))"
    return F.expr(_let(f"regexp_extract_all({text}, r'{pattern}', 0)", "f", _let(steps, "y", spans)))


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _holds(kind, x["v"])


def _at_place(place: int):
    return lambda x: F.struct(F.lit(place).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of its own), and arrays of spans: one for each base kind, and one for each form of candidates that no base span overlaps."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("_t"))
    # texts without a format's fixed sign need no matching
    may = {"email": F.contains("_t", F.lit("@")), "ip": F.col("_t").rlike(r"[0-9]\.[0-9]"), "card": F.col("_t").rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains("_t", F.lit("+"))}
    may |= {"name": F.contains("_t", F.lit("@")) | F.col("_t").rlike(r" at [A-Za-z0-9-]+ dot |[(\[]at[)\]]"), "value": F.col("_t").rlike("[=:][\\x20\"']{0,2}[A-Za-z0-9]"), "number": F.col("_t").rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}")}
    base = own.select("doc_id", "row", "_t", *(F.when(may[k], F.filter(_located("_t", PATTERNS[k]), _checked(k))).otherwise(_none()).alias(k) for k in BASE))
    def candidates(form: str) -> Column:
        found = _located("_t", FORMS[form])
        if form == "number":
            found = F.filter(found, lambda x: F.length(_digits(x["v"])) <= 19)
        if form == "name":
            found = F.transform(found, _trimmed)
        return F.when(may[form], F.filter(found, lambda x: F.length(x["v"]) > 0)).otherwise(_none())

    taken = F.array_sort(F.flatten(F.array(*(F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in BASE))))
    base = base.select("doc_id", "row", *BASE, *(candidates(f).alias(f) for f in FORMS), taken.alias("taken"))
    return base.select("doc_id", "row", *BASE, *(_outside(f, "taken").alias(f) for f in FORMS))


def _trimmed(x: Column) -> Column:
    """A span without the signs around it."""
    left = F.regexp_extract(x["v"], r"^[^A-Za-z0-9+@(]*", 0)
    v = F.regexp_replace(F.substr(x["v"], F.length(left) + 1), r"[^A-Za-z0-9)]+$", "")
    start = x["s"] + F.length(left)
    return F.struct(start.alias("s"), (start + F.length(v)).alias("e"), v.alias("v"), F.concat(x["before"], left).alias("before"))


def _grouped(x: str, tag: str) -> str:
    """Structs with s and e, by s, as structs of s, e and own: blocks of _BLOCK with the stretch that each covers."""
    covered = f"named_struct('s', array_min(transform(o{tag}, y -> y.s)), 'e', array_max(transform(o{tag}, y -> y.e)), 'own', o{tag})"
    return _let(x, f"x{tag}", f"transform({_in_blocks(f'x{tag}', f'j{tag}')}, o{tag} -> {covered})")


def _outside(spans: str, taken: str) -> Column:
    """The spans of a column that overlap none of another (structs s and e, by s). Many taken ones are looked at by blocks of blocks."""
    def meets(x: str) -> str:
        return f"({x}.s < c.e AND c.s < {x}.e)"

    by_blocks = f"filter({spans}, c -> NOT exists(g0, g -> {meets('g')} AND exists(g.own, h -> {meets('h')} AND exists(h.own, t -> {meets('t')}))))"
    direct = f"filter({spans}, c -> NOT exists({taken}, t -> {meets('t')}))"
    return F.expr(f"CASE WHEN size({taken}) = 0 THEN {spans} WHEN size({taken}) <= {_BLOCK} THEN {direct} ELSE {_let(_grouped(_grouped(taken, '1'), '2'), 'g0', by_blocks)} END")


def _patterns(before: Column) -> Column:
    """The last word, and the last two, of what stands before. Signs that end labels belong to the word."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(before), r"[^\p{L}\p{N}:=#_]+", " "), r" ?([:=#])[:=# ]*", "$1 ")
    words = F.filter(F.split(joined, " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    one = F.when(F.size(words) > 0, F.array(F.element_at(words, -1))).otherwise(F.array().cast("array<string>"))
    two = F.when(F.size(words) > 1, F.array(F.array_join(F.slice(words, -2, 2), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(one, two)


def _instances(spans: DataFrame) -> DataFrame:
    """row, kind (of seeds, else null), form (null: a base span), s, e, value and patterns."""
    def typed(kind: str | None, form: str | None):
        def made(x: Column) -> Column:
            seed = F.lit(kind).cast("string")
            if form == "value":
                seed = F.when((F.length(x["v"]) >= SEED_VALUE) & (F.length(_digits(x["v"])) >= 2) & ~x["before"].rlike(_DIGEST), "secret")
            return F.struct(seed.alias("kind"), F.lit(form).cast("string").alias("form"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["before"].alias("before"))

        return made

    every = F.concat(*(F.transform(k, typed(k, None)) for k in BASE), *(F.transform(f, typed(None, f)) for f in FORMS))
    own = spans.select("row", F.explode(every).alias("x"))
    return own.select("row", "x.kind", "x.form", "x.s", "x.e", F.lower("x.v").alias("value"), _patterns(F.col("x.before")).alias("patterns"))


def discovered(spans: DataFrame) -> DataFrame:
    """row, kind, s and e of spans that the patterns add. spans: as located() gives it, materialised."""
    instances = materialise(_instances(spans), "pii-instances")
    free = instances.where("form is not null")
    graph = instances.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("seed"))
    graph = materialise(graph, "pii-graph")
    seeds = materialise(graph.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct(), "pii-seeds")
    width = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("width"))
    score = seeds.withColumn("score", F.lit(1.0))
    for _ in range(ROUNDS):
        hits = graph.join(score, "value").groupBy("pattern", "kind").agg(F.sum(F.round(F.col("score") * 1e6).cast("long")).alias("hit"), F.count_if(F.col("seed") == F.col("kind")).alias("seeds"))
        sure = hits.where(F.col("seeds") >= MIN_SEEDS).join(width, "pattern").withColumn("confidence", F.col("hit") / 1e6 / (F.col("width") + 1))
        sure = sure.where(F.col("confidence") >= PATTERN_CONFIDENCE).select("pattern", "kind", "confidence")
        lost = F.sum(F.round(F.log(1 - F.col("confidence")) * 1e6).cast("long")) / 1e6
        found = materialise(graph.join(sure, "pattern").groupBy("value", "kind").agg((1 - F.exp(lost)).alias("score")), "pii-scores")
        score = seeds.withColumn("score", F.lit(1.0)).unionByName(found.join(seeds.select("value"), "value", "left_anti"))
    form_of = F.create_map(*(x for f, kinds in _FORM_KINDS.items() for x in (F.lit(f), F.array(*map(F.lit, kinds)))))
    order = Window.partitionBy("value").orderBy(F.desc("score"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    best = found.where(F.col("score") >= INSTANCE_SCORE).withColumn("place", F.row_number().over(order)).where("place = 1").select("value", F.col("kind").alias("as_kind"))
    best = materialise(best, "pii-best")
    added = free.join(small(best), "value").where(F.array_contains(form_of[F.col("form")], F.col("as_kind")))
    return added.select("row", F.col("as_kind").alias("kind"), "s", "e").distinct()


def _written(spans: Column) -> Column:
    """kind:start:end of structs (place of the kind, s, e), comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans (base and discovered) and n_spans of each document."""
    spans = materialise(located(docs), "pii-spans")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    added = discovered(spans).groupBy("row").agg(F.collect_list(F.struct(place.alias("k"), "s", "e")).alias("added"))
    base = F.concat(*(F.transform(k, _at_place(n)) for n, k in enumerate(BASE, 1)))
    nothing = F.array().cast("array<struct<k:int,s:int,e:int>>")
    # only rows with candidates can have added spans; each has a number of its own, so no key is hot
    some = sum((F.size(f) for f in FORMS), F.lit(0)) > 0
    out = spans.where(some).join(added, "row", "left").unionByName(spans.where(~some).withColumn("added", nothing)).withColumn("base", base)
    out = out.withColumn("every", F.array_sort(F.concat("base", F.coalesce("added", nothing))))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span of the spans string replaced by its kind in brackets. Spans that overlap an earlier one are cut."""
    parts = F.transform(F.filter(F.split(spans, ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("e"), F.split_part(x, F.lit(":"), F.lit(1)).alias("k")))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["s"])
        return F.when(x["e"] <= acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, start - acc["at"]), F.lit("["), x["k"], F.lit("]")).alias("out"), x["e"].alias("at")))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(F.array_sort(parts), zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
