"""Text functions over columns: built-in expressions, so plans stay in whole-stage code where Spark allows it."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Words left out of queries.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must",
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "they",
    "this", "that", "these", "those", "what", "which", "who", "whom",
    "and", "or", "but", "if", "of", "at", "by", "for", "with", "about",
    "to", "from", "in", "on", "not", "no", "so", "up", "out",
    "show", "find", "get", "give", "tell", "list", "where", "how", "all",
    "like", "just", "also", "more", "some", "any", "each", "every", "both",
    "here", "there", "when", "then", "than", "very", "too", "only",
    "want", "know", "see", "look", "make", "take", "let", "try", "use",
    "link", "links", "page", "pages", "file", "files", "note", "notes",
    "please", "thanks", "help", "related", "using",
)
# Words left out of keyphrases besides the above.
PHRASE_STOP_WORDS = (
    "also", "new", "used", "using", "based", "key", "first", "two", "three", "one", "may", "can",
    "including", "provides", "supports", "features", "source", "open", "free", "available", "designed",
)


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def unicode_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


#: What tokens are made of, as the inside of a character class.
ASCII, UNICODE = "a-z", r"\p{L}\p{N}_"


def token_number(low: Column, letters: str = ASCII) -> Column:
    """How many tokens a lower-cased text has."""
    return F.regexp_count(low, F.lit(f"[{letters}]+"))


def token_hits(low: Column, term: str, letters: str = ASCII) -> Column:
    """How many tokens of a lower-cased text are the term; texts that don't hold it aren't matched."""
    if not term or (letters == ASCII and not re.fullmatch("[a-z]+", term)):
        return F.lit(0)
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(rf"(?<![{letters}])\Q{term}\E(?![{letters}])"))).otherwise(0)


def query_terms(query: str, stop_words=STOP_WORDS) -> list[str]:
    """Terms of a query, without stop words unless nothing else is left."""
    terms = re.sub(r"[^\w\s]", " ", query).split()
    return [t for t in terms if t.lower() not in stop_words] or terms


def strip_markdown(text: Column) -> Column:
    """Plain text of markdown: fences, comments, images, links, headings, emphasis, rules and table marks removed, in this order."""
    steps = (
        (r"(?s)```.*?```", ""), (r"(?s)<!--.*?-->", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
        (r"\[\[([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
        (r"_{1,3}([^_]+)_{1,3}", "$1"), (r"(?m)^[-*_]{3,}\s*$", ""), (r"\|", " "), (r"(?m)^[-:| ]+$", ""), (r"\n{3,}", "\n\n"),
    )
    for pattern, into in steps:
        text = F.regexp_replace(text, pattern, into)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def wikilinks(text: Column) -> Column:
    """Targets of [[target]] and [[target|shown]], trimmed, first occurrence first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), 1), lambda x: F.trim(x)))


def chunks(body: Column) -> Column:
    """Sections at second and third level headings: array of (heading, level, text); one without heading if there is none."""
    mark = "\u0001"
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), mark, ""), r"(?m)^(#{2,3})[ \t]+(\S.*)$", f"{mark}$1 $2{mark}")
    parts = F.split(marked, mark, -1)  # text, heading, text, heading, text ...
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    first = F.struct(F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("level"), trimmed(parts[0]).alias("text"))

    def section(i: Column) -> Column:
        head = F.element_at(parts, (i * 2).cast("int"))
        return F.struct(trimmed(F.regexp_replace(head, r"^#{2,3}\s+", "")).alias("heading"), F.length(F.regexp_extract(head, r"^(#{2,3})", 1)).alias("level"), trimmed(F.element_at(parts, (i * 2 + 1).cast("int"))).alias("text"))

    n = F.floor(F.size(parts) / 2).cast("int")
    rest = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), section)).otherwise(F.array().cast("array<struct<heading:string,level:int,text:string>>"))
    found = F.concat(F.when((F.length(first["text"]) > 0) | (n == 0), F.array(first)).otherwise(F.array().cast("array<struct<heading:string,level:int,text:string>>")), rest)
    return found


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def page_id(vault: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", vault, path), 256), 1, 16)


def chunk_id(page: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(page, F.lit(":chunk:"), index.cast("string")), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def parse_number(text: Column) -> Column:
    """Ranges give their larger end, then K and M suffixes; stars and thousands marks are dropped; else 0."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[,★⭐~+]", ""))
    span = F.regexp_extract_all(clean, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    in_range = clean.rlike(r"^[0-9.]+\s*[-–—]\s*[0-9.]+")
    scaled = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)\s*[kKmM]\b", 1)
    unit = F.when(clean.rlike(r"^[0-9.]+\s*[kK]\b"), 1e3).when(clean.rlike(r"^[0-9.]+\s*[mM]\b"), 1e6)
    plain = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(in_range, F.array_max(F.transform(span, lambda x: x.try_cast("double")))).when(unit.isNotNull(), scaled.try_cast("double") * unit).otherwise(F.coalesce(plain.try_cast("double"), F.lit(0.0)))


def markdown_table(body: Column, index: int = 0, keep_empty_cells: bool = True) -> Column:
    """The n-th table of three lines or more as an array of maps from header to cell; of equal headers the last cell counts.

    keep_empty_cells=False drops empty cells, so later ones move left (as the compared tool does).
    """
    tables = F.regexp_extract_all(F.concat(F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("\n")), F.lit(r"((?:\n[ \t]*\|[^\n]*){3,})"), 1)
    lines = F.filter(F.split(F.get(tables, F.lit(index)), "\n"), lambda x: F.trim(x) != "")

    def cells(line: Column) -> Column:
        plain = F.regexp_replace(line, r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1")
        inner = F.regexp_replace(F.trim(plain), r"^\||\|$", "")
        own = F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1"), "[*`]", "")))
        return own if keep_empty_cells else F.filter(own, lambda c: c != "")

    def row(head: Column, line: Column) -> Column:
        last = lambda h, i: F.size(head) - F.array_position(F.reverse(head), h) == i
        entries = lambda own: F.transform(head, lambda h, i: F.struct(h.alias("h"), F.get(own, i).alias("v"), last(h, i).alias("last")))
        return bound(cells(line), lambda own: F.map_from_entries(F.transform(F.filter(entries(own), lambda e: e["last"]), lambda e: F.struct(e["h"], e["v"]))))

    def rows(own: Column, head: Column) -> Column:
        kept = F.filter(F.slice(own, 3, F.greatest(F.size(own) - 2, F.lit(0))), lambda r: ~r.rlike(r"^\s*\|\s*\*\*[^|]*\*\*\s*\|\s*(\|\s*)*$"))
        return F.transform(kept, lambda line: row(head, line))

    return bound(lines, lambda own: bound(cells(F.get(own, F.lit(0))), lambda head: rows(own, head)))


def smart_truncate(text: Column, limit: int) -> Column:
    """At most limit characters: cut after a sentence if one ends in the second half, else at a word, with an ellipsis."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(F.substring(text, 1, limit - 1), r"(?s)^(.*\S)\s", 1)
    return F.when(F.length(text) <= limit, text).when(F.length(sentence) >= limit // 2, sentence).when(word != "", F.concat(word, F.lit("…"))).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def candidate_phrases(text: Column, most: int = 3) -> Column:
    """Distinct n-grams of 1 to most words, without markup, links, stop words, short words and numbers."""
    for pattern, into in ((r"(?s)```.*?```", ""), (r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"[#*_`|>~]", ""), (r"https?://\S+", ""), (r"[^a-zA-Z0-9\s-]", " ")):
        text = F.regexp_replace(text, pattern, into)
    stop = literals(dict.fromkeys(STOP_WORDS + PHRASE_STOP_WORDS))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$"))

    def phrases(own: Column) -> Column:
        grams = []
        for n in range(1, most + 1):
            at = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(at, _gram(own, n)))
        return F.array_distinct(F.filter(F.concat(*grams), lambda p: F.length(p) > 3))

    return bound(words, phrases)


def _gram(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")


def bound(value: Column, of) -> Column:
    """of(value), with value worked out once: what a lambda uses from outside is else worked out for each element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def unescape_yaml(value: Column) -> Column:
    """Escaped quotes and backslashes of a double-quoted YAML string undone, in this order; other escapes stay as they are."""
    for a, b in ((r"\"", '"'), ("\\\\", "\\")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def escape_yaml(value: Column) -> Column:
    """For a double-quoted YAML string on one line."""
    for a, b in (("\\", "\\\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def html_unescape(value: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def html_text(html: Column) -> Column:
    """What a page shows: without its head, scripts, styles, comments and tags, blanks run together. Entities stay as they are."""
    text = F.coalesce(html, F.lit(""))
    for pattern in (r"(?is)<head[ >].*?</head>", r"(?is)<script[ >].*?</script>", r"(?is)<style[ >].*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>", r"[ \t\r\n]+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>([^<]*)</title>", 1))


def subtitle_transcript(vtt: Column) -> Column:
    """Lines of a subtitle file without header, cues, numbers, tags and repeats, joined by spaces."""
    lines = F.transform(F.split(F.coalesce(vtt, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE|[0-9]+$)") & ~x.contains("-->"))
    return F.array_join(F.array_distinct(kept), " ")


def embed_urls(html: Column, denied=()) -> Column:
    """http(s) sources of iframes, embeds and objects, fragments dropped, hosts of the denied list left out."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<(?:iframe|embed|object)\b[^>]*?\s(?:src|data)\s*=\s*["']?([^"'\s>]+)"""), 1)
    clean = F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(F.replace(u, F.lit("&amp;"), F.lit("&")), "^//", "https://"), "#.*$", ""))
    kept = F.filter(clean, lambda u: u.rlike("(?i)^https?://"))
    if denied:
        kept = F.filter(kept, lambda u: ~F.exists(literals(denied), lambda d: F.contains(F.lower(u), d)))
    return F.array_distinct(kept)


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def term_counts(words: Column) -> Column:
    """keyword and tf of each distinct word of an array, counted inside the row: nothing is shuffled. Of sorted words those that end a run are kept."""
    def of(w: Column) -> Column:
        ends = F.filter(F.transform(w, lambda _, i: i + 1), lambda i: (i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1)))
        one = lambda at: F.transform(at, lambda e, j: F.struct(F.get(w, e - 1).alias("keyword"), (e - F.coalesce(F.get(at, j - 1), F.lit(0))).cast("long").alias("tf")))
        return F.get(F.transform(F.array(ends), one), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(words)), of), F.lit(0))  # bound once, not worked out for each word
