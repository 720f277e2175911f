"""Cleaning and titling of captured pages: line filters and rewrites as expressions, an Arrow function where there is none."""
from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import ship, text as T

# Lines that are a page's furniture, by host.
FURNITURE = {
    "linkedin": r"^(?:Like|Comment|Repost|Send|Share|Follow|Connect|Report this post|View profile for .*|\d[\d,]* (?:reactions|comments|reposts|followers)|To view or add a comment.*|Join now|Sign in)$",
    "x": r"^(?:Post|Reply|Repost|Like|Bookmark|Share|Show more|Show this thread|Translate post|Follow|Log in|Sign up|\d[\d.,]*[KM]?|\d+:\d+ [AP]M.*Views)$",
    "youtube": r"^(?:Subscribe|Share|Save|Download|Clip|Thanks|\d[\d.,]*[KM]? (?:views|likes|subscribers)|Show (?:more|less)|Transcript)$",
}
SHARE_LINE = r"^\s*(?:[-*]\s*)?\[?(?:Share|Tweet|Email|Print|Pin it|Copy link|Facebook|Twitter|LinkedIn|WhatsApp|Reddit)\]?(?:\([^)]*\))?\s*$"
BAIT_TITLES = r"(?i)^(?:post|tweet|untitled|home|feed|page|index|article|thread|x|linkedin|log ?in|sign ?in|(?:\d+|\(\d+\))\s*(?:notifications?|linkedin|x)?)(?:\s*[|/·-]\s*(?:linkedin|x|twitter|medium|substack))?$"
# Prefixes of titles by kind of source.
PREFIXES = {"github": "GitHub", "arxiv": "arXiv", "x": "X", "linkedin": "LinkedIn", "youtube": "YouTube", "medium": "Medium", "substack": "Substack", "huggingface": "Hugging Face"}
ACRONYMS = ("AI", "API", "CPU", "GPU", "LLM", "RAG", "SQL", "NLP", "PDF", "HTML", "JSON", "ML", "MCP", "CLI", "UI")
IMAGE = r"!\[[^\]]*\]\([^)]*\)"


def kept_lines(body: Column, drop: str) -> Column:
    """The body without lines that match."""
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~F.trim(x).rlike(drop)), "\n")


def cleaned(body: Column, kind: Column) -> Column:
    """Furniture of the source's host, share widgets and empty bullets removed; runs of blank lines become one."""
    out = body
    for name, drop in FURNITURE.items():
        out = F.when(kind == name, kept_lines(body, drop)).otherwise(out)
    out = kept_lines(kept_lines(out, SHARE_LINE), r"^[-*]$")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def without_comments_section(body: Column) -> Column:
    """A video page without its comments, up to the next heading."""
    return F.regexp_replace(body, r"(?ms)^##+\s*(?:\d[\d,]*\s+)?Comments\b.*?(?=^##+\s|\z)", "")


def without_blob_videos(body: Column) -> Column:
    return F.regexp_replace(body, r"""(?is)<video\b[^>]*\bsrc=["']blob:[^"']*["'][^>]*>(?:.*?</video>)?|!\[[^\]]*\]\(blob:[^)]*\)""", "")


def smaller_images(body: Column, name: str = "medium") -> Column:
    """Sizes in the query of image hosts set to one name."""
    return F.regexp_replace(body, r"(https://pbs\.twimg\.com/media/[^\s)?]+\?[^\s)]*name=)(?:large|orig|4096x4096|small)", f"$1{name}")


def distinct_images(body: Column) -> Column:
    """Consecutive equal image lines once."""
    lines = F.split(body, "\n")
    keep = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(lines, i - 1).alias("before"))), lambda s: ~(s["x"].rlike(rf"^\s*{IMAGE}\s*$") & F.coalesce(F.trim(s["x"]) == F.trim(s["before"]), F.lit(False))))
    return F.array_join(F.transform(keep, lambda s: s["x"]), "\n")


def cut_keeping_images(body: Column, limit: int) -> Column:
    """The first characters, and the images that the cut would lose."""
    head = F.substring(body, 1, limit)
    lost = F.array_except(F.regexp_extract_all(body, F.lit(f"({IMAGE})"), 1), F.regexp_extract_all(head, F.lit(f"({IMAGE})"), 1))
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(head, F.when(F.size(lost) > 0, F.concat(F.lit("\n\n"), F.array_join(lost, "\n"))).otherwise(F.lit(""))))


def absolute_links(body: Column, owner_repo: Column, branch: str = "HEAD") -> Column:
    """Images relative to a repository's root made absolute; paths that climb out are left alone."""
    marked = F.regexp_replace(body, r"(!\[[^\]]*\]\()(?!https?://|data:|#|[^)]*\.\./)\.?/?([^)\s]+)", "$1\u0001$2")
    return F.replace(marked, F.lit("\u0001"), F.concat(F.lit("https://raw.githubusercontent.com/"), owner_repo, F.lit(f"/{branch}/")))


def asset_links(body: Column, assets: Column) -> Column:
    """URLs of a map replaced by local paths."""
    return F.aggregate(F.map_entries(assets), body, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def normal_tables(body: Column) -> Column:
    """Table rows with a bar at both ends."""
    return F.array_join(F.transform(F.split(body, "\n"), lambda x: F.when(x.rlike(r"^\s*\|.*[^|\s]\s*$"), F.concat(F.rtrim(x), F.lit(" |"))).otherwise(x)), "\n")


def thread_text(body: Column) -> Column:
    """Posts out of an escaped JSON array of strings, parted by rules; other bodies as they are."""
    posts = F.from_json(F.regexp_extract(body, r"(?s)(\[\s*\".*\"\s*\])", 1), "array<string>")
    return F.coalesce(F.when(F.size(posts) > 0, F.array_join(posts, "\n\n---\n\n")), body)


def own_statuses(body: Column, handle: Column) -> Column:
    """Distinct status numbers of one author in a body."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)(?:x|twitter)\.com/([A-Za-z0-9_]{1,15}/status/[0-9]+)"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda s: F.lower(F.substring_index(s, "/", 1)) == F.lower(handle)), lambda s: F.substring_index(s, "/", -1)))


def is_self_thread(body: Column, handle: Column, head: Column) -> Column:
    """Three statuses or more of the author besides the head."""
    return F.size(F.array_except(own_statuses(body, handle), F.array(head))) >= 3


def is_bait_title(title: Column) -> Column:
    return F.trim(title).rlike(BAIT_TITLES)


def derived_title(body: Column, limit: int = 80) -> Column:
    """The first line of prose of 15 characters or more, without markup, cut."""
    lines = F.filter(F.split(T.strip_markdown(body), "\n"), lambda x: (F.length(F.trim(x)) >= 15) & ~x.rlike("^https?://"))
    return T.smart_truncate(F.trim(F.get(lines, F.lit(0))), limit)


def slug_title(slug_words: Column, candidates: Column) -> Column:
    """Of candidate titles the one that shares most of the slug's words; at least half."""
    words = F.array_distinct(F.filter(F.split(F.lower(slug_words), "[^a-z0-9]+"), lambda w: F.length(w) > 2))

    def share(c: Column) -> Column:
        own = F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
        return F.size(F.array_intersect(words, own)) / F.greatest(F.size(words), F.lit(1))

    scored = F.array_sort(F.transform(candidates, lambda c, i: F.struct((-share(c)).alias("s"), i.alias("i"), c.alias("c"))))
    best = F.get(scored, F.lit(0))
    return F.when(best["s"] <= -0.5, best["c"])


def without_masthead(title: Column) -> Column:
    """A trailing ' | Site' or ' - Site' dropped if it is short and something is left."""
    short = F.regexp_replace(title, r"\s+[|–—-]\s+[^|–—-]{1,30}$", "")
    return F.when(F.size(F.split(F.trim(short), r"\s+")) >= 3, short).otherwise(title)


def acronyms_restored(title: Column) -> Column:
    for a in ACRONYMS:
        title = F.regexp_replace(title, rf"(?i)\b{a}\b", a)
    return title


def conventional_title(title: Column, kind: Column, limit: int = 100) -> Column:
    """Prefix by kind of source ('Web' for others), acronyms restored, cut at a word."""
    names = F.create_map(*(x for kv in PREFIXES.items() for x in map(F.lit, kv)))
    prefix = F.coalesce(F.element_at(names, kind), F.lit("Web"))
    bare = acronyms_restored(F.trim(title))
    own = F.when(bare.startswith(F.concat(prefix, F.lit(":"))), bare).otherwise(F.concat(prefix, F.lit(": "), bare))
    return T.smart_truncate(own, limit)


def file_name(title: Column, limit: int = 120) -> Column:
    """Characters that file systems and links forbid replaced, ends trimmed, cut."""
    clean = F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|#^\[\]]+', "-"), r"[\x00-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(F.substring(F.regexp_replace(clean, r"\s+", " "), 1, limit), r"[ .]+$", ""), r"^[ .]+", "")


def folded_typography(value: Column) -> Column:
    """Mathematical and other compatibility letters to plain ones (NFKD without combining marks): no built-in function does it."""
    ship.send()
    fold = unicodedata.normalize

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        out = []
        for t in batch.to_pylist():
            special = t is not None and any(0x1D400 <= ord(c) <= 0x1D7FF or 0xFF01 <= ord(c) <= 0xFF5E for c in t)
            out.append("".join(c for c in fold("NFKD", t) if not unicodedata.combining(c)) if special else t)
        return pa.array(out, pa.string())

    return run(value)


def best_paragraph(body: Column, passes: tuple[int, ...] = (150, 50, 30)) -> Column:
    """The first paragraph of prose that is long enough, in three passes of falling length; markup and furniture don't count."""
    parts = F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(T.strip_markdown(p), r"\s+", " ")))
    prose = F.filter(parts, lambda p: ~p.rlike(r"^(?:https?://|[-*|#>]|\d+\.)") & ~p.rlike(r"(?i)cookie|sign in|subscribe|table of contents|all rights reserved"))
    return F.coalesce(*(F.get(F.filter(prose, _long_enough(n)), F.lit(0)) for n in passes))


def _long_enough(n: int):
    return lambda p: F.length(p) >= n


def keyword_tags(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Tags any of whose words stands inside the text (also inside longer words)."""
    low = F.lower(text)
    return F.filter(F.array(*(F.when(_any_inside(low, words), F.lit(tag)) for tag, words in rules.items())), lambda t: t.isNotNull())


def _any_inside(low: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def canonical_tags(tags: Column, aliases: dict[str, str], allowed: tuple[str, ...]) -> Column:
    """Aliases mapped, others than the allowed dropped, distinct."""
    named = F.create_map(*(x for kv in (aliases or {"": ""}).items() for x in map(F.lit, kv)))
    mapped = F.transform(tags, lambda t: F.coalesce(F.element_at(named, F.lower(F.trim(t))), F.lower(F.trim(t))))
    return F.array_distinct(F.filter(mapped, lambda t: F.array_contains(T.literals(allowed), t)))


def digest(reply: Column, schema: str = "summary string, key_findings array<string>, tags array<string>") -> Column:
    """The JSON of a model's reply, with or without fences and a preamble."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema)


def with_summary(page: Column, summary: Column) -> Column:
    """The page's summary line replaced."""
    line = F.concat(F.lit('summary: "'), T.escape_yaml(summary), F.lit('"'))
    head = F.regexp_extract(page, r"(?s)^(.*?\n)summary:[^\n]*\n", 1)
    rest = F.regexp_extract(page, r"(?s)^.*?\nsummary:[^\n]*(\n.*)$", 1)
    return F.when(page.rlike(r"(?m)^summary:"), F.concat(head, line, rest)).otherwise(page)


def pending_synthesis(body: Column) -> Column:
    return F.contains(body, F.lit("*Pending"))


def body_for_synthesis(raw_body: Column, page_body: Column, limit: int = 12_000) -> Column:
    return F.substring(F.coalesce(F.nullif(raw_body, F.lit("")), page_body), 1, limit)


def post_markdown(post: Column) -> Column:
    """A post's JSON (text, urls, media, quoted) as markdown: short URLs expanded, media embedded, the quoted post below."""
    p = F.from_json(post, "text string, urls array<struct<url:string,expanded_url:string>>, media array<string>, quoted struct<author:string,text:string>")
    text = F.aggregate(F.coalesce(p["urls"], F.array().cast("array<struct<url:string,expanded_url:string>>")), p["text"], lambda acc, u: F.replace(acc, u["url"], u["expanded_url"]))
    images = F.array_join(F.transform(F.coalesce(p["media"], F.array().cast("array<string>")), lambda m: F.concat(F.lit("![]("), m, F.lit(")"))), "\n")
    quoted = F.when(p["quoted"].isNotNull(), F.concat(F.lit("> "), p["quoted"]["author"], F.lit(": "), F.regexp_replace(p["quoted"]["text"], "\n", "\n> ")))
    return F.concat_ws("\n\n", text, F.nullif(images, F.lit("")), quoted)


def html_property(html: Column, name: str) -> Column:
    """Content of a meta property."""
    one = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    other = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*(?:property|name)=["']{name}["']""", 1)
    return T.html_unescape(F.coalesce(F.nullif(one, F.lit("")), other))


def partial_capture(body: Column) -> Column:
    """A mark of a failed fetch, or fewer than five lines."""
    return body.rlike(r"(?i)fetch failed|content unavailable") | (F.size(F.split(F.trim(body), "\n")) < 5)


def capture_status(status: Column, body: Column) -> Column:
    return F.when(F.length(F.trim(body)) < 200, "thin").otherwise(status)


def wrapped(text: Column, width: int = 80) -> Column:
    """Lines of at most so many characters, broken at spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), rf"(.{{1,{width}}})(?:\s|$)", "$1\n"), r"\s+$", "")


def body_problem(body: Column) -> Column:
    """Why a digest's body is refused, or null: findings must be there and not be a placeholder."""
    found = F.trim(F.regexp_extract(body, r"(?s)## Key Findings\n+(.*?)(?=\n## |$)", 1))
    return F.when(body.isNull() | (F.trim(body) == ""), "body-empty").when(~F.contains(body, F.lit("## Key Findings")), "missing-key-findings").when((found == "") | found.startswith("*Pending"), "key-findings-empty")


def url_in_body(values: Column, body: Column, skipped: tuple[str, ...] = ("w3.org", "schema.org", "localhost")) -> Column:
    """A raw's URL: front matter, then a source bullet, then the first bare URL off the skipped hosts."""
    known = F.coalesce(F.nullif(F.element_at(values, F.lit("source")), F.lit("")), F.nullif(F.element_at(values, F.lit("url")), F.lit("")))
    bullet = F.nullif(F.regexp_extract(body, r"(?im)^[-*]\s*\**(?:source|url)\**:?\**\s*(https?://\S+)", 1), F.lit(""))
    bare = F.filter(F.regexp_extract_all(body, F.lit(r"(https?://[^\s)>\]\"']+)"), 1), lambda u: ~u.rlike("|".join(skipped)))
    return F.coalesce(known, bullet, F.get(bare, F.lit(0)))


def is_redirect(values: Column) -> Column:
    return F.lower(F.coalesce(F.element_at(values, F.lit("redirect")), F.lit(""))) == "true"


def is_merged(values: Column) -> Column:
    return F.coalesce(F.element_at(values, F.lit("merged_into")), F.lit("")) != ""


def without_title_lines(body: Column, title: Column) -> Column:
    """Leading lines that only repeat the title, breadcrumbs and empty bullets dropped."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(r"^\s*(?:[-*]|(?:\S+\s*[>›»]\s*){2,}\S*)\s*$"))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~((s["i"] < 3) & (plain(s["x"]) == plain(title)) & (plain(s["x"]) != "")))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"), r"^\s+|\s+$", "")


def fallback_page(body: Column, url: Column, kind: Column, rules: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """Title, summary and tags of a page without a model's help."""
    heading = F.nullif(F.regexp_extract(body, r"(?m)^# +(.+)$", 1), F.lit(""))
    title = F.coalesce(F.when(~is_bait_title(heading), heading), derived_title(body), url)
    return {"title": conventional_title(title, kind), "summary": T.smart_truncate(F.coalesce(best_paragraph(body), F.lit("")), 600), "tags": keyword_tags(F.concat_ws(" ", title, F.substring(body, 1, 4000)), rules)}


def icon(host: Column, icons: dict[str, str], default: str = "🌐") -> Column:
    """The sign of a host, of its last two labels, or the default."""
    from .urls import registrable

    named = F.create_map(*(x for kv in (icons or {"": ""}).items() for x in map(F.lit, kv)))
    return F.coalesce(F.element_at(named, host), F.element_at(named, registrable(host)), F.lit(default))


def migrated(values: Column, body: Column) -> Column:
    """A legacy raw (header map and content) with front matter."""
    head = F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(': "'), T.escape_yaml(e["value"]), F.lit('"'))), "\n")
    return F.when(F.size(values) > 0, F.concat(F.lit("---\n"), head, F.lit("\n---\n\n"), body)).otherwise(body)


def without_actor_chrome(body: Column) -> Column:
    """Four passes over a professional post: actor links, profile cards, reaction bars, sign-in prompts. Images that they held are put back at the end."""
    images = F.regexp_extract_all(body, F.lit(f"({IMAGE})"), 1)
    out = body
    for pattern in (r"(?m)^.*\]\([^)]*trk=[^)\s]*[_-]actor[^)]*\).*$", r"(?m)^\s*View profile for .*$", r"(?m)^\s*(?:\d[\d,]*\s+(?:reactions?|comments?|reposts?)\s*[·•]?\s*)+$", r"(?im)^\s*(?:sign in|join now|to view or add a comment).*$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    lost = F.array_except(images, F.regexp_extract_all(out, F.lit(f"({IMAGE})"), 1))
    return F.concat(out, F.when(F.size(lost) > 0, F.concat(F.lit("\n\n"), F.array_join(lost, "\n"))).otherwise(F.lit("")))


def intake(clips, rules: dict[str, tuple[str, ...]]):
    """clips (path, content) as rows for the writer: source, title, body and a reason for quarantine (no front matter, no source)."""
    from . import frontmatter as FM, urls as U

    own = clips.withColumn("fm", FM.front_matter(F.col("content")))
    source = FM.source_url(F.col("fm.values"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    kind = U.source_kind(U.domain(F.coalesce(source, F.lit(""))))
    body = cleaned(smaller_images(without_blob_videos(thread_text(F.col("fm.body")))), kind)
    title = F.coalesce(F.nullif(F.element_at("fm.values", F.lit("title")), F.lit("")), stem)
    reason = F.when(~F.col("fm.found"), "no front matter").when(source.isNull(), "no source")
    return own.select("path", source.alias("source"), F.when(is_bait_title(title), F.coalesce(derived_title(body), title)).otherwise(title).alias("title"), body.alias("body"), keyword_tags(body, rules).alias("tags"), reason.alias("reason"))
