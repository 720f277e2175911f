"""URL identity: canonical forms, source kinds, slugs, references. Built-in expressions only."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import literals

# Query parameters that never name content.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "rcm", "usp",
    "fbclid", "gclid", "mc_eid", "mc_cid", "_ga", "_gl",
    "share", "share_via", "share_id",
    "igshid", "feature",
)
#: Also dropped where ledgers are compared.
LEDGER_TRACKING = TRACKING + ("s", "t", "ref", "si", "igsh")
# Hosts whose queries are dropped whole; hosts of which only some parameters stay.
NO_QUERY_HOSTS = ("x.com", "twitter.com", "linkedin.com", "substack.com", "medium.com")
KEPT_PARAMETERS = {"youtube.com": ("v", "list", "t"), "youtu.be": ("t",)}
# Paths that name a view, not an item.
CONTENTLESS_PATHS = ("", "/feed", "/feed/update", "/home", "/explore", "/search", "/timeline", "/dashboard")
# Slugs that many different pages would share.
BAIT_SLUGS = ("post-linkedin", "untitled", "untitled-page", "tweet", "readme", "page", "post", "index", "home", "404", "error", "not-found")
# Owners and names of repositories that stand in examples.
PLACEHOLDERS = (
    "my-org", "my-username", "my-user", "my-account", "my-repo", "my-project",
    "your-org", "your-username", "your-user", "your-account", "your-repo", "your-project",
    "org", "user", "username", "repo", "project",
    "orgname", "reponame", "projectname",
    "example", "example-org", "example-repo",
    "foo", "bar", "baz", "foo-bar",
    "placeholder", "sample",
)
#: How slugs are made: from the URL, from the title, or from the URL if it gives one.
SLUG_POLICY = {"papers": "url_preferred", "repos": "url", "webpages": "url", "videos": "url", "images": "url_preferred", "books": "title"}
SLUG_LENGTH = 80

_SPLIT = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parts(url: Column) -> dict[str, Column]:
    """scheme, host (lower-cased, without www.), path, query and fragment; all empty for what is no absolute URL."""
    own = {k: F.coalesce(F.regexp_extract(url, _SPLIT, i), F.lit("")) for i, k in enumerate(("scheme", "host", "path", "query", "fragment"), 1)}
    own["scheme"] = F.lower(own["scheme"])
    own["host"] = F.regexp_replace(F.lower(own["host"]), r"^www\.", "")
    own["path"] = F.rtrim(own["path"])
    return own


def source_kind(host: Column) -> Column:
    """Coarse class of a host (lower-cased, without www.)."""
    under = lambda name: (host == name) | host.endswith(f".{name}")
    return (
        F.when(host == "arxiv.org", "arxiv")
        .when(host.isin("github.com", "raw.githubusercontent.com"), "github")
        .when(host == "huggingface.co", "huggingface")
        .when(host.isin("x.com", "twitter.com"), "x")
        .when(under("linkedin.com"), "linkedin")
        .when(under("substack.com"), "substack")
        .when(under("medium.com"), "medium")
        .when(host.isin("youtube.com", "youtu.be", "m.youtube.com"), "youtube")
        .when(host.isin("drive.google.com", "docs.google.com"), "google_drive")
        .when(host.isin("doi.org", "dx.doi.org"), "doi")
        .otherwise("other")
    )


def kept_query(host: Column, query: Column, tracking=TRACKING) -> Column:
    """The query without tracking parameters and blank values, by the host's policy, in its own order."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+"))
    key = lambda p: F.substring_index(p, "=", 1)
    general = F.filter(pairs, lambda p: ~F.array_contains(literals(tracking), key(p)))
    out = general
    for name, kept in KEPT_PARAMETERS.items():
        out = F.when(host == name, F.filter(pairs, _keeps(kept))).otherwise(out)
    none = host.isin(*NO_QUERY_HOSTS) | host.endswith(".substack.com")
    encoded = F.transform(out, lambda p: F.concat(key(p), F.lit("="), F.replace(F.replace(F.substr(p, F.instr(p, "=") + 1), F.lit("%20"), F.lit("+")), F.lit(" "), F.lit("+"))))
    return F.when(none, "").otherwise(F.array_join(encoded, "&"))


def _keeps(names: tuple[str, ...]):
    return lambda p: F.array_contains(literals(names), F.substring_index(p, "=", 1))


# Shapes of paths and parameters that name one item.
_PAPER = r"^/(?:abs|pdf|html)/(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$"
_PAPER_DOI = r"(?i)^/10\.48550/arXiv\.([0-9]{4}\.[0-9]{4,5})$"
_FEED_ITEM = r"(?i)^/feed/update/urn:li:(?:ugcPost|activity):([0-9]+)/?$"
_AUTHOR_ITEM = r"(?i)^/posts/[^/]*-(?:ugcPost|activity|share)-([0-9]+)(?:-[A-Za-z0-9_-]+)?/?$"
_BARE_ITEM = r"(?i)^/posts/(?:ugcpost|activity|share)-([0-9]+)/?$"
_URN_ITEM = r"(?i)(?:^|&)(?:highlightedUpdateUrn|shareUrn|updateUrn)=urn(?::|%3A)li(?::|%3A)(?:ugcPost|activity|share)(?::|%3A)([0-9]+)(?:&|$)"


def _first(*found: Column) -> Column:
    return F.coalesce(*(F.when(c != "", c) for c in found))


def canonical(url: Column, tracking=TRACKING) -> dict[str, Column]:
    """url: the canonical form; kind: its source kind; identity_lost: whether what named the content was dropped.

    What is no absolute URL stays as it is. The canonical form of a canonical form is itself.
    """
    p = parts(url)
    host, path = p["host"], p["path"]
    professional = (host == "linkedin.com") | host.endswith(".linkedin.com")
    paper = _first(F.when(host == "arxiv.org", F.regexp_extract(path, _PAPER, 1)), F.when(host.isin("doi.org", "dx.doi.org"), F.regexp_extract(path, _PAPER_DOI, 1)))
    item = F.when(professional, _first(F.regexp_extract(path, _FEED_ITEM, 1), F.regexp_extract(path, _AUTHOR_ITEM, 1), F.regexp_extract(path, _BARE_ITEM, 1), F.regexp_extract(p["query"], _URN_ITEM, 1)))
    viewer = r"(?i)^/([^/]+)/([^/]+)/blob/(.+)$"
    raw_file = (host == "github.com") & path.rlike(viewer)
    model_file = (host == "huggingface.co") & path.rlike(viewer)
    new_scheme = F.when(paper.isNotNull() & host.isin("doi.org", "dx.doi.org"), "https").otherwise(p["scheme"])
    new_host = F.when(paper.isNotNull(), "arxiv.org").when(raw_file, "raw.githubusercontent.com").otherwise(host)
    new_path = (
        F.when(paper.isNotNull(), F.concat(F.lit("/abs/"), paper))
        .when(raw_file, F.regexp_replace(path, viewer, "/$1/$2/$3"))
        .when(model_file, F.regexp_replace(path, viewer, "/$1/$2/resolve/$3"))
        .when(item.isNotNull(), F.concat(F.lit("/posts/ugcpost-"), item))
        .otherwise(path)
    )
    new_path = F.when(new_path == "/", "/").otherwise(F.regexp_replace(new_path, "/+$", ""))
    query = F.when(paper.isNotNull() | item.isNotNull(), "").otherwise(kept_query(host, p["query"], tracking))
    absolute = p["host"] != ""
    built = F.concat(new_scheme, F.lit("://"), new_host, new_path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    route = F.trim(p["fragment"]).rlike("^[/!]")
    residual = F.exists(F.filter(F.split(p["query"], "&"), lambda x: x.rlike("^[^=]+=.+")), lambda x: ~F.array_contains(literals(TRACKING), F.lower(F.substring_index(x, "=", 1))))
    lost = absolute & (route | ((query == "") & residual & F.array_contains(literals(CONTENTLESS_PATHS), F.lower(F.regexp_replace(new_path, "/+$", "")))))
    return {
        "url": F.when(absolute, built).otherwise(F.coalesce(url, F.lit(""))),
        "kind": F.when(absolute, source_kind(new_host)).otherwise("other"),
        "identity_lost": lost,
    }


def canonical_url(url: Column, tracking=TRACKING) -> Column:
    return canonical(url, tracking)["url"]


def resolvable(url: Column) -> Column:
    """The permalink of a highlighted post, keeping the kind of its number; any other URL as it is."""
    p = parts(url)
    urn = r"(?i)(?:^|&)highlightedUpdateUrn=urn(?::|%3A)li(?::|%3A)(ugcPost|activity|share)(?::|%3A)([0-9]+)(?:&|$)"
    fits = ((p["host"] == "linkedin.com") | p["host"].endswith(".linkedin.com")) & p["path"].rlike("(?i)^/feed/?$") & p["query"].rlike(urn)
    return F.when(fits, F.concat(F.lit("https://www.linkedin.com/feed/update/urn:li:"), F.regexp_extract(p["query"], urn, 1), F.lit(":"), F.regexp_extract(p["query"], urn, 2), F.lit("/"))).otherwise(url)


def unservable(canonical_form: Column) -> Column:
    """Whether a canonical form is a key that its host does not serve."""
    p = parts(canonical_form)
    return ((p["host"] == "linkedin.com") | p["host"].endswith(".linkedin.com")) & p["path"].rlike(_BARE_ITEM)


def normal_slug(text: Column, length: int = SLUG_LENGTH) -> Column:
    """Lower-cased, runs of other characters than a-z and 0-9 to one dash, trimmed, cut."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, length), "-+$", "")


def slug(category: Column, url: Column, title: Column) -> Column:
    """The slug by the category's policy, or null if it gives none (no usable URL, a title that many pages share)."""
    video = F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|shorts/)|youtu\.be/)([a-zA-Z0-9_-]{11})", 1)
    p = parts(canonical_url(url))
    by_url = _first(F.when(video != "", F.concat(F.lit("video-"), video)), F.when(p["host"] != "", normal_slug(F.replace(F.concat(p["host"], F.regexp_replace(p["path"], "/+$", "")), F.lit("/"), F.lit("-")))))
    named = normal_slug(title)
    by_title = F.when((named != "") & ~named.isin(*BAIT_SLUGS), named)
    policy = F.coalesce(F.element_at(F.create_map(*(x for kv in SLUG_POLICY.items() for x in map(F.lit, kv))), category), F.lit("url"))
    return F.when(policy == "url", by_url).when(policy == "title", by_title).otherwise(F.coalesce(by_url, by_title))


def slug_problem(category: Column, url: Column, title: Column) -> Column:
    """Why there is no slug, or null."""
    return F.when(slug(category, url, title).isNull(), F.concat(F.lit("no usable URL or title for "), F.coalesce(category, F.lit("unknown"))))


def sanitised(url: Column) -> Column:
    """The URL out of a markdown link, quotes and trailing punctuation."""
    inner = F.when(url.rlike(r"^\[[^\]]*\]\([^)]+\)"), F.regexp_extract(url, r"^\[[^\]]*\]\(([^)]+)\)", 1)).otherwise(url)
    return F.regexp_replace(F.regexp_replace(F.trim(inner), r"""^["'<]+|["'>]+$""", ""), r"[.,;:!]+$", "")


# How texts name papers, identifiers, repositories, statuses, posts and PDF files.
REFERENCES = {
    "paper_url": r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})(?:v\d+)?",
    "paper_label": r"(?i)\barXiv\s*:\s*(\d{4}\.\d{4,5})\b",
    "paper_spaced": r"(?i)(ar\s*X\s*iv[^a-z0-9\n]{0,10}(?:\d\s*){4,5}\s*\.\s*(?:\d\s*){4,5})",
    "doi": r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)",
    "repository": r"""(?i)https?://github\.com/([a-z0-9](?:[a-z0-9-]{0,38}[a-z0-9])?/[a-z0-9_.-]+)(?=$|[\s/?#")<>…](?!blob|tree|pull|issues|wiki|releases))""",
    "status": r"(?i)https?://(?:www\.)?(?:x|twitter)\.com/([A-Za-z0-9_]{1,15}/status/\d+)",
    "letter": r"(?i)(https?://[a-z0-9-]+\.substack\.com/p/[a-z0-9-]+)",
    "post": r"(?i)(https?://(?:[a-z0-9-]+\.)?medium\.com/(?:@[a-z0-9-]+/)?[a-z0-9-]+(?:-[a-f0-9]+)?)",
    "pdf": r"""(?i)(https?://(?!(?:arxiv\.org|pbs\.twimg\.com|media\.licdn\.com))[^\s"')\]<>]+?\.pdf(?:[?#][^\s"')\]<>…]*)?)""",
}


def references(text: Column) -> Column:
    """Canonical URLs of what a text names: by family in the order of REFERENCES, then place; distinct."""
    text = F.coalesce(text, F.lit(""))
    found = {k: F.regexp_extract_all(text, F.lit(p), 1) for k, p in REFERENCES.items()}
    under = lambda ids, head: F.transform(ids, lambda i: F.concat(F.lit(head), i))
    papers = "https://arxiv.org/abs/"
    spaced = F.transform(found["paper_spaced"], lambda m: F.regexp_extract(F.regexp_replace(m, r"\s+", ""), r"([0-9]{4,5}\.[0-9]{4,5})", 1))
    spaced = F.filter(spaced, lambda i: i.rlike(r"^[0-9]{4}\.[0-9]{4,5}$"))
    alias = r"(?i)^10\.48550/arXiv\.([0-9]{4}\.[0-9]{4,5})"
    doi = F.transform(found["doi"], lambda d: F.when(d.rlike(alias), F.concat(F.lit(papers), F.regexp_extract(d, alias, 1))).otherwise(F.concat(F.lit("https://doi.org/"), F.regexp_replace(d, r"[.,;:)]+$", ""))))
    examples = literals(PLACEHOLDERS)
    trimmed = F.transform(found["repository"], lambda r: F.regexp_replace(r, r"[/.]+$", ""))
    real = F.filter(trimmed, lambda r: ~F.array_contains(examples, F.lower(F.substring_index(r, "/", 1))) & ~F.array_contains(examples, F.lower(F.substring_index(r, "/", -1))))
    status = F.filter(found["status"], lambda s: F.lower(F.substring_index(s, "/", 1)) != "i")

    def served(u: Column) -> Column:
        u = F.regexp_replace(F.regexp_replace(u, "[….]+$", ""), r"(?i)^(https?://huggingface\.co/[^/]+/[^/]+)/blob/(.+)$", "$1/resolve/$2")
        return F.regexp_replace(u, r"(?i)^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")

    files = F.transform(found["pdf"], lambda u: served(u))
    return F.array_distinct(F.concat(under(found["paper_url"], papers), under(found["paper_label"], papers), under(spaced, papers), doi, under(real, "https://github.com/"), under(status, "https://x.com/"), found["letter"], found["post"], files))


def route(url: Column, hint: Column | None = None) -> Column:
    """Source type of a URL: paper, repo, video, image, social or webpage. A hint replaces webpage only."""
    p = parts(canonical_url(url))
    kind, path = source_kind(p["host"]), p["path"]
    own = (
        F.when((kind == "arxiv") | path.rlike(r"(?i)\.pdf$") | (kind == "doi"), "paper")
        .when((kind == "github") & path.rlike("^/[^/]+/[^/]+"), "repo")
        .when((kind == "youtube") & (path.rlike("^/(watch|shorts/)") | (p["host"] == "youtu.be")), "video")
        .when(path.rlike(r"(?i)\.(png|jpe?g|gif|webp|svg)$"), "image")
        .otherwise("webpage")
    )
    return own if hint is None else F.when((own == "webpage") & hint.isNotNull() & (hint != ""), hint).otherwise(own)


def is_social(url: Column) -> Column:
    """A social host or a subdomain of one; other hosts that merely end alike are not."""
    host = parts(url)["host"]
    out = F.lit(False)
    for name in ("x.com", "twitter.com", "linkedin.com", "reddit.com", "threads.net", "bsky.app"):
        out = out | (host == name) | host.endswith(f".{name}")
    return out


def url_from_slug(slug: Column) -> Column:
    """A URL rebuilt from a slug of known shapes, or null."""
    return (
        F.when(slug.rlike("^x-com-.+-status-[0-9]+$"), F.concat(F.lit("https://x.com/"), F.regexp_extract(slug, "^x-com-(.+)-status-", 1), F.lit("/status/"), F.regexp_extract(slug, "-status-([0-9]+)$", 1)))
        .when(slug.rlike("^video-[A-Za-z0-9_-]{11}$"), F.concat(F.lit("https://youtube.com/watch?v="), F.substr(slug, F.lit(7))))
        .when(slug.rlike("^github-com-[^-]+--.+$"), F.concat(F.lit("https://github.com/"), F.regexp_extract(slug, "^github-com-(.+?)--", 1), F.lit("/"), F.regexp_extract(slug, "--(.+)$", 1)))
        .when(slug.rlike("^arxiv-org-abs-[0-9]{4}-[0-9]{4,5}$"), F.concat(F.lit("https://arxiv.org/abs/"), F.regexp_extract(slug, "abs-([0-9]{4})-", 1), F.lit("."), F.regexp_extract(slug, "-([0-9]{4,5})$", 1)))
    )


def humanised(slug: Column) -> Column:
    """Words of a slug, each with a capital; capitals inside words stay."""
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def disambiguated(title: Column, slug: Column) -> Column:
    """The title with the last three segments of the slug, at most 40 characters, in brackets."""
    return F.concat(title, F.lit(" ("), F.substring(F.array_join(F.slice(F.split(slug, "-"), -3, 3), "-"), 1, 40), F.lit(")"))


def domain(url: Column) -> Column:
    return parts(url)["host"]


def registrable(host: Column) -> Column:
    """The last two labels."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")


def package_mentions(text: Column) -> Column:
    """Packages after npx, npm install and pip install."""
    return F.array_distinct(F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(r"\bnpx\s+(?:-y\s+)?(@?[a-z0-9][\w./-]*)"), 1), lambda x: F.concat(F.lit("npm:"), x)),
        F.transform(F.regexp_extract_all(text, F.lit(r"\bnpm\s+(?:install|i)\s+(?:-[gD]\s+)?(@?[a-z0-9][\w./-]*)"), 1), lambda x: F.concat(F.lit("npm:"), x)),
        F.transform(F.regexp_extract_all(text, F.lit(r"\bpip3?\s+install\s+(?:-U\s+)?([A-Za-z][\w.-]*)"), 1), lambda x: F.concat(F.lit("pypi:"), x)),
    ))
