"""Pure functions over columns: expected values and properties."""
import pytest
from pyspark.sql import functions as F

from tessera.functions import clips as C, frontmatter as FM, stemming, text as T, urls as U


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


CANONICAL = [
    ("https://www.linkedin.com/posts/ann_some-words-7455470610769485824-tF2k/?utm_source=s&rcm=A", "https://linkedin.com/posts/ann_some-words-7455470610769485824-tF2k", "linkedin"),
    ("https://www.linkedin.com/posts/ann_title-ugcPost-77-ab1c?x=1", "https://linkedin.com/posts/ugcpost-77", "linkedin"),
    ("https://www.linkedin.com/feed/update/urn:li:activity:55/", "https://linkedin.com/posts/ugcpost-55", "linkedin"),
    ("https://www.linkedin.com/feed/?highlightedUpdateUrn=urn%3Ali%3Ashare%3A123", "https://linkedin.com/posts/ugcpost-123", "linkedin"),
    ("https://x.com/ann_/status/20?s=12&t=Sq", "https://x.com/ann_/status/20", "x"),
    ("https://arxiv.org/pdf/2405.21060v3.pdf", "https://arxiv.org/abs/2405.21060", "arxiv"),
    ("https://doi.org/10.48550/arXiv.2602.09433", "https://arxiv.org/abs/2602.09433", "arxiv"),
    ("https://huggingface.co/o/r/blob/main/a.pdf", "https://huggingface.co/o/r/resolve/main/a.pdf", "huggingface"),
    ("https://github.com/o/r/blob/main/a/b.md", "https://raw.githubusercontent.com/o/r/main/a/b.md", "github"),
    ("https://www.youtube.com/watch?v=abc123&utm_source=share", "https://youtube.com/watch?v=abc123", "youtube"),
    ("HTTP://WWW.Example.com/a/?b=&utm_term=x&c=2#top", "http://example.com/a?c=2", "other"),
    ("no url", "no url", "other"),
    ("https://e.com/", "https://e.com/", "other"),
]


@pytest.mark.parametrize("url, want, kind", CANONICAL)
def test_canonical(spark, url, want, kind):
    r = spark.createDataFrame([(url,)], "v string").select(*(c.alias(k) for k, c in U.canonical(F.col("v")).items())).first()
    assert (r["url"], r["kind"]) == (want, kind) and one(spark, want, U.canonical_url) == want


@pytest.mark.parametrize("url, lost", [("https://a.com/#/item/3", True), ("https://a.com/doc#intro", False), ("https://a.com/?utm_source=x", False), ("https://linkedin.com/feed/?id=7", True), ("https://youtube.com/watch?v=x", False), ("https://a.com/p#!x", True)])
def test_identity_lost(spark, url, lost):
    assert one(spark, url, lambda c: U.canonical(c)["identity_lost"]) is lost


@pytest.mark.parametrize("category, url, title, want", [
    ("repos", "https://github.com/o/tool", None, "github-com-o-tool"), ("webpages", "https://x.com/ann_/status/20?s=1", "Tweet", "x-com-ann-status-20"), ("books", None, "Theory of Sets", "theory-of-sets"), ("books", "https://a.com/b", "Untitled", None),
    ("webpages", None, "A title", None), ("papers", None, "A title", "a-title"), ("videos", "https://youtu.be/abcdefghijk?t=3", None, "video-abcdefghijk"), ("webpages", "https://a.com/" + "long-" * 40, None, ("a-com-" + "long-" * 40)[:80].rstrip("-")), ("other", "ftp", "x", None),
])
def test_slugs(spark, category, url, title, want):
    df = spark.createDataFrame([(category, url, title)], "c string, u string, t string").select(U.slug(F.col("c"), F.col("u"), F.col("t")).alias("s"), U.slug_problem(F.col("c"), F.col("u"), F.col("t")).alias("p"))
    assert df.first()["s"] == want and (df.first()["p"] is None) == (want is not None)


def test_references(spark):
    text = "arXiv: 2509.22040, https://github.com/foo/bar https://github.com/realco/tool. https://x.com/i/status/1 https://twitter.com/bob/status/99?s=1 ar X iv :2 50 9. 22 04 1v2 doi 10.1145/3292500.3330701). http://a.org/p.pdf… https://al.substack.com/p/hello"
    assert one(spark, text, U.references) == ["https://arxiv.org/abs/2509.22040", "https://arxiv.org/abs/2509.22041", "https://doi.org/10.1145/3292500.3330701", "https://github.com/realco/tool", "https://x.com/bob/status/99", "https://al.substack.com/p/hello", "http://a.org/p.pdf"]
    assert one(spark, None, U.references) == []


def test_small_url_functions(spark):
    assert one(spark, "https://www.linkedin.com/feed/?highlightedUpdateUrn=urn:li:activity:5", U.resolvable) == "https://www.linkedin.com/feed/update/urn:li:activity:5/"
    assert one(spark, "https://linkedin.com/posts/ugcpost-5", U.unservable) and not one(spark, "https://box.com/x", U.is_social) and one(spark, "https://m.x.com/x", U.is_social)
    assert one(spark, "[a](https://b.c/d).", U.sanitised) == "https://b.c/d" and one(spark, "x-com-ann-status-5", U.url_from_slug) == "https://x.com/ann/status/5"
    assert one(spark, "a-big_iPhone", U.humanised) == "A Big IPhone" and one(spark, "m.a.example.com", U.registrable) == "example.com"
    assert [one(spark, u, U.route) for u in ("https://arxiv.org/abs/2405.21060", "https://github.com/a/b", "https://youtu.be/x", "https://a.com/b.png", "https://a.com")] == ["paper", "repo", "video", "image", "webpage"]
    assert one(spark, "run npx -y tool and pip install pkg", U.package_mentions) == ["npm:tool", "pypi:pkg"]


BODY = "intro\n\n## One\ntext a\n### Two\n\nmore\n## Three\n| A | B |\n|---|---|\n| 1 |  |\n| **S** | |\n| [[x|y]] | `q` |\n"


def test_markdown(spark):
    assert [tuple(c) for c in one(spark, BODY, T.chunks)][:3] == [(None, None, "intro"), ("One", 2, "text a"), ("Two", 3, "more")]
    assert [tuple(c) for c in one(spark, "plain", T.chunks)] == [(None, None, "plain")] and one(spark, "## only", T.chunks)[0]["heading"] == "only"
    assert one(spark, BODY, T.markdown_table) == [{"A": "1", "B": ""}, {"A": "y", "B": "q"}]
    assert one(spark, BODY, lambda c: T.markdown_table(c, keep_empty_cells=False))[0] == {"A": "1", "B": None}
    assert one(spark, "# H\n**b** _i_ [t](u) [[p|q]] ![a](b) `c`\n---\n```x\ny```", T.strip_markdown) == "H\nb i t q a `c`"
    assert one(spark, "[[A|x]] [[B]] [[ A ]]", T.wikilinks) == ["A", "B"]


@pytest.mark.parametrize("text, want", [("1,374", 1374), ("10-20", 20), ("12K", 12000), ("3.5 M", 3.5e6), ("★ 55", 55), ("none", 0), (None, 0)])
def test_numbers(spark, text, want):
    assert one(spark, text, T.parse_number) == want


def test_text_helpers(spark):
    assert one(spark, "WEBVTT\n\n1\n00:01 --> 00:02\n<c>Hi</c>\nHi\nthere\n", T.subtitle_transcript) == "Hi there"
    html = '<iframe a src="//v.org/e#x"></iframe><embed src="/r"><iframe src="https://www.youtube.com/embed/1">'
    assert one(spark, html, lambda c: T.embed_urls(c, ("youtube.com/embed",))) == ["https://v.org/e"]
    assert one(spark, "deep graph models and the graph", T.candidate_phrases) == ["deep", "graph", "models", "deep graph", "graph models", "models graph", "deep graph models", "graph models graph"]
    assert one(spark, "abcabc", lambda c: T.occurrences(c, F.lit("bc"))) == 2 and one(spark, 'a"b\n', T.escape_yaml) == 'a\\"b\\n'
    assert one(spark, "First sentence here. Second one goes on", lambda c: T.smart_truncate(c, 30)) == "First sentence here." and one(spark, "short", lambda c: T.smart_truncate(c, 30)) == "short"
    assert T.query_terms("show the CS229 page!") == ["CS229"] and T.query_terms("the page") == ["the", "page"]
    assert one(spark, [3.0, 4.0], lambda c: T.cosine(c, F.array(F.lit(3.0), F.lit(4.0))), "array<float>") == pytest.approx(1) and one(spark, [0.0], lambda c: T.cosine(c, c), "array<float>") == 0


FILE = "---\ntitle: \"A 'b'\"\ntags: [x, \"y\"]\nrelated:\n- '[[P]]'\n  - Q\nempty:\n---\nbody\n"


@pytest.mark.parametrize("flavour", FM.FLAVOURS)
def test_front_matter_flavours(spark, flavour):
    r = one(spark, FILE, lambda c: FM.front_matter(c, flavour))
    assert r["body"] == "body" and r["found"] and r["lists"]["tags"] == ["x", "y"]
    assert r["lists"].get("related") == (None if flavour == "lint" else ["[[P]]", "Q"])  # an item at the margin ends an indented list
    assert ("empty" in r["lists"]) == (flavour == "schema") and ("empty" in r["values"]) == (flavour != "schema")
    assert FM.parse("plain", flavour) == ({}, {}, "plain", False) and FM.parse(None, flavour)[3] is False


def test_shapes(spark):
    def of(values, lists):
        df = spark.createDataFrame([(values, lists)], "values map<string,string>, lists map<string,array<string>>")
        return df.select(FM.shape(F.col("values"), F.col("lists")).alias("s"), FM.violations(F.col("values"), F.col("lists")).alias("v")).first()

    full = {"title": "t", "date_added": "d", "last_updated": "d", "source_type": "paper", "raw_path": "raw/papers/artifacts/a.md", "summary": "s"}
    assert tuple(of(full, {})) == ("standard", []) and of({**full, "raw_path": "x.md"}, {})["v"]
    assert of({"title": "t", "redirect": "true", "redirect_to": "u"}, {})["s"] == "redirect" and of({**full, "redirect": "true"}, {})["s"] == "AMBIGUOUS"
    assert of({"title": "t", "source_type": "topic"}, {})["s"] == "synthesis" and of({"title": "t"}, {"raw_paths": ["a", "b"], "urls": ["u"]})["v"][-1].startswith("raw_paths")
    assert FM.parse_legacy("# Name\n- **Source:** u\n- **Captured at**: d\n\ntext") == {"title": "Name", "source": "u", "captured_at": "d"}


def test_clips(spark):
    assert one(spark, "Like\nreal text\n\n\n\nComment\nShare\n-", lambda c: C.cleaned(c, F.lit("linkedin"))) == "real text"
    assert one(spark, "![a](1)\n![a](1)\nx\n![a](1)", C.distinct_images) == "![a](1)\nx\n![a](1)"
    assert one(spark, "abcdef ![i](u)", lambda c: C.cut_keeping_images(c, 3)) == "abc\n\n![i](u)"
    assert one(spark, "![x](./img/a.png) ![y](../b.png) ![z](https://h/c.png)", lambda c: C.absolute_links(c, F.lit("o/r"))) == "![x](https://raw.githubusercontent.com/o/r/HEAD/img/a.png) ![y](../b.png) ![z](https://h/c.png)"
    assert one(spark, "Post | LinkedIn", C.is_bait_title) and not one(spark, "A good title", C.is_bait_title)
    assert one(spark, "llm and rag notes", lambda c: C.conventional_title(c, F.lit("github"))) == "GitHub: LLM and RAG notes"
    assert one(spark, "How to build it all | Site", C.without_masthead) == "How to build it all" and one(spark, 'a/b: "c"? ', C.file_name) == "a-b- -c-"
    assert one(spark, "𝐁𝐨𝐥𝐝 é", C.folded_typography) == "Bold e" and one(spark, "é", C.folded_typography) == "é"
    assert one(spark, "# T\n\nshort\n\n" + "word " * 40, C.best_paragraph) == ("word " * 40).strip()
    assert one(spark, 'Here: ```json\n{"summary": "s"}\n```', C.digest)["summary"] == "s"
    assert one(spark, "---\ntitle: t\nsummary: old\n---\nb", lambda c: C.with_summary(c, F.lit("new"))) == '---\ntitle: t\nsummary: "new"\n---\nb'
    assert one(spark, '{"text": "see t.co/1", "urls": [{"url": "t.co/1", "expanded_url": "https://a.b"}], "media": ["m"], "quoted": {"author": "q", "text": "x\\ny"}}', C.post_markdown) == "see https://a.b\n\n![](m)\n\n> q: x\n> y"
    assert one(spark, '<meta property="og:title" content="A &amp; B">', lambda c: C.html_property(c, "og:title")) == "A & B"
    assert one(spark, "x.com/ann/status/1 x.com/Ann/status/2 x.com/ann/status/3 x.com/bob/status/9 x.com/ann/status/4", lambda c: C.is_self_thread(c, F.lit("ann"), F.lit("1")))
    assert one(spark, ["AI", "llm", "odd"], lambda c: C.canonical_tags(c, {"ai": "ml"}, ("ml", "llm")), "array<string>") == ["ml", "llm"]
    assert one(spark, "storage", lambda c: C.keyword_tags(c, {"rag": ("rag",), "x": ("y",)})) == ["rag"]
    assert one(spark, "aa bb cc", lambda c: C.wrapped(c, 5)) == "aa bb\ncc"


def test_stems(spark):
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis formaliti formal triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt homologous homolog effective effect probate probat rate rate cease ceas controll control roll roll".split()
    assert [stemming.stem(w) for w in pairs[::2]] == pairs[1::2]
    assert one(spark, "Running DOGS, über 12", stemming.stemmed) == "run dog über 12"


def test_table_functions_are_the_expressions(spark):
    """Sections and cells of odd bodies by SQL, as the column expressions give them; runs as a plain walk finds them."""
    import random
    from itertools import groupby

    from tessera.functions import udtfs

    draw = random.Random(4)
    line = lambda: draw.choice(["## Head", "### Sub *x*", "#### deep", "##", "text", "", "  ", "| a | b |", "|---|---|", "| 1 | [[P|q]] | c |", "| **Group** |", "|| [x](u) ** |", "# top"])
    bodies = [(i, "\n".join(line() for _ in range(draw.randrange(0, 14)))) for i in range(300)] + [(300, None), (301, "")]
    udtfs.register(spark)
    spark.createDataFrame(bodies, "id long, body string").createOrReplaceTempView("odd_bodies")
    table = spark.table("odd_bodies")
    want = table.select("id", F.posexplode(T.chunks(F.col("body"))).alias("position", "c")).select("id", "position", "c.heading", "c.level", "c.text").collect()
    got = spark.sql("SELECT id, c.* FROM odd_bodies, LATERAL sections_of(body) c").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 500
    for index in (0, 1):
        maps = {(r["id"], r["k"]): dict(r["m"]) for r in table.select("id", F.posexplode(T.markdown_table(F.col("body"), index)).alias("k", "m")).collect()}
        cells = {}
        for r in spark.sql(f"SELECT id, c.* FROM odd_bodies, LATERAL cells_of(body, {index}) c").collect():
            cells.setdefault((r["id"], r["row"]), {})[r["header"]] = r["cell"]
        assert cells == {k: m for k, m in maps.items() if m}
    held = [(k, n, draw.random() < 0.6) for k in range(5) for n in range(30)]
    spark.createDataFrame(held, "k long, n long, held boolean").repartition(3).createOrReplaceTempView("held_rows")
    got = spark.sql("SELECT * FROM runs_of(TABLE(SELECT CAST(k AS STRING) AS key, n, held FROM held_rows) PARTITION BY key ORDER BY n)").collect()
    plain = []
    for k, rows in groupby(held, lambda r: r[0]):
        runs = [list(g) for h, g in groupby(rows, lambda r: r[2]) if h]
        plain += [(str(k), i + 1, g[0][1], len(g)) for i, g in enumerate(runs)]
    assert sorted(map(tuple, got)) == sorted(plain)


def test_phrases_are_counted_in_one_pass():
    from tessera.operators import retrieval

    text = "aa aaa banana bandana ana"
    phrases = ["aa", "ana", "banana", "an", "zz", "a a"]
    assert retrieval.phrase_counts(text, phrases) == [text.count(p) for p in phrases]
    assert retrieval.phrase_counts(None, phrases) == [0] * 6 and retrieval.phrase_counts("x", []) == []


def test_yaml_strings(spark):
    for text in ('a "b" \\ c', "\\n is no line end", "tab\there\r\n", ""):
        escaped = one(spark, text, T.escape_yaml)
        assert "\n" not in escaped and one(spark, escaped, T.unescape_yaml) == text.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
