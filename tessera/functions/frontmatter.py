"""Front matter in three flavours, as an Arrow function: values, lists and body of a markdown file.

Flavours differ on purpose, because files were written against each of them:

* index: all quotes around a value go; list items may stand at the margin.
* schema: one pair of quotes goes; a key without value is an empty list.
* lint: all quotes go; list items must be indented; a key without value is an empty string.

There is no built-in function for this, so the parser is Python over Arrow batches. Python gets the block between the marks
alone: where it ends is found, and the body cut, by Spark's own functions, so what a worker holds does not grow with bodies.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import ship

FLAVOURS = ("index", "schema", "lint")
_KEY = re.compile(r"(\w[\w-]*)\s*:\s*(.*)")
_LEGACY = re.compile(r"[-*]\s*\*\*([^*:]+):?\*\*:?\s*(.*)")
#: What Python's strip takes away.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SCHEMA = "values map<string,string>, lists map<string,array<string>>, body string, found boolean"


def _bare(value: str, flavour: str) -> str:
    value = value.strip()
    if flavour == "schema":
        return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return value.strip('"').strip("'")


def parse(text: str | None, flavour: str = "index") -> tuple[dict[str, str], dict[str, list[str]], str, bool]:
    """Values, lists, body and whether there is front matter."""
    values: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    text = text or ""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end < 0:
        return values, lists, text, False
    current = None  # the key whose list may go on
    for line in text[4:end].split("\n"):
        indented, bare = line[:1] in (" ", "\t"), line.strip()
        if current is not None and bare.startswith("-") and (indented or flavour != "lint"):
            lists.setdefault(current, []).append(_bare(bare[1:], flavour))
            values.pop(current, None)
            continue
        m = None if indented else _KEY.match(line)
        if not m:
            if bare:
                current = None
            continue
        key, value = m.group(1), m.group(2).strip()
        current = None
        if not value:
            current = key
            if flavour == "schema":
                lists[key] = []
            else:
                values[key] = ""
        elif value.startswith("[") and value.endswith("]"):
            lists[key] = [_bare(v, flavour) for v in value[1:-1].split(",") if v.strip()]
        else:
            values[key] = _bare(value, flavour)
    return values, lists, text[end + 4 :].strip(), True


def parse_legacy(text: str | None) -> dict[str, str]:
    """A first heading, then bullets with bold labels: title and the labels in snake case."""
    out: dict[str, str] = {}
    for line in (text or "").split("\n"):
        bare = line.strip()
        if bare.startswith("# ") and "title" not in out:
            out["title"] = bare[2:].strip()
        elif "title" in out and (m := _LEGACY.match(bare)):
            out[re.sub(r"\W+", "_", m.group(1).strip().lower())] = m.group(2).strip()
        elif bare and "title" in out:
            break
    return out if len(out) > 1 else {}


def front_matter(content: Column, flavour: str = "index") -> Column:
    """A struct of SCHEMA."""
    if flavour not in FLAVOURS:
        raise ValueError(f"no flavour {flavour!r}")
    ship.send()
    read = parse

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [read(t, flavour) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([
                pa.array([list(r[0].items()) for r in rows], pa.map_(pa.string(), pa.string())),
                pa.array([list(r[1].items()) for r in rows], pa.map_(pa.string(), pa.list_(pa.string()))),
                pa.array([r[2] for r in rows], pa.string()),
                pa.array([r[3] for r in rows], pa.bool_()),
            ], ["values", "lists", "body", "found"])

    end = F.when(content.startswith("---"), F.locate("\n---", content, 4)).otherwise(0)
    body = F.when(end > 0, F.btrim(F.substr(content, end + 4), F.lit(_SPACES))).otherwise(F.coalesce(content, F.lit("")))
    return run(F.when(end > 0, F.substr(content, F.lit(1), end + 3))).withField("body", body)


def legacy_header(content: Column) -> Column:
    """A map of what parse_legacy finds."""
    ship.send()
    read = parse_legacy

    @F.arrow_udf("map<string,string>")
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([list(read(t).items()) for t in batch.to_pylist()], pa.map_(pa.string(), pa.string()))

    return run(content)


# Shapes of wiki pages, what each needs, and the values of source_type.
REQUIRED = {
    "standard": ("title", "date_added", "last_updated", "source_type", "raw_path", "summary"),
    "merged": ("title", "date_added", "last_updated", "source_type", "raw_paths", "urls", "summary"),
    "synthesis": ("title", "date_added", "last_updated", "source_type", "summary"),
    "redirect": ("title", "redirect_to"),
    "raw": ("title", "source", "captured_at"),
}
SYNTHESIS_TYPES = ("entity", "topic", "insight", "comparison", "journal")


def _has(values: Column, lists: Column, key: str) -> Column:
    return (F.coalesce(F.element_at(values, F.lit(key)), F.lit("")) != "") | F.map_contains_key(lists, F.lit(key))


def shape(values: Column, lists: Column) -> Column:
    """standard, merged, synthesis, redirect or AMBIGUOUS, by which fields there are."""
    has = lambda k: _has(values, lists, k)
    redirect = (F.lower(F.coalesce(F.element_at(values, F.lit("redirect")), F.lit(""))) == "true") | has("redirect_to")
    content = has("raw_path") | has("raw_paths") | has("summary")
    both = (has("raw_path") & F.map_contains_key(lists, F.lit("raw_paths"))) | (has("url") & F.map_contains_key(lists, F.lit("urls")))
    return (
        F.when((redirect & content) | both, "AMBIGUOUS").when(redirect, "redirect")
        .when(F.map_contains_key(lists, F.lit("raw_paths")) | F.map_contains_key(lists, F.lit("urls")), "merged")
        .when(F.element_at(values, F.lit("source_type")).isin(*SYNTHESIS_TYPES), "synthesis").otherwise("standard")
    )


def missing_fields(values: Column, lists: Column, kind: str) -> Column:
    """Required fields of a shape that are absent or empty."""
    return F.filter(F.array(*(F.when(~_has(values, lists, k), F.lit(k)) for k in REQUIRED[kind])), lambda x: x.isNotNull())


def violations(values: Column, lists: Column) -> Column:
    """Messages of a page against the rules of its own shape."""
    own = shape(values, lists)
    by_shape = F.when(own == "AMBIGUOUS", F.array(F.lit("fields of two shapes")))
    for kind in ("standard", "merged", "synthesis", "redirect"):
        found = F.transform(missing_fields(values, lists, kind), lambda k: F.concat(k, F.lit(": field required")))
        if kind == "standard":
            path = F.coalesce(F.element_at(values, F.lit("raw_path")), F.lit(""))
            found = F.concat(found, F.when((path != "") & ~path.rlike(r"^raw/[^/]+/artifacts/[^/]+\.md$"), F.array(F.lit("raw_path: not raw/<category>/artifacts/<slug>.md"))).otherwise(F.array().cast("array<string>")))
        if kind == "merged":
            n, m = (F.coalesce(F.size(F.element_at(lists, F.lit(k))), F.lit(0)) for k in ("raw_paths", "urls"))
            found = F.concat(found, F.when((n < 2) | (m < 2) | (n != m), F.array(F.lit("raw_paths and urls: two or more each, equally many"))).otherwise(F.array().cast("array<string>")))
        by_shape = by_shape.when(own == kind, found)
    return by_shape


def source_url(values: Column) -> Column:
    """Of a raw file: source, or url."""
    some = lambda k: F.nullif(F.element_at(values, F.lit(k)), F.lit(""))
    return F.coalesce(some("source"), some("url"))
