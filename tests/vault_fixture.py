"""A small vault: eight pages in two clusters of four, raws, a journal, ledgers, with a few deliberate defects."""
from pathlib import Path

CLUSTERS = {"Compiler Design": ["Parser Notes", "Lexer Notes", "Register Allocation"], "Garden Planning": ["Soil Types", "Seed Storage", "Crop Rotation"]}


def page(title, related, body, **fields):
    lines = [f'title: "{title}"', *(f"{k}: {v}" for k, v in fields.items())]
    if related is not None:
        lines.append("related:" + ("" if related else " []"))
        lines += [f'  - "[[{r}]]"' for r in related]
    return "---\n" + "\n".join(lines) + f"\n---\n\n{body}\n"


def build(root: Path) -> None:
    web = root / "wiki/format/webpages"
    raws = root / "raw/webpages/artifacts"
    for d in (web, raws, root / "wiki/topics", root / "wiki/journal", root / "wiki/sessions", root / "wiki/dashboards", root / "projects/one"):
        d.mkdir(parents=True)
    k = 0
    for hub, names in CLUSTERS.items():
        subject = hub.split()[0].lower()
        for n, name in enumerate([hub, *names]):
            k += 1
            ring = [hub, *names]
            related = [ring[(n + 1) % 4], ring[(n + 3) % 4]]
            slug = name.lower().replace(" ", "-")
            body = f"# {name}\n\nAll about {subject} and {name.lower()}. It has {100 * k} stars.\n\n## Detail\n\nSee [[{ring[(n + 2) % 4]}]].\n\n## Keywords\n\n[[nothing here]]"
            (web / f"{name}.md").write_text(page(name, related, body, source_type="webpage", tags=f"[{subject}, webpage]", url=f"https://site.org/{slug}?utm_source=a", date_added=f"2024-01-0{k}", last_updated="2024-02-01", raw_path=f"raw/webpages/artifacts/{slug}.md", summary=f"About {subject}"))
            (raws / f"{slug}.md").write_text(f"---\ntitle: {name}\nsource: https://site.org/{slug}\ncaptured_at: 2024-01-0{k}\n---\n# {name}\n\n" + "Some text of the page. " * 60)
    (web / "Lone &amp; Odd.md").write_text(page("Lone &amp; Odd", [], "see [[Missing Page]] page not found", source_type="blog", tags="[]", url="https://www.site.org/soil-types", date_added="2024-01-09T10:00", last_updated="", raw_path="raw/webpages/artifacts/gone.md", summary="> quoted"))
    (web / "Soil Copy.md").write_text(page("Soil Copy", ["Soil Types"], "copy [[Soil Types]]", source_type="webpage", tags="[garden]", url="https://site.org/soil-types", date_added="2024-01-10", last_updated="2024-01-10", raw_path="raw/webpages/artifacts/soil-types.md", summary="x"))
    (web / "_Contents.md").write_text("index")
    (root / "wiki/dashboards/d.md").write_text("skip")
    (raws / "orphan.md").write_text("---\ntitle: Orphan\nsource: https://else.org/o\n---\n# Orphan\n\nshort")
    (raws / "old.md").write_text("# Old\n- **Source:** https://old.org/x\n- **Captured at:** 2023\n\ntext")
    (root / "wiki/journal/Journal — 2024-01-05.md").write_text("# Day\n\n### 09:30\n\nRead [[Soil Types]] and garden notes. There is a gap.\n\n---\n\n### 18:00\n\nGarden notes again, a gap in CS229 material.\n")
    (root / "wiki/journal/2024-01-02.md").write_text("### 08:00\n\nold entry about garden\n")
    (root / "wiki/sessions/2024-01-05-log.md").write_text("---\na: b\n---\n# S\n\n## Summary\n\nfirst\n\n## Summary\n\nlast\n\n## Open Threads\n\n- t\n")
    (root / "projects/one/index.md").write_text('---\ntitle: "Project One"\nstatus: active\n---\n')
    (root / "rules.md").write_text("# R\n\n## Style <!-- x -->\n\n- be short\n<!-- - hidden -->\n- be clear\n\n## Links\n\n* link back\n")
    (root / "url-resolved.tsv").write_text("captured\tSoil\thttps://site.org/soil-types\t2024-01-05T00:00\nthin\tT\thttps://a.org/x\thttps://a.org/y\twebpage\ncaptured\tSoil\thttps://www.site.org/soil-types?utm_source=z\t2024-03-05T00:00\n")
    (root / "pending.txt").write_text("# later\nhttps://p.org/1\n\nnot one\n")
