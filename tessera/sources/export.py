"""Sinks and renderers: tables to CSV and JSON, charts and documents as text columns made inside Spark."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RADIUS, BAR_ROWS, LABEL, GRAPH_NODES, SLIDE_LINES = 520, 15, 30, 20, 12
# Signs of a feature matrix.
MARKS = {"strong": "🟢", "adequate": "🟡", "weak": "🟠", "absent": "🔴", "yes": "🟢", "no": "🔴", "partial": "🟡"}


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def _ordered(df: DataFrame, order: list, text: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", text.alias("_t")))), lambda x: x["_t"]), separator)


def _placed(df: DataFrame, order: list, most: int | None = None) -> DataFrame:
    """The first rows by an order, with their place; a limit bounds what one task sees."""
    cut = df.orderBy(*order).limit(most) if most else df
    return cut.withColumn("_place", F.row_number().over(Window.orderBy(*order)))


def bar_chart(df: DataFrame, label: str, value: str, title: str = "") -> DataFrame:
    """One row with a Mermaid bar chart of the 15 largest values."""
    own = _placed(df, [F.desc(value), label], BAR_ROWS)
    quoted = F.concat(F.lit('"'), F.replace(shortened(F.col(label).cast("string"), LABEL), F.lit('"'), F.lit('\\"')), F.lit('"'))
    out = own.agg(_ordered(own, [], quoted, ", ").alias("l"), _ordered(own, [], F.col(value).cast("string"), ", ").alias("v"), (F.floor(F.max(value) * 1.1) + 1).alias("top"))
    head = f'    title "{title}"\n' if title else ""
    chart = F.concat(F.lit(f"```mermaid\nxychart-beta\n{head}    x-axis ["), "l", F.lit(']\n    y-axis "Count" 0 --> '), F.col("top").cast("string"), F.lit("\n    bar ["), "v", F.lit("]\n```"))
    return out.select(F.when(F.col("top").isNull(), "*(No data for bar chart)*").otherwise(chart).alias("chart"))


def pie_chart(df: DataFrame, label: str, value: str, title: str = "") -> DataFrame:
    own = _placed(df, [F.desc(value), label], BAR_ROWS)
    line = F.concat(F.lit('    "'), F.col(label).cast("string"), F.lit('" : '), F.col(value).cast("string"))
    out = own.agg(_ordered(own, [], line, "\n").alias("l"), F.count(F.lit(1)).alias("n"))
    first = f'pie title "{title}"' if title else "pie"
    return out.select(F.when(F.col("n") == 0, "*(No data for pie chart)*").otherwise(F.concat(F.lit(f"```mermaid\n{first}\n"), "l", F.lit("\n```"))).alias("chart"))


def feature_matrix(df: DataFrame, feature: str, columns: list[str]) -> DataFrame:
    """A markdown table with signs for known words, rows by feature."""
    signs = F.create_map(*(x for kv in MARKS.items() for x in map(F.lit, kv)))
    cells = [F.coalesce(F.element_at(signs, F.lower(F.trim(c))), F.col(c).cast("string"), F.lit("")) for c in columns]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(feature), *cells), F.lit(" |"))
    own = _placed(df, [feature])
    head = f"| Feature | {' | '.join(columns)} |\n|---|{'---|' * len(columns)}\n"
    return own.agg(F.concat(F.lit(head), _ordered(own, [], row, "\n")).alias("chart"))


def timeline(df: DataFrame, date: str, text: str, title: str = "") -> DataFrame:
    days = df.groupBy(date).agg(F.array_join(F.array_sort(F.collect_list(text)), " : ").alias("_e"))
    own = _placed(days, [date])
    head = f"    title {title}\n" if title else ""
    return own.agg(F.concat(F.lit(f"```mermaid\ntimeline\n{head}"), _ordered(own, [], F.concat(F.lit("    "), F.col(date).cast("string"), F.lit(" : "), F.col("_e")), "\n"), F.lit("\n```")).alias("chart"))


def gantt(df: DataFrame, name: str, start: str, end: str, title: str = "") -> DataFrame:
    own = _placed(df, [start, name])
    line = F.concat(F.lit("    "), F.col(name), F.lit(" : "), F.col(start).cast("string"), F.lit(", "), F.col(end).cast("string"))
    return own.agg(F.concat(F.lit(f"```mermaid\ngantt\n    title {title}\n    dateFormat YYYY-MM-DD\n"), _ordered(own, [], line, "\n"), F.lit("\n```")).alias("chart"))


def relationship_graph(nodes: DataFrame, edges: DataFrame, most: int = GRAPH_NODES) -> DataFrame:
    """nodes: id, label, weight; edges: source, target. The heaviest nodes and the edges between them."""
    kept = _placed(nodes, [F.desc("weight"), "id"], most).withColumn("_n", F.concat(F.lit("n"), F.col("_place").cast("string")))
    a, b = kept.select(F.col("id").alias("source"), F.col("_n").alias("_a")), kept.select(F.col("id").alias("target"), F.col("_n").alias("_b"))
    inner = edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target")
    lines = kept.select(F.lit(0).alias("k"), F.col("_place").alias("p"), F.concat(F.lit("    "), "_n", F.lit('["'), F.replace("label", F.lit('"'), F.lit("'")), F.lit('"]')).alias("t")).unionByName(inner.select(F.lit(1).alias("k"), F.lit(0).alias("p"), F.concat(F.lit("    "), "_a", F.lit(" --> "), "_b").alias("t")))
    return lines.agg(F.concat(F.lit("```mermaid\ngraph LR\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p", "t"))), lambda x: x["t"]), "\n"), F.lit("\n```")).alias("chart"))


def slides(sections: DataFrame, most: int = SLIDE_LINES) -> DataFrame:
    """sections: page_id, position, heading, text. One slide a section: table rows dropped, bullets added, so many lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("|"))
    body = F.array_join(F.transform(F.slice(lines, 1, most), lambda x: F.when(x.rlike(r"^\s*(?:[-*#>]|\d+\.)"), x).otherwise(F.concat(F.lit("- "), x))), "\n")
    one = sections.withColumn("_s", F.concat(F.lit("## "), F.coalesce("heading", F.lit("Overview")), F.lit("\n\n"), body))
    return one.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_s"))), lambda x: x["_s"]), "\n\n---\n\n").alias("slides"))


def stats_page(stats: DataFrame, key: str, value: str) -> DataFrame:
    """A table of figures, and their bar and pie."""
    rows = _placed(stats, [key])
    table = rows.agg(F.concat(F.lit("| Metric | Value |\n|---|---|\n"), _ordered(rows, [], F.concat(F.lit("| "), F.col(key), F.lit(" | "), F.col(value).cast("string"), F.lit(" |")), "\n")).alias("t"))
    bar, pie = bar_chart(stats, key, value).withColumnRenamed("chart", "b"), pie_chart(stats, key, value).withColumnRenamed("chart", "p")
    return table.crossJoin(F.broadcast(bar)).crossJoin(F.broadcast(pie)).select(F.concat_ws("\n\n", "t", "b", "p").alias("page"))


def canvas(neighbours: DataFrame, center: str, path: str = "path") -> DataFrame:
    """One row of canvas JSON: a center and its neighbours on a ring, by path; coordinates are rounded half to even."""
    own = _placed(neighbours, [path]).crossJoin(F.broadcast(neighbours.agg(F.count(F.lit(1)).alias("_n"))))
    angle = 2 * F.lit(3.141592653589793) * (F.col("_place") - 1) / F.col("_n")
    deg = F.degrees(angle)
    sides = F.when((deg < 45) | (deg >= 315), F.array(F.lit("right"), F.lit("left"))).when(deg < 135, F.array(F.lit("bottom"), F.lit("top"))).when(deg < 225, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("top"), F.lit("bottom")))
    name = (F.col("_place") - 1).cast("string")
    node = F.struct(F.concat(F.lit("n"), name).alias("id"), F.lit("file").alias("type"), F.col(path).alias("file"), F.bround(F.cos(angle) * RADIUS).cast("int").alias("x"), F.bround(F.sin(angle) * RADIUS).cast("int").alias("y"))
    edge = F.struct(F.concat(F.lit("e"), name).alias("id"), F.lit("center").alias("fromNode"), F.concat(F.lit("n"), name).alias("toNode"), sides[0].alias("fromSide"), sides[1].alias("toSide"))
    parts = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", node.alias("v")))), lambda x: x["v"]).alias("ns"), F.transform(F.array_sort(F.collect_list(F.struct("_place", edge.alias("v")))), lambda x: x["v"]).alias("es"))
    first = F.array(F.struct(F.lit("center").alias("id"), F.lit("file").alias("type"), F.lit(center).alias("file"), F.lit(0).alias("x"), F.lit(0).alias("y")))
    return parts.select(F.to_json(F.struct(F.concat(first, "ns").alias("nodes"), F.col("es").alias("edges"))).alias("canvas"))


def tracker(ledger: DataFrame, pages: DataFrame) -> DataFrame:
    """Ledger rows with a bucket (attention, pending, history) and the page of their canonical URL, newest first."""
    from ..functions import urls as U

    bucket = F.when(F.col("status").isin("thin", "failed", "uncapturable"), "attention").when(F.col("status") == "pending", "pending").otherwise("history")
    keyed = ledger.withColumns({"bucket": bucket, "_u": U.canonical_url("url", U.LEDGER_TRACKING)})
    named = pages.where("url != ''").groupBy(U.canonical_url("url", U.LEDGER_TRACKING).alias("_u")).agg(F.min("title").alias("page"))
    return keyed.join(named, "_u", "left").drop("_u").orderBy("bucket", F.col("ts").desc_nulls_last(), "url")


def page_index(pages: DataFrame) -> DataFrame:
    """day and titles, by the later of both dates, newest first, undated last."""
    day = F.nullif(F.greatest(F.nullif("date_added", F.lit("")), F.nullif("last_updated", F.lit(""))), F.lit(""))
    return pages.withColumn("day", F.substring(day, 1, 10)).groupBy("day").agg(F.array_sort(F.collect_list("title")).alias("titles"), F.count(F.lit(1)).alias("n")).orderBy(F.col("day").desc_nulls_last())


def collections(pages: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """collection, n of the collections that have pages."""
    own = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return pages.select(F.explode(own).alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("n")).where("n > 0").orderBy("collection")


def collection_view(name: str, dated: bool) -> str:
    """A view definition in YAML."""
    sort = "\n    sort:\n      - property: date_added\n        direction: DESC" if dated else ""
    return f"views:\n  - type: table\n    name: {name}\n    filters: collection == \"{name}\"{sort}\n"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def markdown_page(title: Column, fields: dict[str, Column], body: Column) -> Column:
    """A page with front matter."""
    from ..functions import text as T

    lines = [F.concat(F.lit(f"{k}: \""), T.escape_yaml(F.coalesce(v.cast("string"), F.lit(""))), F.lit('"')) for k, v in {"title": title, **fields}.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def accepted(raws: DataFrame) -> DataFrame:
    """raws (category, source, title, body, existing_size) with url, slug and a reason if the writer refuses it: null ones may be written."""
    from ..functions import urls as U

    own = U.canonical(F.col("source"))
    head = F.lower(F.substring("body", 1, 3000))
    reason = (
        F.when(F.coalesce("title", F.lit("")) == "", "no title").when(own["identity_lost"], "identity lost").when(U.slug(F.col("category"), F.col("source"), F.col("title")).isNull(), "no slug")
        .when(head.rlike("just a moment|checking your browser|enable javascript|access denied"), "interstitial")
        .when((F.length("body") < 1024) & (F.coalesce("existing_size", F.lit(0)) > 2 * F.length("body")), "thinner than what is there")
    )
    return raws.withColumns({"url": own["url"], "slug": U.slug(F.col("category"), F.col("source"), F.col("title")), "reason": reason})


def distinct_slugs(raws: DataFrame, most: int = 99) -> DataFrame:
    """Slugs of different URLs get -2 to -99 in the order of first sight; more are refused (null)."""
    first = raws.groupBy("slug", "url").agg(F.min("place").alias("_first"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("_first", "url"))
    named = first.withColumn("_n", n).select("slug", "url", F.when(F.col("_n") == 1, F.col("slug")).when(F.col("_n") <= most, F.concat("slug", F.lit("-"), F.col("_n").cast("string"))).alias("file_slug"))
    return raws.join(named, ["slug", "url"], "left")
