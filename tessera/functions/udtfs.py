"""Table functions for SQL: sections and table cells of a text by a lateral join, runs of rows by a partitioned table argument.

    register(spark)
    SELECT page_id, c.* FROM pages, LATERAL sections_of(body) c
    SELECT page_id, c.* FROM pages, LATERAL cells_of(body, 0) c
    SELECT * FROM runs_of(TABLE(SELECT path AS key, n, short AS held FROM lines) PARTITION BY key ORDER BY n)

They give what text.chunks, text.markdown_table and a gaps-and-islands window give. A runs_of task keeps two numbers for
each partition, whatever its length.
"""
from __future__ import annotations

import re
from itertools import zip_longest

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import ship

_BLANK = " \t\n\x0b\f\r"
_HEADING = re.compile(r"^(#{2,3})[ \t]+([^\s].*)$", re.MULTILINE)
_TABLE = re.compile(r"(?:\n[ \t]*\|[^\n]*){3,}")
_NAMED_LINK, _LINK = re.compile(r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]"), re.compile(r"\[([^\]]+)\]\([^)]*\)")
_BOLD_ROW = re.compile(r"^\s*\|\s*\*\*[^|]*\*\*\s*\|\s*(\|\s*)*$")


@udtf(returnType="position int, heading string, level int, text string")
class SectionsOf:
    """Sections at second and third level headings; the text before the first one has no heading, and is left out if it is empty and there is another."""

    def eval(self, body: str):
        body, found = body or "", list(_HEADING.finditer(body or ""))
        first = body[: found[0].start() if found else len(body)].strip(_BLANK)
        rows = [(None, None, first)] if first or not found else []
        for here, after in zip_longest(found, found[1:]):
            rows.append((here.group(2).strip(_BLANK), len(here.group(1)), body[here.end() : after.start() if after else len(body)].strip(_BLANK)))
        for k, row in enumerate(rows):
            yield (k, *row)


def _cells(line: str) -> list[str]:
    inner = re.sub(r"^\||\|$", "", _NAMED_LINK.sub(r"\1", line).strip(" "))
    return [re.sub("[*`]", "", _LINK.sub(r"\1", c)).strip(" ") for c in inner.split("|")]


@udtf(returnType="row int, header string, cell string")
class CellsOf:
    """Cells of the n-th table (of three lines or more), with their header; rows that are one bold cell are left out."""

    def eval(self, body: str, index: int):
        tables = _TABLE.findall(f"\n{body or ''}\n")
        if index >= len(tables):
            return
        lines = [x for x in tables[index].split("\n") if x.strip(" ")]
        head = _cells(lines[0])
        for k, line in enumerate(x for x in lines[2:] if not _BOLD_ROW.match(x)):
            cells = _cells(line)
            for i, name in enumerate(head):
                yield k, name, cells[i] if i < len(cells) else None


@udtf(returnType="key string, run long, first long, rows long")
class RunsOf:
    """Of rows (key, n, held) of one key in order: each run of rows that hold, numbered from 1, with its first n and its length."""

    def __init__(self):
        self.key, self.run, self.first, self.rows = None, 0, None, 0

    def eval(self, row: Row):
        self.key = None if row["key"] is None else str(row["key"])
        if row["held"]:
            if not self.rows:
                self.run, self.first = self.run + 1, row["n"]
            self.rows += 1
        else:
            yield from self._done()

    def terminate(self):
        yield from self._done()

    def _done(self):
        if self.rows:
            yield self.key, self.run, self.first, self.rows
            self.rows = 0


def register(spark: SparkSession) -> None:
    ship.send(spark.sparkContext)
    for name, function in (("sections_of", SectionsOf), ("cells_of", CellsOf), ("runs_of", RunsOf)):
        spark.udtf.register(name, function)
