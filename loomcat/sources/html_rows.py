"""Rows and cells of HTML pages, and the contract that scraped tables must keep.

Pages are read in tasks, in Arrow batches, by a tokenizer and a stack of open rows and cells. Tags may
be nested (a table within a cell has rows of its own), unclosed (a cell ends where the next cell of
its row begins, a row where the next row of its table begins), and have attributes in any order and
quoting. Comments, scripts and styles are no text; character references are what they stand for; white
space is folded. Text and links belong to the innermost open cell; a cell's link is its first.

Null and empty pages have no rows; text outside of cells is left out; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
#: Elements whose content is no markup, and elements whose end closes what is open within.
RAW, OUTER = ("script", "style", "textarea", "title"), ("table", "tbody", "thead", "tfoot", "nav", "article", "body", "html")


def attributes(text: str) -> dict[str, str]:
    """Names in lower case; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(open, tag, attributes), (close, tag, "") and (text, "", text) in order."""
    at = 0
    while at < len(html):
        m = TOKEN.search(html, at)
        if (stop := m.start() if m else len(html)) > at:
            yield "text", "", unescape(html[at:stop])
        if not m:
            return
        at = m.end()
        if tag := (m[2] or "").lower():
            if m[1]:
                yield "close", tag, ""
            else:
                yield "open", tag, m[3] or ""
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if tag in ("textarea", "title"):
                        yield "text", "", unescape(html[at : end.start() if end else len(html)])
                    at = end.start() if end else len(html)


def cells(html: str | None, rows: Sequence[str] = ("tr",), columns: Sequence[str] = ("td", "th"), tables: Sequence[str] = ("table",)) -> list[tuple[int, int, str, str | None]]:
    """(row, column, text, link) of each cell, rows numbered from 0 in the order in which they begin."""
    out: list[list] = []
    count = 0
    stack: list[tuple[str, list | None]] = []  # open tables, rows (number, cells so far) and cells

    def shut(kinds: tuple[str, ...], until: tuple[str, ...]) -> None:
        """Close the innermost open one of kinds and what is open within, unless one of until is nearer."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in until:
                return
            if stack[k][0] in kinds:
                del stack[k:]
                return

    for what, tag, value in events(html or ""):
        if what == "text" or tag == "a":
            cell = next((x for kind, x in reversed(stack) if kind != "row"), None) if stack and stack[-1][0] == "cell" else None
            if cell is not None and what == "text":
                cell[2].append(value)
            elif cell is not None and what == "open" and cell[3] is None:
                cell[3] = attributes(value).get("href")
        elif tag in rows:
            shut(("row",), ("table",)) if what == "close" or tag not in tables else None
            if what == "open":
                stack.append(("row", [count, 0]))
                count += 1
        elif tag in columns:
            shut(("cell",), ("row", "table"))
            if what == "open" and stack and stack[-1][0] == "row":
                row = stack[-1][1]
                out.append([row[0], row[1], [], None])
                row[1] += 1
                stack.append(("cell", out[-1]))
        elif tag in tables:
            if what == "open":
                stack.append(("table", None))
            else:
                shut(("table",), ())
        elif what == "close" and tag in OUTER:
            shut(("row",), ("table",))
    return [(r, k, " ".join("".join(text).split()), link) for r, k, text, link in out]


def page_cells(pages: DataFrame, key: str = "page_id", html: str = "html", rows: Sequence[str] = ("tr",), columns: Sequence[str] = ("td", "th"), tables: Sequence[str] = ("table",)) -> DataFrame:
    """key, row, column, text, link of every cell of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k, page in zip(pdf[key], pdf[html], strict=True):  # a frame a page: one may have very many cells
                yield pd.DataFrame([(k, *x) for x in cells(page, rows, columns, tables)], columns=[key, "row", "column", "text", "link"])

    return pages.select(key, html).mapInPandas(run, f"`{key}` {dict(pages.dtypes)[key]}, row long, column long, text string, link string")


def records(found: DataFrame, header: Sequence[str], key: str = "page_id", linked: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells as rows of a table with exactly this header, and what is wrong: (key, row, reason). The
    first row of a page that has the header's first name says which; a page without it, or with other
    names or another order, is rejected as a whole (row is null), a row with another number of cells,
    or without a link in the column `linked`, by itself. Rows before the header are left out."""
    row = found.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("column", F.coalesce("text", F.lit("")).alias("text"), "link"))).alias("cells"))
    row = row.select(key, "row", F.col("cells.text").alias("texts"), F.col("cells.link").alias("links"))
    heads = row.where(F.array_contains("texts", header[0])).groupBy(key).agg(F.min_by("texts", "row").alias("_head"), F.min("row").alias("_at"))
    marked = row.join(heads, key, "left")
    right = F.col("_head") == F.array(*map(F.lit, header))
    page = marked.groupBy(key).agg(F.first("_head").alias("_head"))
    wrong = page.where(F.col("_head").isNull() | ~right).select(key, F.lit(None).cast("long").alias("row"), F.when(F.col("_head").isNull(), "no header").otherwise("other header").alias("reason"))
    body = marked.where(right & (F.col("row") > F.col("_at")))
    fault = F.when(F.size("texts") != len(header), "number of cells")
    if linked is not None:
        fault = fault.when(F.get("links", F.lit(list(header).index(linked))).isNull(), "no link")
    judged = body.withColumn("reason", fault)
    good = judged.where("reason IS NULL").select(key, "row", *(F.col("texts")[i].alias(x) for i, x in enumerate(header)), *([F.col("links")[list(header).index(linked)].alias("link")] if linked is not None else []))
    return good, wrong.unionByName(judged.where("reason IS NOT NULL").select(key, "row", "reason"))
