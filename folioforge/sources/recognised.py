"""Recognised text: markup pages as an adjacency table of layout nodes."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Node classes of the format.
LINES = ("ocr_line", "ocr_header", "ocr_footer", "ocr_caption", "ocr_textfloat")
RAW = "node int, parent int, path array<int>, kind string, name string, title string, dir string, lang string, text string, status string"


def _own_text(element) -> str:
    """The text of an element: its own, its children's, and what follows its end tag, as one reading
    order would have it; joined by NFKC, without white space at the ends."""
    return unicodedata.normalize("NFKC", "".join(element.itertext()) + (element.tail or "")).strip()


def _rows(markup: str | None) -> list[tuple]:
    """The classed elements of a page in reading order, or one row that says what is wrong. A stack
    takes the place of recursion, so markup may be nested as deep as it likes."""
    fail = lambda why: [(0, None, [0], None, None, None, None, None, None, why)]
    try:
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", markup or ""))
    except ElementTree.ParseError:
        return fail("not well formed")
    rows: list[tuple] = []
    waiting = [(root, None, [], None, None)]
    while waiting:
        element, parent, path, direction, language = waiting.pop()
        kind = element.get("class")
        language = element.get("lang") or element.get("{http://www.w3.org/XML/1998/namespace}lang") or language
        direction = element.get("dir") or direction
        here, where = parent, path
        if kind and kind.startswith("ocr"):
            here = len(rows)
            where = [*path, here]
            own = _own_text(element) if kind == "ocrx_word" else None
            rows.append((here, parent, where, kind, element.get("id"), element.get("title"), direction, language, own, None))
        waiting += [(child, here, where, direction, language) for child in reversed(element)]
    page = next((r for r in rows if r[3] == "ocr_page"), None)
    if page is None:
        return fail("no page")
    if not re.search(r"bbox\s+\d+\s+\d+\s+\d+\s+\d+", page[5] or ""):
        return fail("page without box")
    return rows


def parse_nodes(pages: DataFrame, id_col: str, markup_col: str) -> DataFrame:
    """(id, node, parent, path, kind, name, text, dir, lang, box, baseline, angle, confidence,
    font, page, dpi, status) of every layout node.

    path orders nodes as a depth-first walk; direction and language are inherited. Markup that
    cannot be read gives one row with a status. Only finding elements needs a parser; the
    fields of a node's title are expressions.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, *[c.split()[0] for c in RAW.split(", ")]]
        for batch in batches:
            rows = [(i, *r) for i, m in zip(batch[id_col], batch[markup_col], strict=True) for r in _rows(m)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.assign(parent=frame["parent"].astype("Int32"))

    nodes = pages.select(id_col, markup_col).mapInPandas(run, f"`{id_col}` {kind}, {RAW}")
    title = F.col("title")
    return nodes.select(
        id_col, "node", "parent", "path", "kind", "name", "text", "dir", "lang",
        text.title_box(title).alias("box"), text.title_baseline(title).alias("baseline"), text.title_angle(title).alias("angle"),
        text.title_confidence(title).alias("confidence"), text.title_font(title).alias("font"),
        text.title_number(title, "ppageno").alias("page"), text.title_number(title, "scan_res").alias("dpi"), "status",
    )


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Nodes of the given kinds in reading order."""
    return nodes.where(F.col("kind").isin(*kinds)).orderBy("path")


def lines(nodes: DataFrame) -> DataFrame:
    """Nodes of any line class in reading order."""
    return of_kind(nodes, *LINES)


def first_of(nodes: DataFrame, page: list[str], *kinds: str) -> DataFrame:
    """(page, kind, node, path): the first node of the given kinds of every page in reading order;
    pages without one give none."""
    row = F.struct("path", "node", "kind")
    found = nodes.where(F.col("kind").isin(*kinds)).groupBy(*page).agg(F.min(row).alias("_f"))
    return found.select(*page, "_f.kind", "_f.node", "_f.path")


def page_text(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, text): the words of a page in reading order, empty ones left out."""
    words = nodes.where((F.col("kind") == "ocrx_word") & (F.col("text") != ""))
    parts = F.array_sort(F.collect_list(F.struct("path", "text")))
    return words.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
