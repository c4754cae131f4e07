"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf path of tags. Per path, text length and punctuation are
related to the number of nodes that share it; both series are smoothed over the page in node
order, more over like paths than over unlike ones, fused, and cut at a share of their spread.
Nodes of paths above the cut are content; the smallest element that holds all of them is the
article. What lies in it, short paragraphs and headings included, is its text, less what is
named as no prose: menus, forms, adverts, notices, sidebars, scripts and reader comments.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the spread of the fused ratio above which a path counts as content.
CUT = 0.5

#: Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCK - set("br body html option".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
ARTICLES = {"article", "main"}
SECTIONS = {"article", "main", "table", "section", "div"}
CLOSED_ONLY_BY_SECTIONS = {"article", "main", "table"}
SCOPE = {"div", "article", "section", "td", "main"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Elements whose content is not markup, or no text of the page.
RAW = "script|style|noscript|template|textarea|iframe|object|svg|math|canvas|audio|video|title"
#: Elements that are never part of an article.
ASIDE_TAGS = set("nav aside form button select footer menu dialog search head".split())
#: Words of class, id and role that name what is not the article.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|notices|alert|popup|modal|overlay|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|widget\w*|related|recommend\w*|share|sharing|social|"
    r"comments?|commentlist|respond|replies|disqus\w*|newsletter|subscribe|signup|login|form|search|footer|foot|"
    r"masthead|topbar|toolbar|pagination|pager|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")
SPACES = re.compile(r"\s+")


class Element:
    """An open or closed element: ``path`` numbers its tag path of ``depth`` steps, ``first`` and
    ``end`` the elements that begin in it, ``out`` tells if it or one above is named as no article."""

    __slots__ = ("tag", "parent", "path", "depth", "out", "in_article", "first", "end")

    def __init__(self, tag: str, parent: Element | None, path: int, out: bool, first: int):
        self.tag, self.parent, self.path, self.out, self.first, self.end = tag, parent, path, out, first, -1
        self.depth = parent.depth + 1 if parent else 1
        self.in_article = tag in ARTICLES or parent is not None and parent.in_article

    def holds(self, other: Element) -> bool:
        return self.first <= other.first < self.end


class Opened:
    """The open elements, with the places at which each tag is open, so that no tag needs a walk
    over all of them."""

    def __init__(self) -> None:
        self.count, self.paths = 1, {(-1, "html"): 0}
        self.stack, self.places = [Element("html", None, 0, False, 0)], defaultdict(list, html=[0])

    def push(self, tag: str, out: bool) -> None:
        above = self.stack[-1]
        path = self.paths.setdefault((above.path, tag), len(self.paths))
        self.places[tag].append(len(self.stack))
        self.stack.append(Element(tag, above, path, out, self.count))
        self.count += 1

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            e = self.stack.pop()
            e.end = self.count
            self.places[e.tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place above the root at which one of the tags is open, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tag: str) -> None:
        """An end tag: it closes the innermost element of its name, but a part of a line or list
        does not end an article or table around it."""
        place = self.last([tag])
        if place and (tag in SECTIONS or place >= self.last(CLOSED_ONLY_BY_SECTIONS)):
            self.cut(place)

    def imply(self, tag: str) -> None:
        """A start tag: it closes open elements that cannot hold it, as far as its scope."""
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_PARAGRAPH else set())
        if not ends:
            return
        scope = self.last((SCOPES.get(tag, set()) | SCOPE) - ends)
        inside = [self.places[t][bisect_right(self.places[t], scope)] for t in ends if self.last([t]) > scope]
        if inside:
            self.cut(min(inside))


def text_nodes(page: str) -> list[tuple[Element, str, int]]:
    """(element, raw text, block) in page order; nodes of one block run together. Takes time in
    proportion to the page, however deep its elements lie."""
    block, nodes, place, opened = 0, [], 0, Opened()

    def text(upto: int) -> None:
        if upto > place and (raw := page[place:upto]):
            nodes.append((opened.stack[-1], raw, block))

    for m in TOKEN.finditer(page):
        text(m.start())
        place = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in ("html", "body"):
            block += bool(tag)
            continue
        block += tag in BLOCK
        if m[2]:
            opened.close(tag)
            continue
        opened.imply(tag)
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCK:
            continue
        above = opened.stack[-1]
        named = dict((k.lower(), (v or "").strip("\"'")) for k, v in NAMED.findall(m[4])) if m[4].strip() else {}
        out = (
            above.out
            or tag in ASIDE_TAGS
            or tag == "header" and not above.in_article
            or "hidden" in named
            or named.get("aria-hidden", "").lower() == "true"
            or tag not in ("article", "main", "body")
            and bool(ASIDE_WORDS.search(" ".join(named.get(k, "") for k in ("class", "id", "role"))))
        )
        opened.push(tag, out)
    text(len(page))
    opened.cut(0)
    return nodes


def _likeness(a: Element, b: Element) -> float:
    """The share of two tag paths, from the root on, that is the same."""
    most = max(a.depth, b.depth)
    while a.path != b.path:
        if a.depth >= b.depth:
            a, b = b, a
        b = b.parent
    return a.depth / most


def path_ratios(elements: list[Element], lengths: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The fused, smoothed ratio of each node: of text length and of punctuation, each summed
    over a path and divided by the path's nodes. Smoothing takes two neighbours on either side,
    weighed by distance and by how alike their paths are."""
    names = {p: k for k, p in enumerate(dict.fromkeys(e.path for e in elements))}
    of = np.array([names[e.path] for e in elements])
    nodes = np.bincount(of)

    def smooth(series: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
        total, whole = series.copy(), np.ones(len(series))
        for d, w in enumerate(weights, 1):
            total[d:] += w * series[:-d]
            total[:-d] += w * series[d:]
            whole[d:] += w
            whole[:-d] += w
        return total / whole

    weights = [
        np.exp(-0.5 * d * d) * np.array([_likeness(x, y) for x, y in zip(elements, elements[d:], strict=False)])
        for d in (1, 2)
        if len(elements) > d
    ]
    by_length = smooth((np.bincount(of, lengths) / nodes)[of], weights)
    by_points = smooth((np.bincount(of, points) / nodes)[of], weights)
    fused = by_length * (1 + by_points)
    return np.bincount(of, fused)[of] / nodes[of]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, one a line. Empty if there is none.

    Tag paths above the threshold are content. What holds all content that is not named as
    something else (an aside, a form, an advert, a comment ...) is the article; an element that
    the page itself calls article or main and that lies around it takes its place. Short
    paragraphs and headings in it belong to it, whatever their path's ratio.
    """
    nodes = [(e, b, entities.unescape(raw)) for e, raw, b in text_nodes(page or "")]
    seen = [(e, t) for e, _, t in nodes if not e.out and t.strip()]
    if not seen:
        return ""
    lengths = np.array([len(SPACES.sub(" ", t).strip()) for _, t in seen], float)
    points = np.array([len(PUNCTUATION.findall(t)) for _, t in seen], float)
    ratio = path_ratios([e for e, _ in seen], lengths, points)
    content = [e for (e, _), hit in zip(seen, ratio >= CUT * ratio.std(), strict=True) if hit]
    last, container = max(content, key=lambda e: e.first), min(content, key=lambda e: e.first)
    while not container.holds(last):
        container = container.parent
    named, above = None, container
    while named is None and above is not None:
        named, above = above if above.tag in ARTICLES else None, above.parent
    while named is None and container.parent is not None and (container.tag not in BLOCK or container.tag in ("p", "li", "td", "tr")):
        container = container.parent  # neighbours of a lone long paragraph belong to it
    container = named or container
    blocks: dict[int, list[str]] = defaultdict(list)
    for e, b, t in nodes:
        if not e.out and container.holds(e):
            blocks[b].append(t)
    lines = (SPACES.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``carry`` of every page, with text and n_chars (its code points).

    A null or empty page, and one without an article, gives the empty text. Broken markup is
    read as far as it goes: open elements end with the page, unknown tags are plain elements.
    Nothing is cut short; time grows with the page's length, however deep its elements lie. Other columns of ``pages`` are not read; repeated rows give repeated
    results, an empty table gives none.
    """
    keys = [pages.schema[c] for c in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=[*carry, "text", "n_chars"],
            )

    return pages.select(*carry, html_col).mapInArrow(run, schema)
