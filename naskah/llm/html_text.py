"""Main text of web pages by tag-path ratios.

Every run of text between block boundaries is a node with a root-to-leaf tag path. Text length and
punctuation are summed per path; both ratios are smoothed over the nodes in page order and fused
into one score, which is raised inside ``<article>`` and ``<main>`` and lowered where class or id
hint at adverts, comments and the like. Nodes below the standard deviation of the scores are cut,
but blocks beside the kept ones (titles, leads, short paragraphs, lists) are filled in again.
Parts that are never content (navigation, forms …) are left out before. Hints don't count for
headings, nor for what holds the largest article or most of the text.

Markup may be broken: tags that HTML closes by itself are closed, end tags without a start are
ignored, and open elements end with the page. ``<br>`` counts as white space inside a block.

Defined results: null or empty page, or one without text: empty text, 0 characters. Repeated rows
give equal rows; other columns are ignored. Pages are read whole, one at a time.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr img ruby rb rt rp".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
NEVER = frozenset(
    "head nav footer aside form button select option input menu dialog object audio video canvas map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HINTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie "
    "cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination popup promo promoted promotion recommended related reply replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget consent gdpr alert".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {  # start tag: (open tags that it ends, tags at which the search stops)
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
BLOCKS = HEADINGS | frozenset("p li ul ol td th tr thead tbody tfoot table blockquote pre figure figcaption dl dt dd".split())
BOOST = 10.0  # of scores in an article
PENALTY = 0.02  # of scores where names hint at something else
MOST = 2 / 3


class _Element:
    __slots__ = ("tag", "parent", "path", "out", "inside", "linked", "text", "hint")

    def __init__(self, tag: str, parent: _Element | None, out: bool, hint: bool = False) -> None:
        self.tag, self.parent, self.out, self.hint = tag, parent, out, hint
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.linked = self.text = 0  # characters, for lists


def _hidden(tag: str, attributes: str, inside: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(
        name.lower() == "role" and (a or b or c).strip().lower() in ROLES for name, a, b, c in ATTRIBUTE.findall(attributes)
    )


def _hinted(tag: str, attributes: str) -> bool:
    if tag in HEADINGS or tag in ("html", "body", "article", "main"):
        return False
    return any(
        name.lower() != "role" and any(x.lower() in HINTS for x in NAME_PART.findall(a or b or c))
        for name, a, b, c in ATTRIBUTE.findall(attributes)
    )


def _nodes(page: str) -> list[tuple[_Element, str]]:
    """(element, text) of each run of text between block boundaries, in page order."""
    root = _Element("", None, False)
    stack, nodes, parts = [root], [], []
    links = 0  # characters of the run that are link text

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                element = next(e for e in reversed(stack) if e.tag not in INLINE)
                nodes.append((element, text))
                for e in stack:
                    if e.tag in ("ul", "ol"):
                        e.text += len(text)
                        e.linked += min(links, len(text))
        links = 0

    def end(tags: set[str], stops: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                flush()
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    at, find = 0, TAG.search
    while True:
        m = find(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            if any(e.tag == "a" for e in stack[-3:]):
                links += len(" ".join(html.unescape(piece).split()))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "br":
                parts.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        flush()
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in ("svg", "math") and attributes.rstrip().endswith("/"):
                continue
            at = close.end() if close else len(page)
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                end({"p"}, {"td", "th", "button", "object"})
                flush()
            continue
        if tag in CLOSES_P:
            end({"p"}, {"td", "th", "button", "object"})
        if tag in SELF_CLOSING:
            end(*SELF_CLOSING[tag])
        if tag in ("article", "main"):
            for i in range(1, len(stack)):
                if stack[i].tag in ("nav", "head", "header", "menu"):
                    flush()
                    del stack[i:]
                    break
        if tag == "body":
            end({"head"}, set())
        if tag not in INLINE:
            flush()
        parent = stack[-1]
        stack.append(_Element(tag, parent, parent.out or _hidden(tag, attributes, parent.inside), _hinted(tag, attributes)))
    flush()
    return nodes


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, 1, mode="edge")
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def _chain(element: _Element | None) -> Iterator[_Element]:
    while element is not None:
        yield element
        element = element.parent


def _hints(nodes: list[tuple[_Element, str]]) -> list[bool]:
    """Whether each node is in an element whose name hints at something else than content."""
    held: dict[_Element, int] = defaultdict(int)
    for element, text in nodes:
        for e in _chain(element):
            held[e] += len(text)
    articles = [e for e in held if e.tag in ("article", "main")]
    around = set(_chain(max(articles, key=held.__getitem__))) if articles else set()
    most = MOST * sum(len(t) for _, t in nodes)
    hints = {e for e in held if e.hint and e not in around and held[e] < most}
    return [any(e in hints for e in _chain(element)) for element, _ in nodes]


def node_scores(nodes: list[tuple[_Element, str]], hinted: list[bool]) -> np.ndarray:
    """Fused, smoothed ratios of each node's tag path: text length times punctuation."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    paths = [(e.path, h) for (e, _), h in zip(nodes, hinted)]
    for path, (_, text) in zip(paths, nodes):
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    text_ratio = np.array([length[p] / count[p] for p in paths], float)
    mark_ratio = np.array([(marks[p] + 1) / count[p] for p in paths], float)
    weight = np.array([(BOOST if e.inside else 1.0) * (PENALTY if h else 1.0) for (e, _), h in zip(nodes, hinted)])
    return _smooth(text_ratio) * _smooth(mark_ratio) * weight


def main_text(page: str) -> str:
    """Main text of one page; blocks are separated by an empty line."""
    nodes = [(e, t) for e, t in _nodes(page) if not e.out and not _menu(e)]
    if not nodes:
        return ""
    hinted = _hints(nodes)
    scores = node_scores(nodes, hinted)
    chosen = scores >= np.std(scores)
    at = np.flatnonzero(chosen)
    around = {e for i in at for e in _chain(nodes[i][0].parent)}

    def beside(i: int) -> bool:
        """A block of an element that chosen nodes are in; on the page's top level only between them."""
        element = nodes[i][0]
        if element not in around:
            element = element.parent or element
        while element.tag in BLOCKS:
            element = element.parent
        return element in around and (element.tag not in ("", "html", "body") or at[0] < i < at[-1])

    return "\n\n".join(t for i, (_, t) in enumerate(nodes) if chosen[i] or not hinted[i] and beside(i))


def _menu(element: _Element | None) -> bool:
    """In a list that is all links."""
    while element is not None:
        if element.text and element.linked == element.text:
            return True
        element = element.parent
    return False


def extract(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """``keys``, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*keys, "text", "n_chars"],
            )

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, page).mapInArrow(run, f"{schema}, text string, n_chars long")
