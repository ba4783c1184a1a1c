"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags.  Every block is a node of a flow network.  What a
linear classifier finds for or against it (its length, links, place in the page) becomes the capacity
from the source or to the sink; blocks that follow each other or share a parent are joined by
smoothness edges.  A maximum flow gives the cheapest labelling; blocks on the source's side are the main
text.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose text is not shown as part of the page.
HIDDEN = frozenset("script style title textarea noscript template iframe svg math object select audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that frame the page rather than tell its story.
FRAME = frozenset("nav footer aside form menu dialog button fieldset label legend option dir".split())
#: Words of class, id and role that say the same.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promoted promotion"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer foot colophon copyright"
    " sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay dialog"
    " comment comments disqus replies respond reply discussion share sharing social follow related recommended recommendations outbrain taboola"
    " subscribe subscription newsletter signup login register search form contentinfo complementary skip tags".split()
)
MAIN = frozenset("article main".split())
#: Opening one of these ends an open one of those.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}

#: Weights of the classifier, in hundredths: for main text if above zero.
BASE, PER_WORD, MOST_WORDS, SENTENCE, LINKS, HEADING, IN_MAIN, IN_FRAME = -50, 6, 40, 50, -400, 60, 400, -900
#: Smoothness between neighbours: under one parent, under one grandparent, else; and between the next but one.
NEAR = (80, 40, 15)
NEXT_BUT_ONE = 20


class _Element:
    __slots__ = ("tag", "parent", "main", "frame", "header", "number")

    def __init__(self, tag: str, parent, attributes: str, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        main = tag in MAIN
        frame = tag in FRAME or (tag == "header" and not parent.main)
        if attributes:
            words = {w.lower() for m in _MARKS.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
            main = main or "article" in words and not words & NOISE
            frame = frame or (tag not in ("html", "body", "main", "article") and bool(words & NOISE))
        self.main = parent.main or main
        self.frame = parent.frame or frame
        self.header = tag not in MAIN and (parent.header or tag == "header")


class _Root:
    tag, parent, main, frame, header, number = "", None, False, False, False, -1


def blocks(page: str) -> list[tuple[str, _Element, int]]:
    """(text, innermost block element, characters inside links) of every block, in page order."""
    root = _Root()
    stack, out, text, linked, in_link, count = [root], [], [], 0, 0, 0

    def close():
        nonlocal text, linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append((joined, stack[-1], linked))
        text, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        start = m.start() if m else n
        if start > at:
            text.append(page[at:start])
            if in_link:
                linked += start - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in HIDDEN and not closing:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCK:
            continue
        close()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
            stack.pop()
        while stack[-1].tag in _ENDS.get(tag, ()):
            stack.pop()
        count += 1
        stack.append(_Element(tag, stack[-1], m[3], count))
    close()
    return out


def evidence(text: str, element: _Element, linked: int) -> int:
    """For main text if above zero, against it if below."""
    score = BASE + PER_WORD * min(text.count(" ") + 1, MOST_WORDS) + LINKS * min(linked, len(text)) // len(text)
    if text[-1] in ".!?…\"'”»)":
        score += SENTENCE
    e = element
    if e.tag in HEADINGS:
        score += HEADING
    if e.main:
        score += IN_MAIN
        if e.header and e.tag not in HEADINGS:
            score -= IN_MAIN + 200
    if element.frame:
        score += IN_FRAME
    return score


def minimum_cut(capacity: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut.

    capacity: from the source if above zero, to the sink if below.  edges: (i, j, capacity both ways).
    Shortest augmenting paths, level graph by level graph.
    """
    n = len(capacity)
    links: list[list[list]] = [[] for _ in range(n)]  # [to, residual, index of the way back]
    for i, j, c in edges:
        links[i].append([j, c, len(links[j])])
        links[j].append([i, c, len(links[i]) - 1])
    left = list(capacity)
    while True:
        level = [0 if left[i] > 0 else -1 for i in range(n)]
        queue, reached = deque(i for i in range(n) if left[i] > 0), False
        while queue:
            i = queue.popleft()
            for j, c, _ in links[i]:
                if c > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    reached = reached or left[j] < 0
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in range(n):
            while left[s] > 0 and level[s] == 0:
                path, i = [], s
                while not left[i] < 0:
                    while turn[i] < len(links[i]):
                        link = links[i][turn[i]]
                        if link[1] > 0 and level[link[0]] == level[i] + 1:
                            break
                        turn[i] += 1
                    else:
                        if not path:
                            break
                        i = path.pop()[0]
                        turn[i] += 1
                        continue
                    path.append((i, link))
                    i = link[0]
                if not left[i] < 0:
                    break
                flow = min(left[s], -left[i], *(link[1] for _, link in path))
                left[s] -= flow
                left[i] += flow
                for k, link in path:
                    link[1] -= flow
                    links[link[0]][link[2]][1] += flow


def smoothness(a: _Element, b: _Element) -> int:
    """What it costs to part two neighbours: the nearer they stand in the page, the more; little where a frame begins or ends."""
    if a.frame != b.frame:
        return NEAR[2]
    over_a, over_b = a.parent, b.parent
    if a is b or over_a is over_b or a is over_b or over_a is b:
        return NEAR[0]
    if over_a is not None and over_b is not None and (over_a.parent is over_b.parent or over_a is over_b.parent or over_a.parent is over_b):
        return NEAR[1]
    return NEAR[2]


def labelled(found: list[tuple[str, _Element, int]], edges: bool = True) -> list[bool]:
    """Which blocks are main text; without ``edges`` each by its own evidence."""
    links = []
    for k in range(1, len(found) if edges else 0):
        a, b = found[k - 1][1], found[k][1]
        links.append((k - 1, k, smoothness(a, b)))
        if k > 1 and found[k - 2][1].parent is b.parent and found[k - 2][1].frame == b.frame:
            links.append((k - 2, k, NEXT_BUT_ONE))
    return minimum_cut([evidence(*block) for block in found], links)


def main_text(page: str | None, edges: bool = True) -> str:
    """The main text: its blocks, white space inside them made one space, joined by empty lines."""
    found = blocks(page) if page else []
    return "\n\n".join(block[0] for block, inside in zip(found, labelled(found, edges), strict=True) if inside)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the html, with text (empty if there is none) and n_chars, its code points.

    Other columns stay; those named text or n_chars are replaced.  A null page has an empty text.  Nothing is capped.
    """
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars", column.lower())]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(names)).to_pylist()]
            arrays = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*[f"`{c}`" for c in names], f"`{column}`").mapInArrow(run, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
