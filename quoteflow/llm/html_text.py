"""Operator 3: main text of HTML pages by minimum-cut labelling.

A page is parsed into text blocks (runs between block-level tags). A linear
classifier on tags, class and id words, length and link density gives each block a
score; it becomes a capacity from the source (content) or to the sink (boilerplate).
Smoothness edges join blocks next to each other and, through a node per enclosing
element, blocks close in the DOM. The source side of a minimum cut (Dinic's maximum
flow) is the main text. The classifier's weights are parameters below, not fitted:
no page is labelled. Tags of parts that never are main text weigh more than all edges
of a block. Class words of such parts, and forms, are a limited cost to the blocks
below, which the cut weighs against the rest; an element that holds over half of the
long unlinked text (of the articles and main elements, else of the page) costs nothing.

Each page is worked on alone, in time near linear in its blocks, in the scan's
partitions; nothing is shuffled.

Defined results: null and empty html, and pages without main text, give the empty
text; a comment or tag that isn't closed drops the rest of the page, as in a browser; a
malformed tag is dropped; character references are decoded; white space within a block becomes one
space; page_id and url pass through, null or repeated; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quoteflow.llm.common import read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var br wbr img".split())
NEVER = frozenset("head script style noscript template nav footer aside iframe svg button select option textarea "
                  "menu dialog object canvas audio video".split())
MAIN = frozenset("article main".split())
WORD = re.compile(r"[a-z]+")
BOILER = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies "
                   "consent gdpr notice notices alert menu nav navbar navigation sidebar footer header masthead comment "
                   "comments disqus reply replies respond share sharing social related recommended popup modal overlay "
                   "breadcrumb breadcrumbs newsletter subscribe subscription subscriptions signup login search pagination pager widget copyright".split())
BODY = frozenset("article content post entry story body main text".split())
#: Classifier weights, and capacities of edges.
W_NEVER, W_BOILER, W_MAIN, W_BODY, W_HEADING, W_LINKS, W_BIAS, W_LONG, LONG = -40.0, -13.0, 8.0, 2.0, 0.5, -4.0, -1.0, 2.5, 25
NEXT, SAME_PARENT, UP = 0.4, 0.6, 0.3


class Blocks(HTMLParser):
    """blocks: (text, score, number of the enclosing element); parents: the
    enclosing element of each element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, float, int]] = []
        self.parents = [-1]
        self.marked = [False]                   # elements whose name is one of boilerplate
        self.inner = [False]                    # elements in an article or main
        self.weights: list[tuple[float, bool]] = []     # of each block: long unlinked text, in article or main
        # tag, element number, never, inline element marked, main, body, links
        self.stack = [("", 0, False, False, False, False, False)]
        self.open: dict[str, list[int]] = {}    # places in the stack by tag, and those of block elements
        self.open_blocks = [0]
        self.in_tag = False
        self.held: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            tag, number, never, _, main, body, _ = self.stack[self.open_blocks[-1]]
            words = len(text.split())
            long, links = min(words / LONG, 1.0), min(1.0, self.linked / len(text))
            score = W_BIAS + W_LONG * long + W_LINKS * links
            score += W_MAIN * main + W_BODY * body + W_HEADING * (tag in ("h1", "h2", "h3")) + W_NEVER * never
            self.blocks.append((text, score, number))
            self.weights.append((0.0 if never else words * long * (1.0 - links), main))
        self.held.clear()
        self.linked = 0

    def scored(self) -> list[tuple[str, float, int]]:
        """The blocks, less the cost of marked elements around them. Parents have
        smaller numbers than their children."""
        inside = any(w and main for w, main in self.weights)
        total = [0.0] * len(self.parents)
        for (_, _, p), (w, main) in zip(self.blocks, self.weights):
            total[p] += w if main or not inside else 0.0
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        cost = [False] * len(total)
        for k in range(1, len(total)):
            least = 0 if inside and not self.inner[k] else LONG         # around an article, or else one long block
            most = total[k] > total[0] / 2 and total[k] >= least
            cost[k] = cost[self.parents[k]] or self.marked[k] and not most
        return [(text, score + W_BOILER * cost[p], p) for text, score, p in self.blocks]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        if tag not in INLINE:
            self.flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        _, parent, never, pending, main, body, link = self.stack[-1]
        names = frozenset(WORD.findall(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()))
        whole = tag in ("html", "body") or tag in MAIN          # a class of the whole page names no part of it
        marked = pending or tag == "form" or not whole and not BOILER.isdisjoint(names - {"header"} if main else names)
        marked = marked or tag == "header" and not main         # an article's own header holds its title
        if tag in INLINE:
            number = parent
        else:
            number = len(self.parents)
            self.parents.append(parent)
            self.marked.append(marked)
            self.inner.append(main)
            self.open_blocks.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, number, never or tag in NEVER, marked and tag in INLINE, main or tag in MAIN,
                           body or not BODY.isdisjoint(names), link or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag: str) -> None:
        """A block starts: an open paragraph ends; so does an open item of the same list."""
        ends = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"),
                "td": ("td", "th", "p"), "th": ("td", "th", "p"), "body": ("head",)}.get(tag, ("p",))
        while self.stack[self.open_blocks[-1]][0] in ends:
            self._cut(self.open_blocks[-1])

    def _cut(self, to: int) -> None:
        for x in self.stack[to:]:
            self.open[x[0]].pop()
        while self.open_blocks[-1] >= to:
            self.open_blocks.pop()
        del self.stack[to:]

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        places = self.open.get(tag)
        if places and (tag not in INLINE or places[-1] > self.open_blocks[-1]):
            self._cut(places[-1])

    def _or_rest(self, k: int) -> int:
        """The whole page is given at once, so markup without an end goes on to the page's."""
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        self.in_tag = True                      # a malformed tag is no text
        k = super().parse_starttag(i)
        self.in_tag = False
        return self._or_rest(k)

    def parse_endtag(self, i):
        return self._or_rest(super().parse_endtag(i))

    def parse_comment(self, i, report=True):
        return self._or_rest(super().parse_comment(i, report))

    def parse_pi(self, i):
        return self._or_rest(super().parse_pi(i))

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):   # a marked section is a comment in HTML
            k = self.rawdata.find(">", i)
            return len(self.rawdata) if k < 0 else k + 1
        return self._or_rest(super().parse_html_declaration(i))

    def handle_data(self, data):
        if self.in_tag or self.stack[-1][2] and self.stack[-1][0] in ("script", "style"):
            return
        self.held.append(data)
        if self.stack[-1][6]:
            self.linked += len(data.strip())


def source_side(n: int, edges: list[tuple[int, int, float, float]], s: int, t: int) -> list[bool]:
    """Dinic's maximum flow; True for nodes reachable in what is left of the
    capacities. edges: (u, v, capacity, capacity back)."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for u, v, c, back in edges:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)
    tiny = 1e-9
    while True:
        level = [-1] * n
        level[s] = 0
        todo = deque([s])
        while todo:
            u = todo.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        at, path, u = [0] * n, [], s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                break


def labels(blocks: list[tuple[str, float, int]], parents: list[int]) -> list[bool]:
    """True for the blocks of the main text."""
    if not blocks:
        return []
    n, used = len(blocks), {}
    for _, _, p in blocks:                       # the elements that hold blocks, and theirs
        while p >= 0 and p not in used:
            used[p] = n + len(used)
            p = parents[p]
    s = n + len(used)
    edges = []
    for i, (_, score, p) in enumerate(blocks):
        edges.append((s, i, score, 0.0) if score > 0 else (i, s + 1, -score, 0.0))
        edges.append((i, used[p], SAME_PARENT, SAME_PARENT))
        if i:
            edges.append((i - 1, i, NEXT, NEXT))
    edges += [(k, used[parents[p]], UP, UP) for p, k in used.items() if parents[p] >= 0]
    return source_side(s + 2, edges, s, s + 1)[:n]


def main_text(html: str | None) -> str:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    keep = labels(parser.scored(), parser.parents)
    return "\n\n".join(b[0] for b, k in zip(parser.blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                s = b.slice(a, 256)
                texts = [main_text(h) for h in s.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(texts, pa.string()),
                                                  pa.array(list(map(len, texts)), pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(part, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
