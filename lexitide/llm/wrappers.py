"""Main text of HTML pages by wrapper induction.

Pages of one host and layout share a template.  Each page's DOM tree is aligned
with the tree of its layout's reference page (the smallest page_id) by simple
tree matching.  A text node of the reference whose text recurs in most of the
nodes aligned with it is constant and becomes template, wherever it stands;
every other slot varies and becomes content.  Slots that vary but are no
article, such as adverts and related links, are told by their elements, roles
and class names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, materialize, slices

REFERENCE_BYTES = 8_000_000
MIN_PAGES, CONSTANT = 3, 0.8

_TAG = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^<>=]+|=\s*(?:"[^"]*"|'[^']*')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object textarea title xmp noembed noframes canvas audio video".split())
_ENDS_P = _BLOCKS - frozenset(("body", "html", "button", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"))
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_DROP = frozenset("nav footer aside form fieldset button select dialog menu head header".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adsense banner breadcrumb breadcrumbs comment commentform commentlist comments consent cookie cookiebanner cookiebar cookieconsent cookies copyright disqus footer gdpr header login masthead mainmenu menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related reply replies respond responses share sharing sidebar sidenav signup social sponsor sponsored submenu subscribe subscription toolbar topbar topnav widget widgets".split())
_RAW_END = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in _RAW}
_TEXT_RAW = frozenset(("script", "style", "textarea", "title"))
_KEEP = frozenset(("html", "body", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    """An element, or a text node where tag is None."""

    __slots__ = ("tag", "label", "children", "text", "drop", "parent", "shape", "link")

    def __init__(self, tag: str | None, label: str, parent: Node | None, text: str = "", drop: bool = False, link: bool = False):
        self.tag, self.label, self.parent, self.text, self.drop, self.link = tag, label, parent, text, drop, link
        self.children: list[Node] = []
        self.shape = 0


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(source)} if source.strip("/ \t\n") else {}


def _unwanted(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in _DROP:
        return not (tag == "header" and inside)
    if tag in _KEEP or not attributes:
        return False
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in _DROP_ROLES:
        return True
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')}")]
    found = {w for before, w in zip(["", *words], words) if w in _DROP_WORDS and before not in ("has", "with", "no", "without")}
    if tag == "article" and not inside:
        return bool(found & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored", "related"})
    return bool(found) and tag not in _HEADINGS


class _Open:
    """The open elements from the root down, with the depths at which each tag is open."""

    def __init__(self, root: Node):
        self.nodes, self.depths = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> list[Node]:
        """Closes all elements from ``depth`` on."""
        gone = self.nodes[depth:]
        del self.nodes[depth:]
        for node in gone:
            self.depths[node.tag].pop()
        return gone

    def last(self, *tags: str) -> int:
        """The depth of the innermost element of these tags, -1 without any."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def first(self, tags: set[str], above: int) -> int:
        """The depth of the outermost element of these tags below ``above``, -1 without any."""
        found = [d[bisect_right(d, above)] for t in tags if (d := self.depths.get(t)) and d[-1] > above]
        return min(found, default=-1)


def parse(source: str) -> Node:
    """A tree of block elements and text nodes; inline markup is dissolved into text.  Time grows with the length, however deep the page."""
    root = Node("html", "html", None)
    at, buffer, links, inside, pos, size = _Open(root), [], [0, 0], 0, 0, len(source)
    inline: Counter[str] = Counter()
    endless: set[str] = set()

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            top = at.nodes[-1]
            top.children.append(Node(None, "#text", top, text, link=links[1] * 2 > links[0]))
        buffer.clear()
        links[:] = [0, 0]

    def say(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        n = len(text.strip())
        links[0] += n
        links[1] += n if inline["a"] > 0 else 0

    def close(depth: int) -> None:
        nonlocal inside
        flush()
        inside -= sum(n.tag in ("article", "main") for n in at.cut(depth))

    for match in _TAG.finditer(source):
        if match.start() < pos:
            continue
        if match.start() > pos:
            say(source[pos : match.start()])
        pos = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag not in _BLOCKS:
                inline[tag] -= inline[tag] > 0
                continue
            depth = at.last(tag)
            if depth > 0:
                close(depth)
            else:
                flush()
            continue
        if tag in _RAW:
            if not match[3].rstrip().endswith("/") or tag in _TEXT_RAW:
                end = None if tag in endless else _RAW_END[tag].search(source, pos)
                if end is None:
                    endless.add(tag)
                pos = end.end() if end else (size if tag in _TEXT_RAW else pos)
            continue
        if tag not in _BLOCKS:
            if tag == "br":
                buffer.append(" ")
            elif tag not in _VOID and not match[3].rstrip().endswith("/"):
                inline[tag] += 1
            continue
        flush()
        if tag == "hr":
            continue
        if tag in ("html", "body") and at.last(tag) >= 0:
            continue
        if tag in _ENDS_P and at.last("p") > at.last("td", "th", "button", "caption"):
            close(at.last("p"))
        if tag in _CLOSES:
            shut, stop = _CLOSES[tag]
            depth = at.first(shut, at.last(*stop))
            if depth > 0:
                close(depth)
        if tag == "body" and at.nodes[-1].tag == "head":
            close(len(at.nodes) - 1)
        attributes = _attributes(match[3])
        top = at.nodes[-1]
        node = Node(tag, f"{tag}.{attributes.get('class', '')}", top, drop=_unwanted(tag, attributes, inside > 0))
        top.children.append(node)
        at.push(node)
        inside += tag in ("article", "main")
    if pos < size:
        say(source[pos:])
    flush()
    return root


def leaves(root: Node) -> list[Node]:
    """The text nodes in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag is None:
            out.append(node)
        stack.extend(reversed(node.children))
    return out


class Matcher:
    """Simple tree matching: the largest top-down, order-preserving alignment of two trees of any depth and width."""

    STRIP = 64

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.counts = [0]
        self.sizes: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> None:
        """Numbers structurally equal subtrees alike; deepest nodes first."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):
            key = (node.label, *(c.shape for c in node.children))
            if key not in self.shapes:
                self.shapes[key] = len(self.counts)
                self.counts.append(1 + sum(self.counts[c.shape] for c in node.children))
            node.shape = self.shapes[key]

    def size(self, a: Node, b: Node) -> int:
        """How many nodes of two shaped trees match; a stack of its own takes the place of recursion."""
        stack, value = [self._size(a, b)], None
        while stack:
            try:
                stack.append(self._size(*stack[-1].send(value)))
                value = None
            except StopIteration as done:
                stack.pop()
                value = done.value
        return value

    def _known(self, a: Node, b: Node) -> int | None:
        if a.shape == b.shape:
            return self.counts[a.shape]
        if a.label != b.label:
            return 0
        if not a.children or not b.children:
            return 1
        return self.sizes.get((a.shape, b.shape))

    def _size(self, a: Node, b: Node):
        """Asks for the sizes of pairs of children it doesn't know; returns its own."""
        known = self._known(a, b)
        if known is not None:
            return known
        alike, x, y = self._middle(a.children, b.children)
        total = 1 + sum(self.counts[n.shape] for n, _ in alike)
        if x and y:
            xs, ys = ({n.shape: n for n in reversed(z)} for z in (x, y))
            for m in xs.values():
                for n in ys.values():
                    if self._known(m, n) is None:
                        yield m, n
            total += int(self._last_row(x, self._rows(x, y), len(y))[-1])
        self.sizes[a.shape, b.shape] = total
        return total

    @staticmethod
    def _middle(a: list[Node], b: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
        """Pairs of equal shape at both ends, which some best matching has, and what is between."""
        head, most = 0, min(len(a), len(b))
        while head < most and a[head].shape == b[head].shape:
            head += 1
        tail = 0
        while tail < most - head and a[-1 - tail].shape == b[-1 - tail].shape:
            tail += 1
        return list(zip(a[:head], b[:head])) + list(zip(a[len(a) - tail :], b[len(b) - tail :])), a[head : len(a) - tail], b[head : len(b) - tail]

    def _rows(self, x: list[Node], y: list[Node]):
        """A function that gives a node's sizes with all of ``y``, which :meth:`_size` has made known."""
        kinds, column = np.unique([n.shape for n in y], return_inverse=True)
        first = {n.shape: n for n in reversed(y)}
        kept: dict[int, np.ndarray] = {}

        def row(node: Node) -> np.ndarray:
            if node.shape not in kept:
                if len(kept) * len(kinds) > 4_000_000:
                    kept.clear()
                kept[node.shape] = np.array([self._known(node, first[int(k)]) for k in kinds], np.int32)
            return kept[node.shape][column]

        return row

    @staticmethod
    def _next(top: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.empty_like(top)
        out[0] = 0
        np.maximum(top[1:], top[:-1] + row, out=out[1:])
        return np.maximum.accumulate(out)

    def _last_row(self, x: list[Node], row, width: int) -> np.ndarray:
        top = np.zeros(width + 1, np.int32)
        for node in x:
            top = self._next(top, row(node))
        return top

    def _walk(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        """The pairs of a best matching of two lists.

        The table of sizes is held a strip of rows at a time: some rows are kept
        on the way down, the strips below them are made again on the way back.
        """
        row, strip = self._rows(x, y), max(self.STRIP, isqrt(len(x)) + 1)
        tops = [np.zeros(len(y) + 1, np.int32)]
        for s in range(strip, len(x), strip):
            top = tops[-1]
            for node in x[s - strip : s]:
                top = self._next(top, row(node))
            tops.append(top)
        out, j = [], len(y)
        for s in range(len(tops) - 1, -1, -1):
            part, table = x[s * strip : (s + 1) * strip], [tops[s]]
            for node in part:
                table.append(self._next(table[-1], row(node)))
            i = len(part)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((part[i], y[j]))
        return out

    def align(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Pairs of aligned text nodes."""
        self.shape(a)
        self.shape(b)
        self.size(a, b)
        out, stack = [], [(a, b)] if a.label == b.label else []
        while stack:
            m, n = stack.pop()
            if m.tag is None:
                out.append((m, n))
                continue
            alike, x, y = self._middle(m.children, n.children)
            stack.extend(alike)
            if x and y:
                for u in {c.shape: c for c in x}.values():
                    for v in {c.shape: c for c in y}.values():
                        self.size(u, v)
                stack.extend(self._walk(x, y))
        return out


def content(root: Node, template: frozenset[int] = frozenset()) -> list[Node]:
    """The text nodes of the article: of the largest article element, else of main, else of the body, without the template's (ids of nodes) and unwanted elements."""
    kept: list[tuple[Node, Node | None, Node | None]] = []
    stack = [(root, None, None, False, False)]
    while stack:
        node, article, main, header, heading = stack.pop()
        if node.drop or id(node) in template:
            continue
        if node.tag is None:
            if heading or not header:  # of an article's header only headings stay
                kept.append((node, article, main))
            continue
        article = article or (node if node.tag == "article" else None)
        main = main or (node if node.tag == "main" else None)
        header, heading = header or node.tag == "header", heading or node.tag in _HEADINGS
        stack.extend((child, article, main, header, heading) for child in reversed(node.children))
    for place in (1, 2):
        lengths: dict[int, int] = {}
        for entry in kept:
            if entry[place] is not None:
                lengths[id(entry[place])] = lengths.get(id(entry[place]), 0) + len(entry[0].text)
        if lengths:
            best = max(lengths, key=lengths.__getitem__)
            return [entry[0] for entry in kept if entry[place] is not None and id(entry[place]) == best]
    return [node for node, _, _ in kept if not node.link]


def host_of(url: Column) -> Column:
    """The lower-cased host; empty for null or relative addresses."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def layout_of(source: Column) -> Column:
    """What tells a host's layouts apart: the class names of the body and of the first div, main and article; numbers in them don't count."""
    names = [F.regexp_extract(source, rf"(?i)<{tag}\b[^>]*?\sclass\s*=\s*[\"']?([^\"'>]*)", 1) for tag in ("body", "div", "main", "article")]
    return F.xxhash64(*[F.regexp_replace(n, "[0-9]+", "0") for n in names])


@lru_cache(maxsize=64)
def _reference(source: str) -> tuple[Node, list[Node], frozenset[str]]:
    """A reference page's tree, its text nodes in order and the texts of its content."""
    root = parse(source)
    return root, leaves(root), frozenset(n.text for n in content(root))


def _votes(rows: DataFrame) -> DataFrame:
    """(host, layout, slot, met, same): for text nodes of the reference, how many pages of another article have a node aligned, and one of the same text; slot -1 counts those pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, 3)):
            met: Counter[tuple[str, int, int]] = Counter()
            same: Counter[tuple[str, int, int]] = Counter()
            matcher = Matcher()
            for host, layout, page, reference in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if page == reference:
                    continue
                a, slots, own = _reference(reference)
                b = parse(page)
                other = [(len(n.text), n.text in own) for n in content(b)]
                if sum(n for n, known in other if known) * 2 > sum(n for n, _ in other):
                    continue  # a copy of the article: what it shares tells nothing of the template
                met[host, layout, -1] += 1
                place = {id(n): k for k, n in enumerate(slots)}
                for x, y in matcher.align(a, b):
                    met[host, layout, place[id(x)]] += 1
                    if x.text == y.text:
                        same[host, layout, place[id(x)]] += 1
                if len(matcher.shapes) > 100_000:
                    matcher = Matcher()
            cols = [*zip(*met), list(met.values()), [same[k] for k in met]] if met else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] + [pa.int64()] * 4)], ["host", "layout", "slot", "met", "same"])

    return rows.select("host", "layout", "html", "reference").mapInArrow(run, "host string, layout long, slot long, met long, same long")


def _extract(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, 3)):
            texts, matcher = [], Matcher()
            for page, reference, constant in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                root, template = parse(page), frozenset()
                if constant:
                    a, slots, _ = _reference(reference)
                    known = {id(slots[k]) for k in constant}
                    template = frozenset(id(y) for x, y in matcher.align(a, root) if id(x) in known and x.text == y.text)
                    if len(matcher.shapes) > 100_000:
                        matcher = Matcher()
                texts.append("\n\n".join(n.text for n in content(root, template)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "reference", "slots").mapInArrow(run, "page_id long, url string, text string")


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, constant: float = CONSTANT, reference_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """(page_id, url, text) of every row: its article's blocks, joined by blank lines.

    A text node is template where at least ``min_pages`` pages of its host and
    layout, and a quarter of those whose articles differ from the reference's,
    have a node that aligns with it, and a share of ``constant`` of them repeats
    its text.  Layouts of fewer pages and pages without a host keep all that
    their elements don't rule out.  White space is what Python splits at,
    no-break spaces among it.  Null html counts as empty and has empty text;
    null ids and addresses stay; repeated rows repeat; other columns are
    ignored.  No rows give no rows.

    References go to the pages by broadcast if all of them are at most
    ``reference_bytes``, else by a join that Spark splits where a host is hot;
    votes are counted before they are shuffled.
    """
    keys = ["host", "layout"]
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumns({"host": host_of(F.col("url")), "layout": layout_of(F.col("html"))})
    first = materialize(rows.where("host <> ''").groupBy(*keys).agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", F.xxhash64("html").alias("h"))).alias("r"), F.count("*").alias("n")).where(F.col("n") > min_pages).select(*keys, F.col("r.page_id").alias("_id"), F.col("r.h").alias("h")), "references")
    chosen = join_checked(rows, first, keys, "inner", 50_000).where(F.col("page_id").eqNullSafe(F.col("_id")) & (F.xxhash64("html") == F.col("h")))
    references = materialize(chosen.groupBy(*keys).agg(F.max("html").alias("reference")), "reference-pages")
    bytes_ = references.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0
    near = F.broadcast(references) if bytes_ <= reference_bytes else references
    votes = materialize(_votes(rows.join(near, keys)).groupBy(*keys, "slot").agg(F.sum("met").alias("met"), F.sum("same").alias("same")), "votes")
    different = votes.where("slot < 0").select(*keys, F.col("met").alias("pages"))
    enough = (F.col("met") >= min_pages) & (F.col("met") * 4 >= F.col("pages")) & (F.col("same") >= constant * F.col("met"))
    slots = votes.where("slot >= 0").join(different, keys).where(enough).groupBy(*keys).agg(F.collect_list("slot").alias("slots"))  # at most a page's nodes
    templates = materialize(references.join(slots, keys), "templates")
    near = F.broadcast(templates) if bytes_ <= reference_bytes else templates
    return _extract(rows.join(near, keys, "left"))
