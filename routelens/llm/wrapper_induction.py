"""Main text of web pages by wrapper induction.

Pages of a host are instances of its templates. Every page is parsed to a tree. Pages
of one layout (the tags of the upper elements, repeats told once) that at least
``INSIDE`` different pages share are a group, the other pages of a host join its commonest
layout. Every page is aligned, by simple tree matching, with its group's reference (the
page of the layout with the smallest page_id; pages without an element are none). Each
aligned node votes whether its text is that of the reference; votes are summed for each
(host, layout, reference node) over all pages, pages with the same words counting once.
Nodes constant on nearly all of enough different pages are template; varying slots and
unmatched nodes are content. Blocks that are boilerplate by kind (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are dropped by their
element, role, class or id, or as they aren't shown; a class or id must be such a word as a whole. The header of an
article and headings are no headers of the site. The text is taken from the article elements where
they hold as much of the page's remaining text as what stands outside them, and otherwise from that, or from main: they are teasers then.

Template nodes inside an article must be constant on more pages than others,
lest copies of one article pass for a template. No page is collected: votes are
pre-aggregated rows of numbers, and a template is one row of the size of a
page's outline.

Null or empty html gives an empty text. Pages without a host form one group of
their own; a host's only page has no template. Repeated rows repeat; a null page_id
sorts first. Elements may nest to any depth; where two elements have so many children that comparing each with each
passes ``MATCH_CELLS``, it is done by rows, to the same pairs.
"""

from __future__ import annotations

import html as entities
import math
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, mapped, spread, table, texts_of

#: Least number of different pages that must be aligned, and share that must agree, for a template node.
OUTSIDE, INSIDE, SHARE = 3, 12, 0.9
#: Levels of elements that make a layout; share of the text that makes article elements the main text, and a main element that holds no article.
LEVELS, WEIGHT, MAIN_WEIGHT = 4, 1 / 2, 1 / 3
#: Pairs of children of two elements up to which they are compared one by one; beyond, by rows.
MATCH_CELLS = 4096
#: A table of templates up to this size is sent to all executors; a larger one is joined by host.
BROADCAST_BYTES = 8 << 20

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?\]\]>|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>)", re.S)
_ATTR = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_DROPPED = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "button", "input", "select", "textarea", "menu", "dialog", "svg", "canvas", "object", "embed", "xmp", "noembed", "noframes", "title"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
#: Words that name boilerplate, and words that may stand beside them in a class or id ("site-footer", "share-buttons").
_KINDS = set(
    "ad ads advert adverts advertisement advertisements adbox adslot banner sponsor sponsored promo promos promotion promotions nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist reply replies respond disqus "
    "widget pagination pager toolbar teaser adsbygoogle discussion".split()
)
_BESIDE = set(
    "site page global main top bottom left right primary secondary fixed sticky the user reader readers post article blog item items list links link box block bar area section container wrapper wrap inner outer content "
    "buttons button icons icon media form panel card cards group row col column holder unit slot thread count title heading text privacy policy mobile desktop small large js container-fluid offer offers".split()
)
#: What an article's own class must not say: it is then a comment or a link to another page.
_NO_ARTICLE = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "adverts", "sponsored", "related", "teaser", "promo"}


#: A version or number beside a word; a style that shows nothing.
_NUMBER, _UNSHOWN = re.compile(r"v?\d+"), re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


@lru_cache(maxsize=1 << 14)
def _named(kind: str, article: bool) -> bool:
    """Whether one of the names in a class or id is of these kinds as a whole: every part of it one, or a word that may stand beside."""
    kinds = _NO_ARTICLE if article else _KINDS
    for name in kind.split():
        if name.lower() == "side" and not article:
            return True
        parts = [p for p in re.split(r"[-_]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", name).lower()) if p]
        if any(p in kinds for p in parts) and all(p in kinds or p in _BESIDE or _NUMBER.fullmatch(p) for p in parts):
            return True
    return False


@dataclass
class Node:
    """An element; ``inner`` holds texts and elements in page order."""

    tag: str
    kind: str = ""
    role: str = ""
    hidden: bool = False
    inner: list = field(default_factory=list)

    @property
    def children(self) -> list[Node]:
        return [x for x in self.inner if isinstance(x, Node)]


def parse(page: str) -> Node:
    """The element tree of a page; end tags may be missing, stray ones are passed over."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    held: dict[str, int] = {}  # elements of each tag on the stack, so that stray end tags cost nothing
    low = ""

    def cut(i: int) -> None:
        for x in stack[i:]:
            held[x.tag] -= 1
        del stack[i:]

    while at < end:
        found = _TAG.search(page, at)
        begin = found.start() if found else end
        if begin > at:
            stack[-1].inner.append(entities.unescape(page[at:begin]))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if not held.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                # An inline end tag doesn't close a block that stands between.
                if stack[i].tag in _BLOCK and tag not in _BLOCK:
                    break
            continue
        if tag in _CLOSES_P or tag in _SIBLING:
            over = _SIBLING.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
            stop = _SCOPE.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in over:
                    cut(i)
                    break
                if stack[i].tag in stop or stack[i].tag in _BLOCK:
                    break
        node = Node(tag)
        if attrs := found[3]:
            for name, value in _ATTR.findall(attrs):
                name = name.lower()
                if name in ("class", "id"):
                    node.kind += " " + entities.unescape(value.strip("\"'"))
                elif name == "role":
                    node.role = value.strip("\"'").lower()
                elif name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true" or name == "style" and _UNSHOWN.search(entities.unescape(value.strip("\"'"))):
                    node.hidden = True
        stack[-1].inner.append(node)
        if tag in _VOID or (found[3] or "").endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        if tag in _RAW:
            low = low or page.lower()
            close = low.find("</" + tag, at)
            if len(low) != len(page):  # lower case may be longer; look for the tag itself then
                m = re.compile("</" + tag, re.I).search(page, at)
                close = m.start() if m else -1
            close = end if close < 0 else close
            node.inner.append(page[at:close])
            over = page.find(">", close)
            at = end if over < 0 else over + 1
            continue
        stack.append(node)
        held[tag] = held.get(tag, 0) + 1
    return root


def boilerplate(node: Node, inside: bool = False) -> bool:
    """Not main text by its kind alone; ``inside`` an article, a header is the article's own."""
    if node.hidden or node.role in _ROLES or node.tag in _DROPPED and not (inside and node.tag == "header"):
        return True
    if not node.kind or node.tag in ("html", "body"):
        return False
    kind = _HEADER.sub(" ", node.kind) if inside or _HEADING.fullmatch(node.tag) else node.kind
    return _named(kind, node.tag in ("article", "main"))


#: Names of a header; elements that are headings.
_HEADER, _HEADING = re.compile(r"\S*[Hh]eader\S*"), re.compile("h[1-6]|hgroup")


@dataclass
class Outline:
    """Elements in page order: tag, number of elements below, digest of the texts in their places, whether inside an article, and digest of the shape."""

    tags: list[str] = field(default_factory=list)
    below: list[int] = field(default_factory=list)
    text: list[int] = field(default_factory=list)
    shape: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j <= i + self.below[i]:
            out.append(j)
            j += 1 + self.below[j]
        return out


def outline(root: Node) -> tuple[Outline, list[Node]]:
    """The outline of a tree, and its elements in the same order."""
    out, nodes, open_ = Outline(), [], []
    todo: list[tuple[Node, bool, bool]] = [(root, False, True)]
    while todo:
        node, inside, begins = todo.pop()
        if begins:
            inside = inside or node.tag in ("article", "main")
            open_.append(len(nodes))
            nodes.append(node)
            for column, value in ((out.tags, node.tag), (out.below, 0), (out.text, 0), (out.shape, 0), (out.inside, inside)):
                column.append(value)
            todo.append((node, inside, False))
            todo += [(x, inside, True) for x in reversed(node.children)]
            continue
        i = open_.pop()
        out.below[i] = len(nodes) - i - 1
        j, texts, shapes = i + 1, [], [node.tag]
        for x in node.inner:
            if isinstance(x, Node):
                texts.append(f"\0{out.text[j]}")
                shapes.append(str(out.shape[j]))
                j += 1 + out.below[j]
            elif words := x.split():
                texts.append(" ".join(words))
        out.text[i] = zlib.crc32("\1".join(texts).encode("utf-8", "surrogatepass"))
        out.shape[i] = zlib.crc32("(".join(shapes).encode("utf-8", "surrogatepass"))
    return out, nodes


def layout(o: Outline, levels: int = LEVELS) -> int:
    """Digest of the tags of the upper elements, an element like the one before told once; 0 without an element."""

    def told(i: int, level: int) -> str:
        inner = [told(j, level + 1) for j in o.children(i)] if level < levels else []
        return f"{o.tags[i]}({''.join(x for k, x in enumerate(inner) if not k or x != inner[k - 1])})"

    return zlib.crc32(told(0, 0).encode("utf-8", "surrogatepass")) | 1 << 32 if len(o.tags) > 1 else 0


def _depth(o: Outline) -> int:
    ends, most = [], 0
    for i, n in enumerate(o.below):
        while ends and ends[-1] < i:
            ends.pop()
        ends.append(i + n)
        most = max(most, len(ends))
    return most


def align(a: Outline, b: Outline) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of elements of the largest match that keeps tags, order and ancestry."""
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def same(i: int, j: int) -> list[tuple[int, int]]:
        return [(i + k, j + k) for k in range(a.below[i] + 1)]

    def match(i: int, j: int) -> tuple[int, list[tuple[int, int]]]:
        """Size of the match of two elements, and the pairs of their children."""
        if a.tags[i] != b.tags[j]:
            return 0, []
        if (i, j) in memo:
            return memo[i, j]
        x, y = a.children(i), b.children(j)
        pairs, size = [], 1
        # Children of one shape at either end belong together in some best match.
        while x and y and a.shape[x[0]] == b.shape[y[0]] and a.below[x[0]] == b.below[y[0]]:
            size += 1 + a.below[x[0]]
            pairs.append((x.pop(0), y.pop(0)))
        tail = []
        while x and y and a.shape[x[-1]] == b.shape[y[-1]] and a.below[x[-1]] == b.below[y[-1]]:
            size += 1 + a.below[x[-1]]
            tail.append((x.pop(), y.pop()))
        if len(x) * len(y) > MATCH_CELLS:
            middle = _in_order(a, b, x, y, lambda i, j: match(i, j)[0])
            size += sum(match(i, j)[0] for i, j in middle)
            pairs += middle
        elif x and y:
            best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for p in range(1, len(x) + 1):
                for q in range(1, len(y) + 1):
                    best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + match(x[p - 1], y[q - 1])[0])
            size += best[-1][-1]
            p, q, middle = len(x), len(y), []
            while p and q:
                if best[p][q] == best[p - 1][q]:
                    p -= 1
                elif best[p][q] == best[p][q - 1]:
                    q -= 1
                else:
                    middle.append((x[p - 1], y[q - 1]))
                    p, q = p - 1, q - 1
            pairs += middle[::-1]
        memo[i, j] = size, pairs + tail[::-1]
        return memo[i, j]

    # The match of two elements asks for those of their children: one call for each level.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 2 * min(_depth(a), _depth(b))))
    out, todo = [], [(0, 0)] if a.tags and b.tags else []
    while todo:
        i, j = todo.pop()
        if a.shape[i] == b.shape[j] and a.below[i] == b.below[j]:
            out += same(i, j)
            continue
        out.append((i, j))
        todo += match(i, j)[1]
    return out


def _in_order(a: Outline, b: Outline, x: list[int], y: list[int], worth: Callable[[int, int], int] | None = None) -> list[tuple[int, int]]:
    """The pairs that comparing each child with each gives, a row at a time.

    What a pair is worth depends on its shapes alone, so it is asked for once for two shapes. Every so many rows one is
    kept; the rows between are made again on the way back.
    """
    worth = worth or (lambda i, j: 1 + min(a.below[i], b.below[j]) if a.tags[i] == b.tags[j] else 0)
    kinds, numbers = [], []
    for o, some in ((a, x), (b, y)):
        seen: dict[tuple[int, int], int] = {}
        numbers.append(np.array([seen.setdefault((o.shape[i], o.below[i]), len(seen)) for i in some]))
        first: dict[int, int] = {}
        for i, k in zip(some, numbers[-1].tolist(), strict=True):
            first.setdefault(k, i)
        kinds.append(list(first.values()))
    worths = np.array([[worth(i, j) for j in kinds[1]] for i in kinds[0]], np.int64)

    def row(above: np.ndarray, p: int) -> np.ndarray:
        out = np.zeros_like(above)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + worths[numbers[0][p]][numbers[1]]), out=out[1:])
        return out

    step = math.isqrt(len(x))
    kept = [np.zeros(len(y) + 1, np.int64)]
    for begin in range(0, len(x) - step, step):
        last = kept[-1]
        for p in range(begin, begin + step):
            last = row(last, p)
        kept.append(last)
    out, q = [], len(y)
    for k in reversed(range(len(kept))):
        begin, rows = k * step, [kept[k]]
        for p in range(begin, min(len(x), begin + step)):
            rows.append(row(rows[-1], p))
        p = len(rows) - 1
        while p and q:
            if rows[p][q] == rows[p - 1][q]:
                p -= 1
            elif rows[p][q] == rows[p][q - 1]:
                q -= 1
            else:
                out.append((x[begin + p - 1], y[q - 1]))
                p, q = p - 1, q - 1
    return out[::-1]


def pack(o: Outline) -> str:
    """An outline as one string."""
    return "\n".join(f"{t} {n} {x} {s} {int(i)}" for t, n, x, s, i in zip(o.tags, o.below, o.text, o.shape, o.inside, strict=True))


def unpack(s: str) -> Outline:
    out = Outline()
    for line in s.split("\n") if s else ():
        t, n, x, shape, inside = line.split(" ")
        for column, value in ((out.tags, t), (out.below, int(n)), (out.text, int(x)), (out.shape, int(shape)), (out.inside, inside == "1")):
            column.append(value)
    return out


def _blocks(starts: list[Node], off: set[int], inside: bool = False) -> list[str]:
    """Texts of the blocks below these elements, boilerplate and the elements ``off`` (by id) left out."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    for start in starts:
        todo: list[Node | str | None] = [start]  # None ends a block
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                line.append(x)
            elif x.tag == "br":
                line.append(" ")
            elif not boilerplate(x, inside) and id(x) not in off:
                if x.tag in _BLOCK:
                    close()
                    todo.append(None)
                todo += reversed(x.inner)
        close()
    return blocks


def _outermost(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a tag, in page order, that don't stand in boilerplate."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if not boilerplate(x):
            if x.tag == tag:
                found.append(x)
            else:
                todo += reversed(x.children)
    return found


def main_text(root: Node, template: set[int], nodes: list[Node]) -> str:
    """Blocks of the main text, template and boilerplate left out."""
    off = {id(nodes[i]) for i in template}
    starts = _outermost(root, "article")
    blocks = _blocks(starts, off, True)
    rest = _blocks([root], off | {id(x) for x in starts})
    inside, outside = (sum(map(len, x)) for x in (blocks, rest))
    if inside and inside >= WEIGHT * (inside + outside):
        return "\n\n".join(blocks)
    # Article elements are teasers here: what stands outside them is the text.
    off |= {id(x) for x in starts}
    blocks = _blocks(_outermost(root, "main"), off)
    return "\n\n".join(blocks if blocks and sum(map(len, blocks)) >= MAIN_WEIGHT * outside else rest)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _outlines(pages: DataFrame) -> DataFrame:
    """The pages with host, layout and outline, their html pressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                pages = texts_of(own["html"])
                found = [outline(parse(h))[0] for h in pages]
                blobs = [press.compress(h.encode("utf-8", "surrogatepass")) for h in pages]
                columns = [own["host"], own["page_id"], own["url"], pa.array(blobs, pa.binary()), pa.array(map(layout, found), pa.int64()), pa.array(map(pack, found), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["host", "page_id", "url", "blob", "layout", "outline"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "page_id", "url", "html")
    return rows.transform(mapped, run, "host string, page_id long, url string, blob binary, layout long, outline string")


def _votes(different: DataFrame) -> DataFrame:
    """Aligned and equal pages for each host, group and reference node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, Outline] = (None, Outline())
        for batch in batches:
            votes: dict[tuple[str, int, int], list[int]] = {}
            for host, group, ref, own in zip(*(batch[c].to_pylist() for c in ("host", "group", "reference", "outline")), strict=True):
                if last[0] != ref:
                    last = ref, unpack(ref)
                reference, page = last[1], unpack(own)
                for i, j in align(reference, page):
                    if i and not (reference.tags[i] == "body" or reference.tags[i] == "html"):
                        vote = votes.setdefault((host, group, i), [0, 0])
                        vote[0] += 1
                        vote[1] += reference.text[i] == page.text[j]
            rows = [(*k, *v) for k, v in votes.items()]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "group", "node", "aligned", "equal"])

    votes = different.select("host", "group", "reference", "outline").transform(mapped, run, "host string, group long, node int, aligned long, equal long")
    return votes.groupBy("host", "group", "node").agg(F.sum("aligned").alias("aligned"), F.sum("equal").alias("equal"))


def induce(outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The group of each (host, layout); and host, group, reference outline, and constant nodes, a row for each group with a template."""
    first = F.min_by("outline", F.struct("page_id", "outline"))
    layouts = outlines.where("layout <> 0").groupBy("host", "layout").agg(first.alias("reference"), F.count_distinct("outline").alias("n"), F.min(F.struct("page_id")).alias("least"))
    layouts = keep(layouts, "layouts")
    main = layouts.groupBy("host").agg(F.min_by("layout", F.struct(-F.col("n"), "least", "layout")).alias("main"), F.sum("n").alias("pages")).where(F.col("pages") >= OUTSIDE)
    groups = layouts.join(main, "host").select("host", "layout", F.when(F.col("n") >= INSIDE, F.col("layout")).otherwise(F.col("main")).alias("group"))
    groups = keep(groups, "groups")
    references = layouts.withColumnRenamed("layout", "group").join(groups.select("host", "group").distinct(), ["host", "group"]).select("host", "group", "reference")
    # Pages of a host with the same outline, words and all, vote once.
    different = outlines.select("host", "layout", "outline").distinct().join(groups, ["host", "layout"]).join(references, ["host", "group"])
    constant = (F.col("equal") >= F.col("aligned") * SHARE) & (F.col("aligned") >= OUTSIDE)
    nodes = _votes(different).where(constant).groupBy("host", "group").agg(F.collect_list(F.struct("node", "aligned")).alias("nodes"))
    return groups, references.join(nodes, ["host", "group"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every page."""
    outlines = keep(_outlines(spread(pages.select("page_id", "url", "html"))), "outlines")
    groups, templates = induce(outlines)
    templates = keep(templates, "templates")
    size = templates.agg(F.sum(F.length("reference") + 64 * F.size("nodes"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        templates = F.broadcast(templates)
    both = outlines.drop("outline").join(groups, ["host", "layout"], "left").join(templates, ["host", "group"], "left").select("page_id", "url", "blob", "reference", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        last: tuple[str | None, Outline] = (None, Outline())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                texts = []
                for blob, ref, nodes in zip(*(own[c].to_pylist() for c in ("blob", "reference", "nodes")), strict=True):
                    root = parse(unpress.decompress(blob).decode("utf-8", "surrogatepass"))
                    template: set[int] = set()
                    elements: list[Node] = []
                    if ref and nodes:
                        if last[0] != ref:
                            last = ref, unpack(ref)
                        constant = {x["node"] for x in nodes if x["aligned"] >= (INSIDE if last[1].inside[x["node"]] else OUTSIDE)}
                        if constant:
                            page_outline, elements = outline(root)
                            template = {j for i, j in align(last[1], page_outline) if i in constant and last[1].text[i] == page_outline.text[j]}
                    texts.append(main_text(root, template, elements))
                yield pa.RecordBatch.from_arrays([own["page_id"], own["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return both.transform(mapped, run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
