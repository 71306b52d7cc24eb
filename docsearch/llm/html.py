"""Main text of web pages by site style trees.

All pages of a host are merged into one tree, whose nodes are elements by their path of tags and first classes (pages with and
without an ``article`` or ``main`` are separate templates).  Its statistics count *contents*, not pages: pages that share the
minimum hash of their word triples are one, so copies of an article say nothing about what it is.

* Content importance of a node with text: the collision entropy -log R of its blocks, to the base ``REPEATS``, 1 at most.  R is the
  chance that a block's text stands at the same node of another page of the host: 1 for what all pages have, 1/60 for
  a pool of sixty adverts, next to 0 for articles.
* Presentation importance of a node with element children: the entropy of its child sequences to the base of the pages.
* A branch has the mean content importance of the text below it (by characters), blended with its presentation importance.

Marks (elements, classes, ids, roles) are a prior: they give each node ``PAIRS`` pseudo-pairs of pages with the rate ``RATE`` of their
kind, so that few pages leave the decision to them, and the importance ``NEED`` that a node must reach to stay; a branch that does not is
removed from each page.  So furniture stays where some hundred pages show that its texts are all different, and what no
mark names goes where pages repeat it, inside an article too if nearly all pages have it.  Forms, hidden elements and reader comments, whose
texts differ by their nature, always go.  A page that would lose all its text keeps what its marks allow.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch.llm import textkit
from docsearch.llm.common import arrow_batches, materialise, small, tidy
from docsearch.llm.urls import parts

#: A text that one page in so many repeats has full importance; the share of content importance in a branch's.
REPEATS, WEIGHT = 1000.0, 0.8
#: Kinds of nodes: furniture by its marks, outside of the page's article, of a page without one, in the article, on the way to it.
FURNISHED, OUTSIDE, PLAIN, ARTICLE, PATH = range(5)
#: By kind: the prior chance of a repeat, and the importance that a node with text and one without must reach.
PAIRS = 100.0
RATE = (0.1, 0.05, 0.005, 0.001, 0.001)
NEED = ((1.0, 1.0), (1.0, 1.0), (0.7, 0.4), (0.1, 0.1), (0.0, 0.0))
#: Elements nested deeper belong to the node at this depth.
DEPTH = 64
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|title|svg|math|xmp|noembed|noframes)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-z/!?][^>]*\Z",
    re.I | re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ARTICLE = re.compile(r"<(?:article|main)[\s/>]", re.I)
#: Fixed values of HTML: elements that start and end a block, that have no end tag, that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_CLOSE = frozenset("button caption td th tr tbody thead tfoot option optgroup legend summary body html head".split())
_SIBLINGS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
#: Elements and names of page furniture, and of what is never main text.
FURNITURE = frozenset("nav footer aside menu".split())
NEVER = frozenset("head form select button object canvas dialog search audio video map fieldset".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations pagination pager widget widgets toolbar skip copyright".split()
)
NEVER_NAMES = frozenset("comment comments respond reply replies disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary alert menu menubar toolbar".split())
NEVER_ROLES = frozenset("search dialog alertdialog form".split())


def _look(tag: str, attrs: str, inside: bool) -> tuple[bool, bool, str]:
    """(is never main text, is furniture, first class)."""
    never, bad, first = tag in NEVER, tag in FURNITURE or (tag == "header" and not inside), ""
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "style":
                never |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name in ("hidden", "aria-hidden"):
                never |= name == "hidden" or value.lower() == "true"
            elif name == "role":
                never |= value.lower() in NEVER_ROLES
                bad |= value.lower() in ROLES
            else:
                words = {w.lower() for w in _WORD.findall(value)}
                never |= bool(words & NEVER_NAMES)
                bad |= bool(words & NAMES) or ("header" in words and not inside and tag not in ("h1", "h2"))
                if name == "class" and value:
                    first = value.split()[0] if value.split() else ""
    return never, bad, first


def _node(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above} {label}") >> 1


class Element:
    """An open element: its tag, node and the nodes above it, its kind, whether it is never text or removed, its block children."""

    __slots__ = ("tag", "node", "above", "kind", "never", "out", "children")

    def __init__(self, tag: str, node: int, above: tuple, kind: int, never: bool, out: bool) -> None:
        self.tag, self.node, self.above, self.kind, self.never, self.out, self.children = tag, node, above, kind, never, out, []


def parse(html: str, host: str = "", low: frozenset = frozenset(), shapes: dict | None = None):
    """(node, kind, removed, text) of each block in page order, without what is never text; shapes: node to its (kind, nodes above, child tags)."""
    whole = _ARTICLE.search(html) is None
    root = _node(int(whole), host)
    stack = [Element("", root, (), PATH, False, False)]
    text: list[str] = []
    out = []

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            top = stack[-1]
            if joined and not top.never:
                out.append((top.node, top.kind, top.out, joined))

    def pop(n: int):
        while len(stack) > n:
            e = stack.pop()
            if e.tag not in BLOCKS:
                stack[-1].children += e.children
            if shapes is not None and not e.never and e.node != stack[-1].node:
                shape = shapes.setdefault(e.node, [e.kind, e.above, []])
                shape[0] = max(shape[0], e.kind)
                shape[2] += e.children

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCKS:
                flush()
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    if n < len(stack) - 1:
                        flush()
                    pop(n)
                    break
                if stack[n].tag in ("article", "main", "table", "body") and tag not in ("html", "body", "article", "main", "table", "div", "section"):
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if tag not in _NO_CLOSE:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == "p":
                        pop(n)
                        break
                    if stack[n].tag in BLOCKS:
                        break
            if tag in _SIBLINGS:
                close, stop = _SIBLINGS[tag]
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag in stop:
                        break
                    if stack[n].tag in close.split():
                        pop(n)
                        break
        top = stack[-1]
        if block:
            top.children.append(tag)
        if tag in VOID or (m[4] and m[4].endswith("/") and not block):
            continue
        article = tag in ("article", "main")
        never, bad, first = _look(tag, m[4], article or top.kind == ARTICLE)
        if not block and (never or bad) and not top.never:
            flush()
        kind = FURNISHED if bad or top.kind == FURNISHED else ARTICLE if article or top.kind == ARTICLE else PLAIN if whole else OUTSIDE
        if tag in ("html", "body"):
            kind = PATH
        elif kind == ARTICLE and top.kind != ARTICLE:
            for e in stack:
                e.kind = PATH if e.kind in (OUTSIDE, PLAIN) else e.kind
        node, above = top.node, top.above
        if (block or bad) and len(above) < DEPTH:
            node, above = _node(node, f"{tag}.{first}{'!' if bad else ''}"), (*above, node)
        stack.append(Element(tag, node, above, kind, top.never or never, top.out or node in low))
    if at < len(html):
        text.append(unescape(html[at:]) if "&" in html[at:] else html[at:])
    flush()
    pop(1)
    return out


def main_text(html: str | None, host: str = "", low: frozenset = frozenset(), high: frozenset = frozenset()) -> str:
    """The text of a page: by its marks alone, or with the host's branches to remove and furniture to keep."""
    found = parse(html or "", host, low)
    any_article = any(kind == ARTICLE for _, kind, _, _ in found)
    kept = [kind == ARTICLE if any_article else kind != FURNISHED for _, kind, _, _ in found]
    stays = [(mine or node in high) and not gone for (node, _, gone, _), mine in zip(found, kept, strict=True)]
    return "\n".join(x[3] for x, stay in zip(found, stays if any(stays) else kept, strict=True) if stay)


_ROWS = "node long, value long, key long, n_chars int, kind byte, above array<long>, host string"


def _rows(batches):
    """A row for each block text of a page, and one for each node (kind not null) with the hash of its child tags (0: none).

    The nodes above and the host go with the first such row of a task only.
    """
    names, kinds = [x.split()[0] for x in _ROWS.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.list_(pa.int64()), pa.string()]
    seen: set[int] = set()
    for batch in batches:
        found, bodies = [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shapes: dict = {}
            blocks = parse(html or "", host, shapes=shapes)
            inside = [t for _, k, _, t in blocks if k == ARTICLE] or [t for _, k, _, t in blocks if k != FURNISHED] or [t for *_, t in blocks]
            found.append((host, blocks, shapes))
            bodies.append("\n".join(inside))
        keys = [np.zeros(0, np.int64)]
        for i, j, h, off in textkit.shingle_sets(pa.array(bodies, pa.string()), 3):
            some = np.flatnonzero(np.diff(off))
            least = np.zeros(j - i, np.uint64)
            if len(some):
                least[some] = np.minimum.reduceat(h, off[some])
            keys.append((least >> np.uint64(1)).astype(np.int64))
        rows = []
        for (host, blocks, shapes), key in zip(found, np.concatenate(keys).tolist(), strict=True):
            rows += [(n, v, key, size, None, None, None) for n, v, size in {(n, xxhash.xxh3_64_intdigest(t) >> 1, len(t)) for n, _, _, t in blocks}]
            for n, (kind, above, tags) in shapes.items():
                new = n not in seen
                seen.add(n)
                rows.append((n, xxhash.xxh3_64_intdigest(" ".join(tags)) >> 1 if tags else 0, key, 0, kind, above if new else None, host if new else None))
        if len(seen) > 1 << 18:
            seen.clear()
        for k in range(0, len(rows), 1 << 14):
            columns = zip(*rows[k : k + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, kind, contents, leaf, content, presentation, importance, stays): the merged trees; pages: (host, html).

    ``contents`` counts the different pages that have the node, ``leaf`` tells that no element block is below it.
    """
    rows = materialise(pages.select("host", "html").mapInArrow(tidy(_rows), _ROWS), "nodes")
    texts = rows.where("kind is null").groupBy("node", "value").agg(F.countDistinct("key").alias("n"), F.min("n_chars").alias("n_chars"))
    texts = texts.groupBy("node").agg(F.sum("n").alias("shown"), F.sum(F.col("n") * (F.col("n") - 1)).alias("met"), F.sum(F.col("n") * F.col("n_chars")).alias("chars"))
    shaped = rows.where("kind is not null")
    named = shaped.groupBy("node").agg(F.max("kind").alias("kind"), F.max("above").alias("above"), F.max("host").alias("host"))
    shapes = shaped.groupBy("node", "key").agg(F.max("value").alias("value")).groupBy("node", "value").agg(F.count("*").alias("n"))
    shapes = shapes.groupBy("node").agg(F.sum("n").alias("contents"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), (F.max("value") == 0).alias("leaf"))
    even = F.when(F.col("contents") > 1, 1 - F.col("nlogn") / F.col("contents") / F.log("contents")).otherwise(0.0)
    rate = F.element_at(F.array(*map(F.lit, RATE)), F.col("kind").cast("int") + 1)
    repeat = (F.coalesce("met", F.lit(0)) + PAIRS * rate) / (F.coalesce("shown", F.lit(0)) * (F.col("contents") - 1) + PAIRS)
    nodes = named.join(shapes, "node").join(texts, "node", "left").withColumn("presentation", even).withColumn("own", F.least(F.lit(1.0), -F.log(repeat) / F.log(F.lit(REPEATS))))
    nodes = materialise(nodes, "node-statistics")
    below = nodes.where("chars > 0").select(F.explode(F.concat("above", F.array("node"))).alias("node"), "own", "chars")
    content = below.groupBy("node").agg((F.sum(F.col("own") * F.col("chars")) / F.sum("chars")).alias("content"))
    out = nodes.join(content, "node").withColumn("importance", F.when(F.col("leaf"), F.col("content")).otherwise(WEIGHT * F.col("content") + (1 - WEIGHT) * F.col("presentation")))
    need = F.element_at(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in NEED)), F.col("kind").cast("int") + 1)
    need = F.when(F.col("leaf"), need[0]).otherwise(need[1])
    return out.withColumn("stays", F.col("importance") > need - 1e-9).select("host", "node", "kind", "contents", "leaf", "content", "presentation", "importance", "stays")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null and empty pages have an empty text; a null url is the host of the empty name; repeated rows get repeated
    results and are one content of the tree, other columns are ignored, an empty table gives an empty result.  n_chars counts code points.
    A very long page is parsed as a whole.
    """
    arrow_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), parts(url)[0].alias("host"))
    tree = style_tree(src)
    # what differs from the marks' own decision: branches to remove, nodes of furniture to keep
    turned = tree.where((F.col("kind") <= OUTSIDE) == F.col("stays")).select("host", (F.when(F.col("stays"), -1 - F.col("node")).otherwise(F.col("node"))).alias("node"))
    turned = materialise(turned.groupBy("host").agg(F.collect_set("node").alias("turned")), "turned")
    rows = src.join(small(turned), "host", "left").select("page_id", "url", "html", "host", "turned")

    def run(batches):
        last, low, high = None, frozenset(), frozenset()
        for batch in batches:
            texts = []
            for html, host, found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if found != last:
                    last, low, high = found, frozenset(x for x in found or () if x >= 0), frozenset(-1 - x for x in found or () if x < 0)
                texts.append(main_text(html, host, low, high))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
