"""Main text of HTML pages by composite text density.

A tolerant parser builds the element tree (void elements, raw-text elements, implied ends of p, li, td ...).
For each node the link-adjusted density is

    C / T * log(C * LT' / LC' ...),  written out below in ``density``

with C characters, T tags, LC link characters and LT link tags below it. The density sum of a node adds up the
densities of its children. The node with the greatest density sum lies in the main content; the least density
on its path to the body is the threshold. Of every node of the body at or above the threshold the subtree with the
greatest density sum is content, so text in several blocks is taken whole. Where most of the content lies in
article or main elements, they break ties: content beside them goes, and an article with content in it is taken whole.

What is left out before anything is counted: elements that hold no article text by their kind (nav, footer, script
...), and those whose class, id or role says so, or forms. The latter are believed only while at least
``BELIEVED`` of the page's text lies outside; else the largest of them, if it holds half of the text, counts as a wrapper and
only what is marked inside it goes. Lists that consist of links are left out as well.

Text: character references are decoded, runs of white space in a block become one space, blocks are trimmed
and joined by one line feed. Nothing is capped.

Defined cases: null or empty html has no text; unclosed and misnested tags are repaired; a page without body
is its own body; markup that does not end is text; parsing takes linear time; repeated rows get equal results;
an empty table gives an empty result; other columns pass, but for those named like a result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, ship

ship(__name__)

#: Kinds of elements, from the HTML standard. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "caption"}
#: A start tag of the key ends an open element of the value, looking up to the nearest boundary.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOUNDARY = frozenset("table ul ol dl select body html article section div main aside nav blockquote".split())
DROPPED = frozenset("head nav header footer aside button select option menu dialog svg math canvas object script style noscript iframe template textarea title input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words in class or id that mark boilerplate; compared with the words and word pairs of the attribute.
MARKS = frozenset(
    """ad ads adv advert advertisement advertising adbox adslot banner promo promoted promotion sponsor sponsored sponsors
    nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead topbar footer
    sidebar aside rail widget widgets related recommended recommendations trending popular more-stories also-read
    comment comments commentlist disqus replies respond notice notices cookie cookies consent gdpr alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social follow toolbar tags form search copyright disclaimer""".split()
)

#: Words that make a class tell a container's state, such as has-sidebar or no-ads.
STATES = frozenset("has have no not with without is enabled disabled on off show hide hidden open closed active".split())
BELIEVED = 0.1

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "parent", "skip", "marked", "chars", "tags", "link_chars", "link_tags", "score", "total")

    def __init__(self, tag: str, parent: Node | None, skip: bool, marked: bool = False):
        self.tag, self.parent, self.skip, self.marked = tag, parent, skip, marked
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.score = self.total = 0.0


def marked(tag: str, attributes: str) -> bool:
    """Whether an element's attributes (or its being a form) say that it is no part of the article."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").strip()
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in WORD.findall(token)]
                if not STATES.isdisjoint(words):
                    continue
                if any(w in MARKS for w in words) or token.lower() in MARKS or "-".join(words) in MARKS:
                    return True
    return False


def unseen(attributes: str) -> bool:
    """Whether an element is not shown."""
    return any(name.lower() == "hidden" or name.lower() == "aria-hidden" and value.strip("\"'").strip().lower() == "true" for name, value in ATTRIBUTE.findall(attributes))


class Scanner:
    """Finds where tags end. A quote counts behind an equals sign, if its partner and the tag's end follow."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.broken = False

    def end(self, at: int) -> int:
        """The position of the > that ends a tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last:
            return -1
        close = self.page.find(">", at)
        if self.broken:
            return close
        start = at
        while True:
            equals = self.page.find("=", start, close)
            if equals < 0:
                return close
            start = equals + 1
            while start < close and self.page[start].isspace():
                start += 1
            q = self.page[start]
            if q in "\"'":
                if start >= self.quotes[q]:  # never closed: the tag ends at the next >
                    return close
                start = self.page.find(q, start + 1) + 1
                if start > close:
                    first, close = close, self.page.find(">", start) if start <= self.last else -1
                    if close < 0:
                        self.broken = True  # from here on quotes mean nothing, so no stretch is looked at twice
                        return first


def parse(page: str) -> Node:
    """The element tree; text parts stay undecoded."""
    root = Node("html", None, False)
    open_ = root
    at, end = 0, len(page)
    scan, lower = Scanner(page), None
    opened: Counter[str] = Counter()  # of the elements that are open
    unmatched: set[tuple[int, str]] = set()  # end tags that were seen to close nothing, by the element they were met in

    def close(to: Node) -> Node:
        node = open_
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent  # type: ignore[assignment]
        return to

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            open_.parts.append(page[at:])
            break
        if lt > at:
            open_.parts.append(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith("<![CDATA[", lt) and (stop := page.find("]]>", lt)) >= 0:
            open_.parts.append(page[lt + 9 : stop])
            at = stop + 3
            continue
        m = TAG.match(page, lt)
        if m is None or (stop := scan.end(m.end())) < 0:
            if m is None and page[lt + 1 : lt + 2] in ("!", "?") and lt < scan.last:
                at = page.find(">", lt) + 1
                continue
            open_.parts.append("<")
            at = lt + 1
            continue
        at = stop + 1
        tag, attributes = m.group(2).lower(), page[m.end() : stop]
        if m.group(1):
            if not opened[tag] or (id(open_), tag) in unmatched:
                continue
            node: Node | None = open_
            while node is not None and node.tag != tag:
                if node.tag in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                open_ = close(node.parent)
            else:
                unmatched.add((id(open_), tag))
            continue
        if tag in ("html", "body") and open_ is root:
            if tag == "html":
                continue
        elif tag == "html" or tag == "body":
            continue
        if tag in CLOSES_P and opened["p"]:
            node = open_
            while node is not None and node.tag not in BOUNDARY and node.tag != "td" and node.tag != "p":
                node = node.parent
            if node is not None and node.tag == "p" and node.parent is not None:
                open_ = close(node.parent)
        if tag in IMPLIED and any(opened[x] for x in IMPLIED[tag]):
            ends, node, top = IMPLIED[tag], open_, None
            while node is not None and (node.tag in ends or node.tag not in BOUNDARY):
                if node.tag in ends:
                    top = node
                node = node.parent
            if top is not None and top.parent is not None:
                open_ = close(top.parent)
        if tag in HEADINGS and open_.tag in HEADINGS and open_.parent is not None:
            open_ = close(open_.parent)
        child = Node(tag, open_, open_.skip or tag in DROPPED or (bool(attributes) and unseen(attributes)), marked(tag, attributes))
        open_.parts.append(child)
        if tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == end else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            stop = lower.find(f"</{tag}", at)
            if stop < 0:
                stop = end
            child.parts.append(page[at:stop])
            shut = page.find(">", stop)
            at = end if shut < 0 else shut + 1
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in ("p", "div", "a", "b", "span", "article") and tag not in VOID:
            open_ = child
            opened[tag] += 1
    return root


def settle_marks(root: Node) -> None:
    """Turns marks into ``skip``, where the page's other text bears them out."""
    nodes = _nodes(root)
    text: dict[Node, int] = {}  # outside links
    free: dict[Node, int] = {}  # and outside marked elements
    for node in reversed(nodes):
        own = sum(len(p) - p.count(" ") for p in node.parts if isinstance(p, str) and p.strip())
        below = [p for p in node.parts if isinstance(p, Node) and not p.skip]
        text[node] = 0 if node.tag == "a" else own + sum(text[p] for p in below)
        free[node] = 0 if node.tag == "a" else own + sum(free[p] for p in below if not p.marked)
    total, outside = text[root], free[root]
    outer = _outermost(root)
    while outer and outside < BELIEVED * total:
        largest = max(outer, key=lambda n: text[n])
        if 2 * text[largest] < total:
            break
        largest.marked = False
        outside += free[largest]
        outer = _outermost(largest)  # the others are too small to matter
    for node in nodes:
        node.skip = node.skip or node.marked or node.parent is not None and node.parent.skip


def _outermost(top: Node) -> list[Node]:
    """The marked elements below ``top`` that lie in no other."""
    out, stack = [], [p for p in top.parts if isinstance(p, Node) and not p.skip]
    while stack:
        node = stack.pop()
        if node.marked:
            out.append(node)
        else:
            stack += [p for p in node.parts if isinstance(p, Node) and not p.skip]
    return out


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def measure(root: Node) -> Node | None:
    """Counts, densities and density sums of all nodes that are not boilerplate; the body."""
    nodes = [n for n in _nodes(root) if not n.skip]
    for node in reversed(nodes):
        link = node.tag == "a"
        for p in node.parts:
            if isinstance(p, str):
                node.chars += len(p) - p.count(" ") if p.strip() else 0
            elif not p.skip:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags + (p.tag == "a")
        if link:
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), root)
    for node in nodes:
        node.score = density(node, body)
    for node in nodes:
        node.total = sum(p.score for p in node.parts if isinstance(p, Node) and not p.skip)
    return body


def density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, weighed by how little of the text and tags are links."""
    if not node.chars:
        return 0.0
    c, t = node.chars, max(1, node.tags)
    lc, lt = max(1, node.link_chars), max(1, node.link_tags)
    free = max(1, c - node.link_chars)
    base = math.log(c / free * lc + body.link_chars / max(1, body.chars) * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1e-9), base)  # the base is above ln(e + 1)


def main_nodes(root: Node) -> list[Node]:
    """The subtrees with the main text, in the order of the page; none lies in another."""
    settle_marks(root)
    body = measure(root)
    assert body is not None
    nodes = [n for n in _nodes(body) if not n.skip]
    best = max(nodes, key=lambda n: n.total)
    threshold, node = best.score, best
    path = {best}
    while node is not body and node.parent is not None:
        node = node.parent
        path.add(node)
        threshold = min(threshold, node.score)
    for n in nodes:
        if n not in path and n.tag in BLOCK and n.link_tags > 2 and 10 * n.link_chars > 7 * n.chars:
            n.skip = True  # a list of links
    # The subtree of the greatest sum below each node, the outermost of equal ones.
    greatest: dict[Node, Node] = {}
    for node in reversed(nodes):
        below = [greatest[p] for p in node.parts if isinstance(p, Node) and not p.skip and p in greatest]
        greatest[node] = max([node, *below], key=lambda n: n.total)
    content = {text_block(greatest[n], body) for n in nodes if n.chars and n.score >= threshold}
    # The list, table or paragraph with the greatest sum stands for the block that holds it.
    while best is not body and best.parent is not None and best.tag not in ("div", "section", "td", "body", "article", "main", "form"):
        best = best.parent
    content.add(best)
    # Most of a block's text being content, its short paragraphs are as well.
    path = _ancestors(best)
    held: dict[Node, int] = {}
    for node in reversed(nodes):
        if not node.skip:
            held[node] = node.chars if node in content else sum(held.get(p, 0) for p in node.parts if isinstance(p, Node))
            if node not in path and node.tag in BLOCK and (node.tag == "article" and held[node] or node.tag != "article" and 2 * held[node] > node.chars):
                content.add(node)
                held[node] = node.chars
    chosen = _topmost(body, content)
    own = [n for n in chosen if any(a.tag in ("article", "main") for a in (n, *_ancestors(n)))]
    inside = [m for n in chosen if n not in own for m in _articles(n)]
    if 2 * sum(n.chars for n in (*own, *inside)) >= sum(n.chars for n in chosen):
        return _topmost(body, {*own, *inside})
    return chosen


def _ancestors(node: Node) -> set[Node]:
    out = set()
    while node.parent is not None:
        node = node.parent
        out.add(node)
    return out


def _topmost(body: Node, wanted: set[Node]) -> list[Node]:
    """The nodes of ``wanted`` that lie in no other, in the order of the page."""
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        if node in wanted:
            out.append(node)
        else:
            stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.skip]
    return out


def _articles(top: Node) -> list[Node]:
    """The outermost article and main elements below ``top``."""
    return _topmost(top, {n for n in _nodes(top) if n.tag in ("article", "main") and not n.skip})


def text_block(node: Node, body: Node) -> Node:
    """The paragraph, cell or heading around an inline element, so that no text is cut inside; else the node."""
    top = node
    while top.tag not in BLOCK and top is not body and top.parent is not None:
        top = top.parent
    return node if top is body or any(isinstance(p, Node) and p.tag in BLOCK for p in top.parts) else top


def extract(page: str | None) -> str:
    if not page:
        return ""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = SPACE.sub(" ", _html.unescape("".join(line))).strip()
            line.clear()
            if text:
                blocks.append(text)

    stack: list[Node | str | None] = [*reversed(main_nodes(parse(page)))]
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif not part.skip:
            block = part.tag in BLOCK
            if block:
                end()
                stack.append(None)
            elif part.tag == "br":
                line.append("\n")
            stack += reversed(part.parts)
    end()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the html replaced by the main text and n_chars, its code points."""
    bounded_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, text, "n_chars")]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch[html].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, text, "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)
