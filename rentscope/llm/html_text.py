"""HTML extraction by composite text density.

Every DOM node gets its link-adjusted characters per tag and the sum of its children's densities. The node of the largest sum is the core of
the article; the least density on the path from it up to the body is the threshold, and every node that reaches it contributes its own
subtree of the largest sum, so that an article in several parts stays whole. Elements that are never article text (scripts, navigation,
forms, named adverts, notices, comments) are taken out first.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.words import texts_of

#: What follows a tag's name: a quote opens a value only after "=", and one that is never closed is a character like others. Nothing is tried twice.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+|))*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(script|style|textarea|noscript|template|svg|iframe|title)(?![^\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: A start tag ends an open element of these names that is not inside one of the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "body": (("head",), ()),
}
IN_P = frozenset("table td th caption button object applet marquee html body".split())
NEVER = frozenset("head nav footer aside button select dialog canvas audio video menu".split())
#: Never article text either, unless they hold most of the page or an article.
WRAPPERS = frozenset("form fieldset label object".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words in a class or id that tell what is not the article, and whole names that do so where the word alone would not.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies "
    "consent gdpr notice notification alert banner popup modal overlay comment comments reply replies disqus share sharing social newsletter subscribe signup login "
    "related recommended pagination pager skip".split()
)
#: Of these, words that name other texts than the article: what holds them is not the page's layout.
OTHERS = frozenset("comment comments reply replies disqus related recommended".split())
#: Whole class names of an article that is a reader's comment.
COMMENT_ARTICLES = frozenset("comment comment-body comment-content comment-item comment-text reply reply-body".split())
WHOLE_NAMES = frozenset("header site-header page-header masthead topbar site-footer page-footer".split())
KEPT = frozenset("html body main article".split())


class Node:
    __slots__ = ("parent", "tag", "text", "children", "out", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, parent: Node | None, tag: str):
        self.parent, self.tag = parent, tag
        self.children: list[Node | str] = []
        self.out = 0  # 1: never article text, 2: by its name or as a wrapper that may hold the page, 3: named as another text
        self.chars = self.tags = self.link_chars = self.link_tags = 0


def _left_out(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in NEVER or (tag == "header" and not inside_article):
        return 1
    out = 2 if tag in WRAPPERS else 0
    if not attributes or (tag in KEPT and tag != "article"):
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if tag == "article":
            if name in ("class", "id") and not COMMENT_ARTICLES.isdisjoint(value.split()):
                out = 3
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 1
        if name == "role" and value in ROLES:
            if value != "form":
                return 1
            out = max(out, 2)
        if name in ("class", "id"):
            words = re.split(r"[^a-z]+", value)
            if not OTHERS.isdisjoint(words):
                out = 3
            elif not WHOLE_NAMES.isdisjoint(value.split()) or not NAMED.isdisjoint(words):
                out = max(out, 2)
    return out


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order. Wrong nesting is mended as far as it matters for blocks: ends are implied, strays ignored."""
    root = Node(None, "#root")
    nodes, top, at = [root], root, 0

    def close(names: tuple[str, ...], limits: Iterable[str]) -> None:
        nonlocal top
        node = top
        while node is not root and node.tag not in names:
            if node.tag in limits:
                return
            node = node.parent
        if node is not root:
            top = node.parent

    articles = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "article":
                articles = max(0, articles - 1)
            if tag not in VOID:
                close((tag,), ("table",) if tag not in ("table", "body", "html", "article", "main", "div", "section") else ())
            elif tag == "br":
                top.children.append(Node(top, "br"))
                nodes.append(top.children[-1])
            continue
        if tag in ENDS:
            close(*ENDS[tag])
        elif tag not in INLINE and tag not in VOID and tag != "html":
            close(("p",), IN_P)
        node = Node(top, tag)
        node.out = _left_out(tag, m[4], articles > 0)
        top.children.append(node)
        nodes.append(node)
        if tag == "article":
            articles += 1
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            top = node
    if at < len(page):
        top.children.append(re.sub(r"</\Z", "", page[at:]))
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    """Characters, tags and link shares of every subtree, without what is left out; then densities and their sums."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            elif not child.out:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    whole = nodes[0]
    share = whole.link_chars / max(1, whole.chars)
    for node in reversed(nodes):
        chars, tags, links, link_tags = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = log(chars / max(1, chars - node.link_chars) * links + share * chars + e)
        node.density = chars / tags * max(0.0, log(chars / links * tags / link_tags) / log(base)) if chars else 0.0
        parts = [c for c in node.children if not isinstance(c, str) and not c.out and c.chars]
        node.total = sum(c.density for c in parts) if parts else node.density
        node.best = node
        for child in reversed(parts):  # ties go to the outer, then to the earlier node
            if child.best.total > node.best.total or (child.best.total == node.best.total and node.best is not node):
                node.best = child.best


def _named_back(nodes: list[Node]) -> None:
    """A name or a form doesn't take out what holds most of the page's text, or a large article: there it names a neighbour or the layout.

    What is named as another text (comments, related stories) counts as such, articles in it too, unless nearly the whole page is in it.
    """
    size = dict.fromkeys(map(id, nodes), 0)
    for node in reversed(nodes):
        size[id(node)] += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.parent is not None and node.out != 1:
            size[id(node.parent)] += size[id(node)]
    whole = size[id(nodes[0])]
    other: set[int] = set()  # nodes of other texts
    for node in nodes:
        if node.out == 3 and 10 * size[id(node)] > 9 * whole:
            node.out = 0
        if node.out == 3 or (node.parent is not None and id(node.parent) in other):
            other.add(id(node))
    own = whole - sum(size[id(n)] for n in nodes if n.out == 3 and id(n.parent) not in other)
    holds = {id(n) for n in nodes if n.tag in ("article", "main") and id(n) not in other and 4 * size[id(n)] > own}
    for node in reversed(nodes):
        if id(node) in holds and node.parent is not None:
            holds.add(id(node.parent))
    for node in nodes:
        if node.out == 2 and id(node) not in other and (2 * size[id(node)] > own or id(node) in holds):
            node.out = 0


def _text(marked: list[Node]) -> str:
    parts: list[str] = []
    for top in marked:
        parts.append(" ")
        stack: list[Node | str] = [top]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif not item.out:
                block = item.tag not in INLINE
                if block:
                    parts.append(" ")
                    stack.append(" ")
                stack.extend(reversed(item.children))
        parts.append(" ")
    return " ".join(html.unescape("".join(parts)).split())


def main_text(page: str | None) -> str:
    """The article of a page as one line of text; empty for null, empty or textless pages."""
    if not page:
        return ""
    root, nodes = parse(page)
    if any(n.out > 1 for n in nodes):
        _named_back(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    _measure(nodes)
    if not body.chars:
        body = root
    if not body.chars:
        return ""
    core = body.best
    threshold, node = core.density, core
    while node is not body and node is not root:
        node = node.parent
        threshold = min(threshold, node.density)
    lifted: Node | None = core  # the core's own article, if it stands in one
    while lifted is not None and lifted.tag not in ("article", "main"):
        lifted = lifted.parent
    lifted = lifted or core
    marked: set[int] = set()
    order: list[Node] = []
    stack: list[Node] = [body]
    while stack:  # in page order
        node = stack.pop()
        if node.density >= threshold:
            best = lifted if node.best is core else node.best
            if id(best) not in marked:
                marked.add(id(best))
                order.append(best)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.out and c.chars)

    def inside(n: Node) -> bool:
        while n.parent is not None:
            n = n.parent
            if id(n) in marked:
                return True
        return False

    place = {id(n): k for k, n in enumerate(nodes)}
    return _text(sorted((n for n in order if not inside(n)), key=lambda n: place[id(n)]))


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of every page, with ``text`` and ``n_chars`` long (these replace columns of the same names).

    The whole html is read. Null and empty pages, and pages without article text, give empty text; rows come out one for one.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    source = pages.select(F.col(html_col).cast("string").alias("__html"), *keep)
    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.decode() if page else None) for (part,) in texts_of([batch], "__html") for page in part]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), sizes], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)
