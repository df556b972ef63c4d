"""Main text of a web page by tree scoring.

A page becomes a tree of elements with its blocks of text as leaves.  Every block gives points
for its length and its commas, less what stands in links; they pass in full to the element that
holds the block and in halves to each ancestor above, until nothing is left of them.  Elements that are
never content (menus, headers, footers, forms, scripts, and those whose class, role or id says so) take
no part.  The best element is kept with all its blocks.  Where no element says that it is the article, the
best one may be a part of it: it gives way to its parent while that one is a container of the same text (it
has a heading of its own, its name says that it holds content, or further children are of the best one's kind).
Its siblings in one container are kept but for those that are mostly links, and so are the articles beside an article there; directly in
the page's body only siblings that look like text are.

Edge cases: null or empty html gives no text; tags cut off at the end are dropped; unclosed
paragraphs end where the next block begins; a page without any block outside menus and the like
gives no text; of elements with equal points the first to be closed by a block is taken; very long and very deep pages
are read whole; repeated pages are read each for itself; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from murmura.llm.common import small_batches, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
#: One attribute after another, so that neither a longer name nor a quoted value is taken for one.
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")

# Kinds of HTML elements.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title".split())
NEVER = frozenset("nav header footer aside form button select option label input menu dialog head".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rt rp".split())
#: Parts of a name that mark what isn't content, and names that do so only as a whole or with what they hold.
NOT_CONTENT = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notices?|gdpr|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|widget|footer|header|masthead|comments?|disqus|share|sharing|social|newsletter|subscribe|signup|login|pagination|pager|toolbar)(?:$|[_-])", re.I)
NOT_CONTENT_WHOLE = re.compile(r"^(?:side|repl(?:y|ies)|discussion|related|recommend\w*|search|skip|hidden)(?:[_-]?(?:bar|box|list|links?|posts?|area|block|wrapper|container|items?|articles?|form|results|content))*$", re.I)
CONTENT = re.compile(r"(?:^|[_-])(?:content|article|post|entry|story|main|text|body)(?:$|[_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their ids are the targets of links, not names of what they hold.
TARGETS = HEADINGS | frozenset("section p li dt dd blockquote figure figcaption pre table".split())
#: Closed by the start of any block.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
ROOMS = frozenset("ul ol dl table tbody thead article section main div body html blockquote figure details".split())
BONUS = {"article": 30.0, "main": 20.0}


class Node:
    __slots__ = ("tag", "parent", "skip", "score", "children", "names", "size", "linked")

    def __init__(self, tag: str, parent: Node | None, skip: bool, names: tuple[str, ...] = ()):
        self.tag, self.parent, self.skip, self.names = tag, parent, skip, names
        self.score, self.children = 0.0, []
        #: Characters of the blocks that it holds itself, and of those in links.
        self.size = self.linked = 0


def is_boilerplate(tag: str, names: dict[str, list[str]]) -> bool:
    """Whether an element isn't content by its kind, or by a class, a role or (of containers) an id."""
    if tag in NEVER:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    said = names.get("class", []) + names.get("role", []) + ([] if tag in TARGETS else names.get("id", []))
    return any(NOT_CONTENT.search(x) or NOT_CONTENT_WHOLE.search(x) for x in said)


def _block(node: Node, parts: list[tuple[str, bool]], order: list) -> None:
    """Close the block that ``parts`` (text, whether in a link) make up, and give its points."""
    text = " ".join("".join(p for p, _ in parts).split())
    linked = sum(len(p) for p, link in parts if link)
    total = sum(len(p) for p, _ in parts)
    parts.clear()
    if not text or node.skip:
        return
    order.append((node, text))
    node.size, node.linked = node.size + total, node.linked + linked
    points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / max(1, total))
    if node.tag in PARAGRAPHS and node.parent is not None:
        node = node.parent
    while node is not None and points > 1e-6:
        node.score += points
        points /= 2
        node = node.parent


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree's root, and the blocks outside of what is never content as (holding element, text) in page order."""
    root = Node("", None, False)
    node, order, parts, links, at = root, [], [], 0, 0
    raw_end = None
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and raw_end is None:
            parts.append((unescape(text), links > 0))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[4]:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        closing = bool(m[1])
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            elif tag == "br":
                parts.append((" ", links > 0))
            continue
        _block(node, parts, order)
        if not closing:
            closes = ITEMS.get(tag, frozenset())
            x = node
            while x is not root and x.tag not in ROOMS and x.tag not in NEVER:
                if x.tag in PARAGRAPHS or x.tag in closes:
                    node, links = x.parent, 0
                x = x.parent
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in ROOMS:
                continue
            names: dict[str, list[str]] = {}
            for kind, *values in _ATTRIBUTE.findall(m[3]):
                if kind.lower() in ("class", "id", "role"):
                    names.setdefault(kind.lower(), "".join(values).split())
            child = Node(tag, node, node.skip or is_boilerplate(tag, names), tuple(x for v in names.values() for x in v))
            node.children.append(child)
            node = child
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = end.start() if end else len(html)
        else:
            x = node
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                node, links = x.parent, 0
    _block(node, parts, order)
    return root, order


def _link_share(node: Node) -> float:
    size = linked = 0
    todo = [node]
    while todo:
        x = todo.pop()
        size, linked = size + x.size, linked + x.linked
        todo += x.children
    return linked / max(1, size)


def _whole_article(best: Node) -> Node:
    """The container of all of the text that the best element is a part of."""
    while best.tag not in BONUS and best.parent is not None and best.parent.tag not in ("", "html", "body"):
        parent = best.parent
        others = [x for x in parent.children if x is not best and not x.skip]
        whole = (
            parent.tag in BONUS
            or any(x.tag in HEADINGS for x in others)
            or any(CONTENT.search(name) for name in parent.names)
            or any(x.tag == best.tag and x.names == best.names and x.score >= 0.2 * best.score for x in others)
        )
        if not whole or any(_link_share(x) > 0.5 for x in others if x.tag not in HEADINGS):
            break
        best = parent
    return best


def main_text(html: str | None) -> str:
    """The blocks of the best element and of its text-like siblings, one a line."""
    if not html:
        return ""
    root, order = parse(html)
    if not order:
        return ""
    best, most = None, -1.0
    seen: set[int] = set()
    for leaf, _ in order:
        node = leaf
        while node is not None and id(node) not in seen:
            seen.add(id(node))
            score = node.score + BONUS.get(node.tag, 0.0)
            if node.tag not in PARAGRAPHS and score > most:
                best, most = node, score
            node = node.parent
    best = _whole_article(best)
    kept = {id(best)}
    parent = best.parent
    #: Whether what stands beside the best element is part of the same container, and not of the page at large.
    together = parent is not None and parent.tag not in ("", "html", "body")
    if parent is not None:
        for sibling in parent.children:
            if sibling.skip:
                continue
            if best.tag == "article":
                more = together and sibling.tag == "article" and _link_share(sibling) <= 0.5
            elif best.tag in BONUS:
                more = False
            elif together:
                more = _link_share(sibling) <= 0.5
            else:
                more = sibling.score >= max(3.0, 0.2 * most)
            if more:
                kept.add(id(sibling))
    inside: dict[int, bool] = {}

    def within(node: Node | None) -> bool:
        path = []
        while node is not None and id(node) not in inside and id(node) not in kept:
            path.append(id(node))
            node = node.parent
        found = node is not None and (id(node) in kept or inside[id(node)])
        inside.update(dict.fromkeys(path, found))
        return found

    # Text that stands in the parent itself; of a page at large only what is long enough to be a paragraph of the article.
    def beside(node: Node, text: str) -> bool:
        held = best.tag not in BONUS and (node is parent or node.tag in PARAGRAPHS and node.parent is parent)
        return held and (together or len(text) >= 80)

    return "\n".join(text for node, text in order if within(node) or beside(node, text))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages``; one pass, no shuffle."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
