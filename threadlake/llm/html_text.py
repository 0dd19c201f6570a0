"""Main text of web pages by composite text density.

A page becomes a tree of elements. For each node the density is its characters
for each tag below it, adjusted by links: text inside links counts against a
node, and more so the larger its share. The composite density of a node is the
sum of its children's densities, so the element that holds the paragraphs of an
article stands out. The threshold is the least density on the path from the
body to the densest node; among the nodes above it the one with the largest sum
is taken. Density also settles how far the main text reaches: up to the parent
while most of what stands beside the node is as dense as the threshold (the
sections of one article) or a heading, down to the only dense child where most
of what stands beside that is not.

What never is article text (scripts, styles, forms, navigation, headers and
footers of the page, side bars, notices, adverts, comments) is left out before.
Names count only as whole classes or ids of blocks, never of headings or of what
stands in a line, and never against a node around the page's
article or main or, where a page has none, around half of its plain text; names
that also occur in articles (share, notice, widget) count only alone and where
density agrees. Ids are often made from headings: an id alone drops nothing in
an article, and nothing that begins with a heading, unless it has the shape of
furniture (forms, mostly links, several named items).

Pages are independent, so the work is one pass in Spark tasks, without a
shuffle. Unclosed and misnested tags are closed as browsers do in the common
cases.

Edge cases: null and empty pages, and pages without text, give an empty text;
pages without a body or any tag count as a body; equal rows get equal texts;
an empty table gives no rows; very long pages are read whole; other columns
pass through ``main_text``.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import fresh, plain_names, small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "template", "iframe", "noframes", "xmp"}
#: Elements that never hold article text.
DROPPED = {*RAW, "head", "nav", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "input", "fieldset", "map"}
#: Page furniture outside an article; a header within an article holds its title.
FURNITURE = {"header", "footer"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words of classes and ids that name furniture: one of these, with places before it and parts after it.
SURE = set(
    "ad ads advert adverts advertising advertisement advertisements adsense sponsor sponsors sponsored promo promos promotion promotions nav navbar navigation menu menus sidebar sidebars breadcrumb breadcrumbs cookie cookies consent gdpr "
    "popup popups modal modals newsletter newsletters subscribe comment comments commentlist disqus footer masthead pagination pager login signup copyright skiplink skiplinks outbrain taboola".split()
)
#: Words that name parts of articles as well.
UNSURE = set("share sharing social related recommended recommendations notice notices alert alerts search respond replies discussion widget widgets banner banners toolbar toolbars".split())
PLACES = set("site page main global top bottom left right primary secondary user reader post article entry blog cookie mobile desktop sub".split())
PARTS = set(
    "container containers wrap wrapper box boxes list section sections area bar link links button buttons block blocks slot slots unit units form forms signup banner notice notices popup modal overlay posts articles stories news item items "
    "left right top bottom primary secondary main menu nav panel inner footer header thread policy consent message icon icons widget leaderboard".split()
)
#: Two words that make one, where they are written apart.
JOINED = {("side", "bar"): "sidebar", ("side", "bars"): "sidebars", ("skip", "link"): "skiplink", ("skip", "links"): "skiplinks", ("bread", "crumb"): "breadcrumb", ("bread", "crumbs"): "breadcrumbs"}
#: Letters of a piece that may be several of these words written together.
LONGEST = 40
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup"}
#: Elements that may be the main text as a whole: no paragraphs and nothing that stands inside a line.
CONTAINERS = {"html", "body", "div", "article", "main", "section", "td", "th", "table", "tbody", "tr", "center", "blockquote", "details", "dl", "dd", "ol", "ul", "li", "figure", "pre"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: An opening tag that ends an open element of these names, unless one of the fences stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"br", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "html", "body"}
FENCES_P = {"button", "table", "td", "th", "object", "article", "section", "div", "body", "li", "blockquote"}
FENCES_END = {"table", "td", "th", "article", "section", "main", "body", "aside", "nav", "footer", "header"}
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")


class Node:
    """An element: its children are nodes and texts, in page order."""

    __slots__ = ("chars", "children", "density", "drop", "link_chars", "link_tags", "named", "named_id", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, drop: bool) -> None:
        self.tag, self.parent, self.drop, self.children = tag, parent, drop, []
        self.named = self.named_id = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _dropped(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    for m in ATTRIBUTE.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name == "hidden" and value.lower() != "until-found":
            return True
        if name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _together(piece: str) -> list[str]:
    """The known words that a piece is made of (the first longest, of at most three), or the piece."""
    known = SURE | UNSURE | PLACES | PARTS
    if piece in known or not piece or len(piece) > LONGEST:
        return [piece]
    for k in range(len(piece) - 1, 1, -1):
        if piece[:k] in known:
            if piece[k:] in known:
                return [piece[:k], piece[k:]]
            for j in range(len(piece) - 1, k + 1, -1):
                if piece[k:j] in known and piece[j:] in known:
                    return [piece[:k], piece[k:j], piece[j:]]
    return [piece]


def _furniture_name(name: str, words: set[str]) -> bool:
    """Whether a class or id is one of ``words`` with places before it and parts or numbers after it. The work is linear in its length."""
    pieces = [p.rstrip("0123456789") for p in re.split("[_-]", name.lower())]
    if not pieces or not pieces[0]:
        return False
    pieces = [p for p in pieces if p]  # numbers are gone
    found, k = [], 0
    while k < len(pieces):
        joined = JOINED.get(tuple(pieces[k : k + 2]))
        found += [joined] if joined else _together(pieces[k])
        k += 2 if joined else 1
    places = 0
    while places < len(found) and found[places] in PLACES:
        places += 1
    parts = len(found)
    while parts and found[parts - 1] in PARTS:
        parts -= 1
    # The word itself stands at the latest where places end, at the earliest just before parts begin.
    return any(w in words for w in found[max(0, parts - 1) : places + 1])


def _named(attrs: str) -> tuple[int, int]:
    """By class, and by id: 2 if it is surely one of page furniture, 1 if it stands alone and may be, else 0."""
    found = {"class": 0, "id": 0}
    for m in ATTRIBUTE.finditer(attrs):
        if (name := m[1].lower()) in found:
            tokens = next((v for v in m.groups()[1:] if v is not None), "").split()
            sure = any(_furniture_name(t, SURE) for t in tokens)
            found[name] = max(found[name], 2 if sure else int(len(tokens) == 1 and _furniture_name(tokens[0], UNSURE)))
    return found["class"], found["id"]


def parse(page: str) -> Node:
    """The tree of a page below a root that stands for the document."""
    root = at = Node("html", None, False)
    pos, n = 0, len(page)

    def close(names: set[str], fences: set[str]) -> Node:
        node = at
        while node.parent is not None and node.tag not in fences:
            if node.tag in names:
                return node.parent
            node = node.parent
        return at

    while pos < n:
        m = TOKEN.search(page, pos)
        if not m:
            at.children.append(page[pos:])
            break
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag == "html":
            continue
        if m["end"]:
            node = at
            while node.parent is not None and node.tag != tag:
                if node.tag in FENCES_END and tag not in FENCES_END and tag not in ("ul", "ol", "dl", "div", "form", "blockquote"):
                    node = root
                    break
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in ENDS_P:
            at = close({"p"}, FENCES_P)
        if tag in CLOSES:
            for _ in range(2):
                at = close(*CLOSES[tag])
        if tag == "body":
            at = close({"head"}, set())
        inside = Node(tag, at, _dropped(tag, m["attrs"] or "") or (at.drop and at is not root))
        if m["attrs"] and tag not in ("body", "html"):
            if tag in BLOCKS and tag not in HEADINGS:  # what stands in a line, and a heading, is what stands around it
                inside.named, inside.named_id = _named(m["attrs"])
        if tag in FURNITURE and not inside.drop:
            up, article = at, False
            while up is not None:
                article = article or up.tag in ("article", "section", "main")
                up = up.parent
            inside.drop = tag == "footer" or not article
        at.children.append(inside)
        if tag in RAW and not (m["attrs"] or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/") or tag in ("p", "div", "a", "span", "b", "i"):
            at = inside
    _drop_named(root)
    return root


def _in_order(root: Node) -> list[Node]:
    """All nodes that are kept, each before its children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return found


def _shaped(node: Node) -> bool:
    """Whether an element looks like furniture, whatever its name: it asks for input, is mostly links, or holds several named items or articles."""
    items, stack = 0, [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, Node):
                if c.tag in ("form", "input", "button", "select", "textarea"):
                    return True
                items += bool(c.named) or c.tag == "article"
                stack.append(c)
    return items > 1 or bool(node.chars) and 2 * node.link_chars >= node.chars


def _begins_with_heading(node: Node) -> bool:
    for c in node.children:
        if isinstance(c, Node):
            return c.tag in HEADINGS
        if c.strip():
            return False
    return False


def _drop_named(root: Node) -> None:
    """Drops named elements, but for wrappers: those around an article or main, or, on a page without one, around half of the plain text.

    An id alone, which is often made from a heading, does not drop what stands in an article or begins with a heading, unless that has the shape of furniture.
    """
    body, nodes, holds, inside = measure(root), _in_order(root), set(), set()
    plain = lambda node: node.chars - node.link_chars
    for node in reversed(nodes):
        # an article that is itself named (a comment, a teaser) makes no wrapper
        if node.chars and (node.tag == "main" or node.tag == "article" and not node.named) or any(c in holds for c in node.children):
            holds.add(node)
    for node in nodes:
        if node.parent is not None and (node.parent in inside or node.parent.tag in ("article", "main")):
            inside.add(node)
        name = node.named
        if node.named_id > name and (not (node in inside or _begins_with_heading(node)) or _shaped(node)):
            name = node.named_id
        if name and node not in holds and node.tag not in ("article", "main"):
            part = root in holds or 2 * plain(node) < plain(body)
            node.drop = part and (name == 2 or node.density < body.density)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters for each tag, times the logarithm of (characters / link characters) * (tags / link tags) to a base that grows with the links.

    ``share`` is the share of link characters in the body.
    """
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(1.0 + 1e-9, chars / max(1, link_chars) * tags / max(1, link_tags))) / math.log(base + math.e - 1)


def measure(root: Node) -> Node:
    """Sets characters, tags, densities and their sums over the children of every kept node; returns the body."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, Node) and not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.sum = sum(c.density for c in node.children if isinstance(c, Node) and not c.drop)
    return body


def _beside(node: Node, inner: Node, threshold: float, share: float) -> tuple[int, int]:
    """Of the plain characters of ``node`` outside its child ``inner``: those as dense as the threshold or in headings, and the others."""
    dense = sparse = 0
    for c in node.children:
        if isinstance(c, str):
            chars = len("".join(c.split()))
            fits = density(chars, 1, 0, 0, share) >= threshold
        elif c is inner or c.drop:
            continue
        else:
            chars, fits = c.chars - c.link_chars, c.tag in HEADINGS or c.density >= threshold
        dense, sparse = dense + chars * fits, sparse + chars * (not fits)
    return dense, sparse


def main_node(root: Node) -> Node:
    """The kept subtree of the largest density sum, by the threshold of the path from the body; of equal ones the outermost, first on the page."""
    body = measure(root)
    below, share = _in_order(body), body.link_chars / max(1, body.chars)
    densest = max(below, key=lambda x: x.density)
    threshold, node = densest.density, densest
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    best = max((x for x in below if x.density >= threshold and x.chars and (x.tag in CONTAINERS or x is body)), key=lambda x: x.sum, default=body)
    down = True
    while down:
        dense = [c for c in best.children if isinstance(c, Node) and not c.drop and c.density >= threshold]
        down = len(dense) == 1 and dense[0].tag in CONTAINERS
        if down:
            fits, others = _beside(best, dense[0], threshold, share)
            down = others > fits
            best = dense[0] if down else best
    while best is not body and best.parent is not None:
        fits, others = _beside(best.parent, best, threshold, share)
        if others > fits or not fits + others and best.parent is body:
            break
        best = best.parent
    return best


def blocks(node: Node) -> list[str]:
    """The texts of the blocks below a node, in page order, white space turned into single spaces."""
    out, now = [], []

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(now))).strip(" ")
        now.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.drop or x is node:
            block = x.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    return " ".join(blocks(main_node(parse(page))))


def main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    source = fresh(pages, "_html")
    kept = [c for c in pages.columns if c not in (html, text)]
    plain = plain_names(pages.select(*(f"`{c}`" for c in kept), F.col(html).cast("string").alias(source)), len(kept))
    small_batches(pages.sparkSession, 500)

    def run(batches):
        for batch in batches:
            found = pa.array([extract(p) for p in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], text])

    return plain.mapInArrow(run, plain.drop(source).schema.add(text, "string")).toDF(*kept, text)


def report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    return main_text(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
