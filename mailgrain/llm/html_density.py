"""Main text of web pages by composite text density.

The page becomes a tree (void elements, raw-text elements, implied end tags of p, li, td and the like, unclosed inline
tags and stray end tags are handled) in one scan, linear in its length. A quote opens an attribute's value only right
after "="; if quotes hide every further ">", the next ">" ends the tag and quotes of that page count no more. A tag that
the end of the page cuts off is no text. For every node:

* characters C, tags T, characters and tags inside links LC and LT of the whole subtree;
* density: (C / T) * log base b of (C / LC * T / LT), with b = ln(C / notLC * LC + LCbody / Cbody * C + e), and zero
  counts taken as one: characters per tag, lowered where they sit in links (bases near one count as e^0.001);
* density sum: the sum of its children's densities.

The node of the largest density sum is the centre. Nodes inside dropped blocks (see below; forms excepted, they may hold
a whole page) do not compete, unless every <article> or <main> with text lies there, or all text does. If an <article>
or <main> encloses the centre, the outermost one is kept. Else the threshold is the smallest density on its path to the
body, and the topmost nodes below the body that reach it are kept, but for blocks of nothing but links around the centre
(sections that lie directly in the body and are thinner than the body as a whole do not reach it). Inside what is kept,
blocks are dropped that by tag, role, class or id are menus, headers, footers, sidebars, notices, adverts, forms or
comments. Headings and short paragraphs inside stay.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank in
page order. Pages are independent and each is read whole. Null or empty html, or a page without text: empty text.
Repeated rows repeat their result; other columns are ignored; an empty table gives an empty result.
"""

import bisect
import collections
import html as entities
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")  # a quote opens a value only right after its "="
_PLAIN_REST = re.compile(r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"']++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|(\S++)))?""")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOILERPLATE = frozenset("nav aside footer form button select menu dialog head svg canvas object embed audio video fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs header masthead "
                  "footer comment comments disqus replies respond cookie cookies consent notice notification popup modal overlay newsletter subscribe subscription signup login share sharing "
                  "social related recommended widget toolbar pagination pager skip".split())
_PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "barred", "chars", "tags", "link_chars", "link_tags", "density", "inside")

    def __init__(self, tag, parent):
        self.tag, self.parent, self.children, self.drop = tag, parent, [], False
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.barred = parent is not None and (parent.barred or parent.drop and parent.tag != "form")  # some pages are one form


def _is_boilerplate(tag, attributes, inside_main) -> bool:
    if tag in BOILERPLATE or tag == "header" and not inside_main:
        return True
    if not attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if not MARKS.isdisjoint(_PARTS.findall(a or b or c)) or not MARKS.isdisjoint(_PARTS.findall(value)):
                return True
    return False


class _Open:
    """The open elements and, for every tag, the depths at which it is open, so that no look-up walks up the tree."""

    def __init__(self, root):
        self.stack, self.at, self.blocks = [root], collections.defaultdict(list), [0]

    def push(self, node):
        self.at[node.tag].append(len(self.stack))
        if node.tag != "p" and node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth):
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, tags):
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def first_beyond(self, tags, depth):
        found = [(self.at[t], bisect.bisect_right(self.at[t], depth)) for t in tags]
        return min((where[i] for where, i in found if i < len(where)), default=None)


def parse(page: str) -> Node:
    """Tree of elements; children are nodes or strings of decoded text. One scan, linear in the page."""
    root = Node("#root", None)
    opened, at, rest = _Open(root), 0, _REST
    paragraphs = opened.at["p"]
    while True:
        here = opened.stack[-1]
        m = _START.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            here.children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        if not m[2]:
            ends = "-->" if m[0] == "<!--" else ">"
            end = page.find(ends, m.end())
            at = end + len(ends) if end >= 0 else len(page)
            continue
        tag = m[2].lower()
        tail = rest.match(page, m.end())
        if not tail and rest is _REST:  # quotes that hide every further tag end are not trusted again in this page
            rest = _PLAIN_REST
            tail = rest.match(page, m.end())
        if not tail:
            return root  # the end of the page cuts this tag off
        at = tail.end()
        if m[1]:
            if opened.at[tag]:
                opened.cut(opened.at[tag][-1])
            elif tag == "p":
                here.children.append(Node("p", here))
            continue
        if tag in ENDS_P and paragraphs and paragraphs[-1] > opened.blocks[-1]:
            opened.cut(paragraphs[-1])
        closed = CLOSES.get(tag)
        if closed:
            outermost = opened.first_beyond(closed, opened.last(SCOPES.get(tag, ("table",))))
            if outermost is not None:
                opened.cut(outermost)
        here = opened.stack[-1]
        new = Node(tag, here)
        new.drop = tag not in ("html", "body") and _is_boilerplate(tag, tail[1], new.inside)
        here.children.append(new)
        if tag in RAW:
            new.drop = True
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not _closes_itself(tail[1]):
            opened.push(new)


def _closes_itself(attributes: str) -> bool:
    """A slash at the end counts, unless it ends an unquoted value (href=/a/)."""
    _, value, last = attributes.rpartition("=")
    return attributes.endswith("/") and not (value and re.fullmatch(r"\s*[^\s\"']+", last))


def _measure(root: Node):
    """Fill the counts and densities; returns all nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        chars = tags = link_chars = link_tags = 0
        if not node.drop:
            for c in node.children:
                if isinstance(c, Node):
                    chars += c.chars
                    tags += c.tags
                    link_chars += c.link_chars
                    link_tags += c.link_tags
                else:
                    chars += len(c.strip())
            tags += node.tag not in INLINE or node.tag == "a"
            if node.tag == "a":
                link_chars, link_tags = chars, max(link_tags, 1)
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    return order


def _densities(order, body: Node):
    share = body.link_chars / max(body.chars, 1)
    for n in order:
        links, tags = max(n.link_chars, 1), max(n.tags, 1)
        base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
        ratio = n.chars / links * tags / max(n.link_tags, 1)
        n.density = n.chars / tags * max(math.log(ratio), 0.0) / max(math.log(base), 1e-3) if n.chars else 0.0


def _candidates(order):
    """Nodes that may be the centre, parents first, so a tie goes to the larger subtree.

    Nodes inside dropped ones are barred, unless all articles (or mains) with text lie there, or all text does."""
    free = [n for n in reversed(order) if not n.barred]
    holders = [n for n in reversed(order) if n.tag in ("article", "main") and n.chars]
    if holders and all(n.barred for n in holders):
        return [n for n in reversed(order) if not n.barred or n.inside]
    return free if any(n.chars and not n.drop for n in free) else order[::-1]


def main_text(page) -> str:
    """Main text of one page."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    _densities(order, body)
    best, centre = -1.0, body
    for n in _candidates(order):
        if n.tag in INLINE or n.drop:
            continue
        total = sum(c.density for c in n.children if isinstance(c, Node))
        if total > best:
            best, centre = total, n
    path, node = [], centre
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    kept = centre
    for n in path[1:]:  # an article around the centre belongs to it; so does a parent as dense as the centre itself
        if n is body or n is root:
            break
        if n.tag in ("article", "main") or n.density >= centre.density:
            kept = n
    out = []
    if centre is path[-1] or any(n.tag in ("article", "main") for n in path):
        _collect(kept, out)
    else:
        way = set(path)
        below = [*itertools.takewhile(lambda n: not n.drop, path)]  # a dropped wrapper bounds the search as the body does
        top = path[min(len(below), len(path) - 1)]
        for n in _reaching(top, min(n.density for n in below)):
            _collect(n, out, kept, way)
    return " ".join("".join(out).split())


def _reaching(top: Node, threshold: float):
    """The topmost nodes below `top` whose density reaches the threshold, in page order."""
    stack = [top]
    while stack:
        x = stack.pop()
        if x is not top and x.density >= threshold:
            yield x
        else:
            stack += [c for c in reversed(x.children) if isinstance(c, Node) and not c.drop]


def _collect(top: Node, out: list, kept=None, path=()):
    """Text below `top` in page order; a line break around blocks. With `kept`, blocks outside of it (and off the path to
    it) that are nothing but links, two or more, are left out."""
    stack = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif kept is not None and x is kept:
            _collect(x, out)
        elif kept is not None and x not in path and x.tag not in INLINE and x.link_tags > 1 and x.link_chars == x.chars:
            continue
        elif not x.drop or x is top:
            block = x.tag not in INLINE
            if block:
                out.append("\n")
                stack.append("\n")
            stack += reversed(x.children)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars), one row per page."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield arrow_rows([id_col, url_col, "text", "n_chars"], [b.schema.field(0).type, b.schema.field(1).type, pa.string(), pa.int64()],
                             [b.column(0), b.column(1), texts, [len(t) for t in texts]])

    kept = pages.select(id_col, url_col, html_col)
    types = dict(kept.dtypes)
    return kept.mapInArrow(run, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long")
