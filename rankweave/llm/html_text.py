"""Main text of web pages by composite text density.

The page is parsed in one pass into a tree of nodes by a tolerant scanner (unclosed paragraphs, stray
end tags and raw-text elements are handled; a stack of open elements and their depths by tag keeps
every step short, so the time grows with the size of the page whatever is in it). For every node with
c characters, t tags, lc link characters and lt link tags, the composite density is

    c / t * log(c * lt-adjusted ratio) with base ln(c * lc / non-link + body link share * c + e),

so blocks of links fall towards zero. Inline formatting does not count as a tag. The sum of the
densities of a node's block children tells how much dense text it gathers. The subtree with the
largest sum is taken; the threshold is the smallest density on the path from it to the body. Every
block off that path that reaches the threshold joins it: the text is the smallest subtree that holds
them all (for the body: its children from the first of them, with the headings before it, to the
last). Inside an article or main element it then grows to its parent as long as at least half of what
the parent adds is not link text; elsewhere lists of links at its two ends are left out.

Elements that are not the article by their meaning (menus, headers and footers of the page, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are cut by tag and role before densities are
taken, and by a class or id of which a whole name says so: all its words are such words or words of
layout, as in ad-slot or related-posts, but not in share-price or related-work. That does not cut a
heading, an element that holds most of the text of the articles or mains, or one that holds most of
the page's text outside links (where there is article text beside it, only inside that article and by
names that are not all of this kind nor of reader comments); names with has, with, without or no do
not count. There the densities decide. A page without a dense node gives the text of the body.

Defined cases: null and empty pages, and pages without text, give the empty string. Text outside
any element counts as body text. A tag that the page ends in is dropped. Repeated rows are extracted
one by one.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import giving_back, slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset("b i em strong span u s small big sub sup font mark abbr cite code q time wbr br ins del tt var kbd samp bdi bdo data dfn ruby rt rp img".split())
LISTS = frozenset("ul ol dl table div section menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = BLOCK - frozenset("body br caption dd dt head html legend li option summary tbody td tfoot th thead title tr".split())
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
KEEPS_P = ("td", "th", "body", "html", "button", "div", "article", "section", "li", "blockquote")
SCOPES = ("caption", "table", "td", "th", "object", "template")
TABLE = frozenset("caption table tbody thead tfoot tr td th object template body html".split())
IN_HEAD = frozenset("head base link meta title style script noscript template body html".split())

CUT = frozenset("head nav footer aside form script style noscript template iframe textarea button select input object svg canvas title menu dialog".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus respond related recommended pagination pager toolbar masthead topbar".split()
)
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons col column container content desktop entries entry fixed footer form global group holder icon icons inner item items left link links list lists main message mobile outer page pages panel post posts primary right row secondary section site slot sticky stories story text title tool tools top unit wrap wrapper".split()
)
CUT_FIRST = frozenset(("header", "site", "page"))
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
NEGATIONS = frozenset("has have with without no".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)(>?)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_TAG_END = re.compile(r"[\s/]*+(>|\Z)")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total", "words", "pure")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        # Words of class and id names that speak for a cut, and whether all names do.
        self.words: frozenset[str] = frozenset()
        self.pure = False
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_cut(tag: str, values: dict[str, str], in_article: bool) -> bool:
    if tag in CUT:
        return True
    if tag == "header":  # that of an article holds its headline; that of the page does not
        return not in_article
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in values or values.get("aria-hidden", "").strip() == "true" or values.get("role") in CUT_ROLES


def _cut_words(names: list[str]) -> tuple[frozenset[str], bool]:
    """The words that speak for a cut in names made of such words and words of layout only; whether all names are."""
    found, all_so = set(), True
    for name in names:
        words = _WORDS.findall(name)
        cutting = CUT_WORDS.intersection(words)
        if words and words[0] in CUT_FIRST and len(words) <= 2 and "header" in words:
            cutting |= {"header"}
        if cutting and not NEGATIONS.intersection(words) and (cutting | CUT_WORDS | LAYOUT_WORDS | CUT_FIRST).issuperset(words):
            found |= cutting
        elif words:
            all_so = False
    return frozenset(found), all_so


def _cut_by_words(root: Node) -> None:
    """Cut the elements whose class or id speaks for it, unless what they hold speaks against it."""
    order: list[tuple[Node, bool]] = []
    plain: dict[Node, int] = {}
    told: dict[Node, int] = {}  # of plain, what lies in an article or main
    stack, marked = [(root, False, False)], False
    while stack:
        node, in_link, in_article = stack.pop()
        if node.cut:
            continue
        in_link = in_link or node.tag == "a"
        in_article = in_article or (node.tag in ("article", "main") and not node.words)
        order.append((node, in_article))
        marked = marked or bool(node.words)
        plain[node] = 0 if in_link else sum(len(_SPACE.sub("", p)) for p in node.parts if isinstance(p, str))
        stack.extend((p, in_link, in_article) for p in node.parts if isinstance(p, Node))
    if not marked:
        return
    for node, _ in reversed(order):
        inner = [p for p in node.parts if isinstance(p, Node) and not p.cut]
        plain[node] += sum(plain[p] for p in inner)
        told[node] = plain[node] if node.tag in ("article", "main") and not node.words else sum(told[p] for p in inner)
    for node, in_article in order:
        if not node.words or node.tag in HEADINGS or node.tag in ("html", "body", "article", "main"):
            continue
        if 2 * told[node] > told[root]:
            continue
        beside = told[root] > (plain[node] if in_article else told[node])
        if 2 * plain[node] > plain[root] and (not beside or (in_article and not node.pure and not COMMENT_WORDS & node.words)):
            continue
        node.cut = True


class _Open:
    """The open elements, and for each tag the depths at which it is open."""

    def __init__(self):
        self.root = Node("html", None)
        self.stack, self.depths = [self.root], defaultdict(list)
        self.depths["html"].append(0)

    def here(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.depths[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        while len(self.stack) > max(depth, 1):
            self.depths[self.stack.pop().tag].pop()

    def deepest(self, tags: Iterable[str]) -> int:
        return max((at[-1] for t in tags if (at := self.depths.get(t))), default=-1)

    def end(self, tag: str) -> None:
        depth = self.deepest((tag,))
        if depth > 0 and (tag in TABLE or depth > self.deepest(SCOPES)):
            self.close(depth)

    def make_room(self, tag: str) -> None:
        """Close what a new element ends by itself."""
        if tag not in IN_HEAD and (head := self.deepest(("head",))) > 0:
            self.close(head)
        if tag in CLOSES_P and (p := self.deepest(("p",))) > self.deepest(KEEPS_P):
            self.close(p)
        if tag in ALIKE:
            limit = self.deepest(LIMITS[tag])
            inner = [at[i] for t in ALIKE[tag] if (at := self.depths.get(t)) and (i := bisect_right(at, limit)) < len(at)]
            if inner:
                self.close(min(inner))
        if tag == "body":
            self.close(1)


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from a place behind the name of a tag, whether the tag ends in a slash, and where it ends."""
    values: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        values.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        at = m.end()
    m = _TAG_END.match(page, at)
    end = m.end() if m else len(page)
    return values, page[max(end - 2, 0) : end] == "/>" or not (m and m[1]), end


def parse(page: str) -> Node:
    tree, at, size = _Open(), 0, len(page)

    def text(piece: str) -> None:
        if tree.here().tag == "head" and not piece.isspace():
            tree.close(tree.deepest(("head",)))
        tree.here().parts.append(piece)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        values, closed = {}, False
        if not m[3]:
            values, closed, at = _attributes(page, at)
            if page[at - 1] != ">":  # the page ends in the tag
                break
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        if tag == "html" or (tag == "body" and tree.depths["body"]):
            continue
        tree.make_room(tag)
        here = tree.here()
        node = Node(tag, here, _is_cut(tag, values, bool(tree.depths["article"] or tree.depths["main"])))
        if not node.cut and ("class" in values or "id" in values):
            node.words, node.pure = _cut_words([*values.get("class", "").split(), *values.get("id", "").split()])
        here.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not closed:
            tree.push(node)
    return tree.root


def _measure(root: Node) -> Node:
    """Counts and densities of all nodes; returns the body."""
    order, stack, body = [], [(root, False)], root
    while stack:
        node, in_link = stack.pop()
        if node.cut:
            continue
        order.append(node)
        if node.tag == "body" and body is root:
            body = node
        in_link = in_link or node.tag == "a"
        for p in node.parts:
            if isinstance(p, Node):
                stack.append((p, in_link))
            else:
                n = len(_SPACE.sub("", p))
                node.chars += n
                node.link_chars += n * in_link
    for node in reversed(order):
        for p in node.parts:
            if isinstance(p, Node) and not p.cut:
                node.chars += p.chars
                node.link_chars += p.link_chars
                node.tags += p.tags + (p.tag not in INLINE)
                node.link_tags += p.link_tags + (p.tag == "a")
    share = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = c / max(lc, 1) * t / max(lt, 1)
            node.density = c / t * math.log(ratio) / math.log(base) if base > 1 and ratio > 1 else 0.0
            if base <= 1.0 + 1e-12:
                node.density = c / t * max(math.log(ratio), 0.0)
    for node in order:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.cut and p.tag not in INLINE)
    return body


def _open(node: Node) -> list[Node]:
    return [p for p in node.parts if isinstance(p, Node) and not p.cut]


def _chosen(body: Node) -> list[Node | str]:
    nodes, stack = [], [body]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(reversed(_open(node)))
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        return [body]
    path = [best]
    while path[-1] is not body and path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    holder = best
    # The lowest node of the path below which nothing dense is left out.
    for i in range(len(path) - 1, 0, -1):
        outer, inner = path[i], path[i - 1]
        dense = [k for k, p in enumerate(outer.parts) if isinstance(p, Node) and not p.cut and (p is inner or (p.tag not in INLINE and p.chars and p.density >= threshold))]
        if len(dense) > 1:
            if outer is body:
                first, last = dense[0], dense[-1]
                while first and (isinstance(before := body.parts[first - 1], str) and not before.strip() or isinstance(before, Node) and before.tag in HEADINGS):
                    first -= 1
                return body.parts[first : last + 1]
            holder = outer
            break
    above = path[path.index(holder) :]
    told = [i for i, n in enumerate(above) if n.tag in ("article", "main")]
    if not told:
        return _without_lists(holder)
    for outer in above[1 : told[-1] + 1]:
        if 2 * (outer.link_chars - holder.link_chars) > outer.chars - holder.chars:
            break
        holder = outer
    return [holder]


def _without_lists(holder: Node) -> list[Node | str]:
    """The parts of a node without the lists of links at its two ends."""

    def menu(part: Node | str) -> bool:
        return isinstance(part, Node) and part.tag in LISTS and part.link_tags >= 3 and part.link_chars >= 0.9 * part.chars

    def blank(part: Node | str) -> bool:
        return not part.strip() if isinstance(part, str) else part.cut or not part.chars

    parts = list(holder.parts)
    for end in (0, -1):
        while parts and (menu(parts[end]) or blank(parts[end])):
            parts.pop(end)
    return parts or [holder]


def _blocks(nodes: list[Node | str]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(html.unescape(item))
        elif not item.cut:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(item.parts))
    end()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _cut_by_words(root)
    body = _measure(root)
    if not root.chars:
        return ""
    return "\n".join(_blocks(_chosen(body)))


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(giving_back(_run), f"page_id {kind}, url string, text string, n_chars long")
