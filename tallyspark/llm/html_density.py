"""Main text of web pages by composite text density.

A page is read into a tree of elements by a tolerant tokenizer (unclosed and crossed tags, pages cut off anywhere). What
never is main text goes first: scripts, styles, menus, headers and footers, forms, sidebars, and elements whose
class, id or role says advert, notice, comments and the like. For every remaining element the density is its
characters per tag, adjusted for links: characters in links count against it, more so where the page has few of them.
The element with the greatest sum of its children's densities is the core. If it is in an article or main element, the
outermost of these is the text, whole; else the core is raised as long as what is beside it has more text than links. Siblings
along the way up from there to the body belong to the text too if they are as dense as the thinnest element on that way.
Lists of links without a name are menus, but not in an article (or in a main element without one), where they are references; such
a list of one or two links is a menu where it stands, at the text's beginning or end.
Inside an article or main element a name goes by its whole words only: "comments" and "post-comments" are comments, but "share-price" is text; headings
and paragraphs aren't judged by parts of a name, and a header inside an article, by tag or name, is the article's own and stays. A form goes, unless the page is in it.

Character references are decoded; white space inside a block becomes one space, blocks are
trimmed and joined by one space. Null or empty pages, and pages without text, give an empty text. Nothing is cut
off: neither long pages nor deep ones (the tree is walked without recursion, each character and element a fixed number of
times). Repeated ids are rows of their own; an empty table gives an empty one; of ties the first element in the page counts; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noframes xmp iframe noembed".split())
DROPPED = set("head script style noscript template nav header footer aside button select option textarea iframe object embed svg canvas audio video map dialog menu title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside comment comments disqus respond replies cookie cookies consent notice notices gdpr popup modal overlay share sharing social related recommended subscribe newsletter signup login search pagination pager toolbar widget skip hidden".split())
#: Words that say nothing about what an element holds, beside a name that does.
NEUTRAL = set("area bar block body box button buttons container content entry group icons inner item items left link links list main module outer page panel post posts right row section site top bottom wrap wrapper".split())
TEXT = set("p h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol dl div section table".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ABOUT = {"has", "with", "no", "without"}


class Node:
    __slots__ = ("tag", "parent", "content", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.content = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def unwanted(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is no main text by its tag or attributes; inside: of an article or main element."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and _GONE.search(value):
            return True
        if name in ("class", "id"):
            for word in _CAMEL.sub(r"\1-\2", value).lower().split():
                parts = _PART.findall(word)  # "post-comments" and "comments-area" are comments, "has-sidebar" is no sidebar
                if inside and (len(parts) > 1 and tag in TEXT or "header" in parts or not set(parts) <= NAMES | NEUTRAL or set(parts) <= NEUTRAL):
                    continue
                if parts and not _ABOUT & set(parts) and (parts[0] in NAMES or parts[-1] in NAMES):
                    return True
    return False


def tokens(page: str):
    """(what, begin, end, attributes) of comments ("!"), start tags ("name") and end tags ("/name"), each character read once.

    A quote without its partner is no quote; a tag or comment that doesn't end goes on to the end of the page. After a
    raw element's start tag the next token is its end tag."""
    at, length = 0, len(page)
    last = {c: page.rfind(c) for c in "\"'"}
    raw = ""
    ends: dict[str, re.Pattern] = {}
    while at < length:
        if raw:
            if raw not in ends:
                ends[raw] = re.compile(r"</" + re.escape(raw) + r"(?=[\s/>])[^>]*>", re.I)
            end = ends[raw].search(page, at)
            yield "/" + raw, at, end.end() if end else length, ""
            at, raw = end.end() if end else length, ""
            continue
        begin = page.find("<", at)
        if begin < 0:
            return
        sign = page[begin + 1 : begin + 2]
        name = _NAME.match(page, begin + (2 if sign == "/" else 1))
        if not name:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = end + 3 if end >= 0 else length
            elif sign in ("!", "?", "/", ""):
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else length
            else:  # a bare sign is text
                at = begin + 1
                continue
            yield "!", begin, at, ""
            continue
        i = name.end()
        while True:
            m = _QUOTE_OR_END.search(page, i)
            if m is None:
                i = length
                break
            i = m.start()
            if page[i] == ">":
                break
            i = page.find(page[i], i + 1) + 1 if i < last[page[i]] else i + 1
        tag = name[0].lower()
        if i < length:
            yield ("/" if sign == "/" else "") + tag, begin, i + 1, page[name.end() : i]
            raw = tag if sign != "/" and tag in RAW else ""
        else:
            yield "!", begin, length, ""
        at = i + 1


def parse(page: str) -> Node:
    """The tree; unwanted elements are read, as they may hold others' end tags, but not kept. Linear: open elements are found by their tags' own stacks."""
    root = Node("#root", None)
    path = [root]  # the open elements
    places: dict[str, list[int]] = {}  # by tag, where in the path it is open
    dead: list[str] = []  # open elements from the unwanted one on
    dying: dict[str, int] = {}  # how many of each tag

    def cut(depth: int) -> None:
        while len(path) > depth:
            places[path.pop().tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(names, stops=()) -> None:
        depth = innermost(names)
        if depth and depth > innermost(stops):
            cut(depth)

    at = 0
    for what, begin, end, attributes in tokens(page):
        if begin > at and not dead:
            path[-1].content.append(entities.unescape(page[at:begin]))
        at = end
        if what == "!":
            continue
        if what[0] == "/":
            tag = what[1:]
            if dead:
                if dying.get(tag):
                    while True:
                        gone = dead.pop()
                        dying[gone] -= 1
                        if gone == tag:
                            break
                elif tag in ("body", "html"):
                    dead.clear()
                    dying.clear()
            elif tag not in VOID and places.get(tag):
                cut(places[tag][-1])
            continue
        tag = what
        if tag in RAW:
            continue
        if dead:
            if dead[0] == "head" and tag == "body":
                dead.clear()
                dying.clear()
            else:
                if tag not in VOID and not attributes.endswith("/") and (tag == dead[0] or tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "option")):
                    dead.append(tag)
                    dying[tag] = dying.get(tag, 0) + 1
                continue
        if tag in VOID:
            path[-1].content.append(" ")
            if tag != "wbr":
                path[-1].tags += 1
            continue
        if tag in CLOSES_P:
            close(("p",), ("div", "article", "section", "main", "body", "td", "li", "blockquote", "table"))
        if tag in SELF_CLOSING:
            names, stops = SELF_CLOSING[tag]
            close(names.split(), stops)
        if unwanted(tag, attributes, bool(places.get("article") or places.get("main"))) and not (tag == "header" and places.get("article")):
            if not attributes.endswith("/"):
                path[-1].content.append("\n" if tag not in INLINE else "")
                dead.append(tag)
                dying[tag] = 1
            continue
        child = Node(tag, path[-1])
        path[-1].content.append(child)
        places.setdefault(tag, []).append(len(path))
        path.append(child)
    if at < len(page) and not dead:
        path[-1].content.append(entities.unescape(page[at:]))
    return root


def without_forms(root: Node) -> None:
    """Empties the forms, but not one that the page is in: it has an article or main element, or most of the text."""
    nodes = in_order(root)
    forms = [n for n in nodes if n.tag == "form"]
    if not forms:
        return
    size = dict.fromkeys(map(id, nodes), 0)
    named = set()
    for node in reversed(nodes):
        size[id(node)] += sum(len(c.strip()) for c in node.content if isinstance(c, str))
        if node.tag in ("article", "main") or id(node) in named:
            named |= {id(node), id(node.parent)}
        if node.parent is not None:
            size[id(node.parent)] += size[id(node)]
    for form in forms:
        if id(form) not in named and 2 * size[id(form)] <= size[id(root)]:
            form.content = []


def in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.content) if isinstance(c, Node))
    return out


def weigh(root: Node) -> list[Node]:
    """Densities and their sums, from the leaves up."""
    nodes = in_order(root)
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in node.content if isinstance(c, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((n for n in nodes if n.tag == "body"), root)
    share = (body.link_chars + 1) / (body.chars + 1)
    for node in nodes:
        c, t = node.chars, max(1, node.tags)
        if c:
            plain, linked, links = max(1, c - node.link_chars), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / plain * linked + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / linked * t / links) + 1) / base
    for node in nodes:
        if node.parent is not None and node.tag not in INLINE:
            node.parent.sum += node.density
    return nodes


def blocks(nodes: list[Node], articles: set[int]) -> str:
    """The text of these elements; a new block begins and ends with every element that isn't inline."""
    parts: list[tuple[str, bool]] = []  # with whether it is in a small menu
    stack: list[tuple[Node | str, bool, bool]] = [(n, False, False) for n in reversed(nodes)]
    while stack:
        item, whole, small = stack.pop()
        if isinstance(item, str):
            parts.append((item, small))
            continue
        whole = whole or id(item) in articles
        if not whole and item.tag in LISTS and item.link_chars > 0.66 * item.chars:
            if item.link_tags > 2:
                continue  # a menu without a name
            small = True
        edge = "" if item.tag in INLINE else "\n"
        stack.append((edge, whole, small))
        stack.extend((c, whole, small) for c in reversed(item.content))
        stack.append((edge, whole, small))
    own = [k for k, (text, small) in enumerate(parts) if not small and text.strip()]
    if own:  # small menus before the first and after the last text
        parts = [x for k, x in enumerate(parts) if not x[1] or own[0] < k < own[-1]]
    return _SPACE.sub(" ", "".join(text for text, _ in parts)).strip()


def article_of(core: Node, way: list[Node]) -> Node:
    """The element on the way up from the core that is the whole text."""
    named = [n for n in way if n.tag in ("article", "main")]
    if named:
        return named[-1]
    for node in way[1:]:
        beside = [c for c in node.content if isinstance(c, Node) and c.chars and c is not core]
        if node.tag in ("body", "html", "#root") or any(2 * c.link_chars >= c.chars for c in beside):
            break
        core = node
    return core


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    without_forms(root)
    nodes = weigh(root)
    if not root.chars:
        return ""
    places = [n for n in nodes if n.tag not in INLINE and n.chars]
    core = max(places, key=lambda n: n.sum)
    if core.sum <= max(n.density for n in places):  # all text in one block
        core = max(places, key=lambda n: (n.density, -n.tags))
        if core.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") and core.parent is not None:
            core = core.parent
    way, node = [], core
    while node is not None and node.tag not in ("body", "html", "#root"):
        way.append(node)
        node = node.parent
    if node is not None:
        way.append(node)
    least = min(n.density for n in way)
    core = article_of(core, way)
    articles = {id(n) for n in nodes if n.tag == "article"} or {id(n) for n in nodes if n.tag == "main"}
    chosen: list[Node] = []
    top = way[-1]

    def visit() -> None:
        on_way = set(map(id, way))
        stack = [top]
        while stack:
            n = stack.pop()
            if n is core:
                chosen.append(n)
            elif id(n) in on_way:
                stack.extend(c for c in reversed(n.content) if isinstance(c, Node))
            elif n.density >= least and n.chars > n.link_chars * 2:
                chosen.append(n)

    visit()
    return blocks(chosen, articles)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(K.tidy(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
