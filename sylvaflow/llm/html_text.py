"""Main text of web pages, by removal of what a site repeats.

Element subtrees of a page are hashed over their tags and words and counted per host in Spark. One
that recurs on many pages of its host, in different surroundings, is the site's template and goes.
What stands outside an article is template at SHARE of the host's pages, what stands inside only at
INSIDE of them, as many pages may quote a passage. Copies of an article have it in equal surroundings, and
what holds half of a page's text is no template.

Furniture that a site doesn't repeat (this page's adverts, comments, forms) goes by tag, role, class or
id, unless it holds most of the page's text. What is left is read: of main elements, and articles in
them, those that hold at least half of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import FEW, stored
from sylvaflow.llm.text import by_bytes

#: A subtree is template if it is on such a share of its host's pages, outside or inside an article, on
#: LEAST_PAGES at least, and in LEAST_PARENTS different parents, or in as many as the host has pages.
SHARE, INSIDE = 0.2, 0.9
LEAST_PAGES, LEAST_PARENTS = 3, 5
#: Subtrees that a task sums before it sends them on, and keys that a hot host's pages are spread over.
HELD, SALTS = 200_000, 16

# HTML's void elements, elements that end at the next of their kind, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd tr figcaption".split())
# ends an open paragraph
BREAKS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOUND = frozenset("table td th tr ul ol dl div section article body main aside blockquote form nav header footer".split())
# Elements without text to read, elements and names of page furniture.
SILENT = frozenset("head title script style select option textarea input button iframe noscript template svg canvas object audio video".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
FURNITURE = frozenset("nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
PROSE = frozenset("p h1 h2 h3 blockquote pre".split())
_PREFIXES = "site page main top bottom left right global primary secondary post article user reader"
_SUFFIXES = "list area section box block container wrapper wrap inner content left right top bottom bar links link items item form widget thread main"
_NAMES = "ads? adverts? advertisement advertising adsense banner breadcrumbs? cookies? consent disqus footer gdpr menu modal nav navbar navigation newsletter notices? pagination popup promo promoted related share sharing sidebar side-bar skip social sponsor sponsored subscribe subscription toolbar widget"
_COMMENTS = "comments? commentlist replies reply respond"


def _token(names: str) -> re.Pattern:
    """One class or id that is a name, maybe after a known prefix and before known suffixes."""
    choice = lambda x: "|".join(x.split())
    return re.compile(rf"(?:(?:{choice(_PREFIXES)})[_-])?(?:{choice(names)})(?:[_-](?:{choice(_SUFFIXES)}|\d+))*", re.IGNORECASE)


FURNITURE_NAMES, COMMENT_NAMES, HEADER_NAMES = _token(_NAMES), _token(_COMMENTS), _token("header masthead topbar")

_START = re.compile(r"<([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<([A-Za-z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([A-Za-z][^\s/>]*+)[^>]*+>")
_RAW_END = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")
_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)


class Node:
    """An element. why: None, "silent", "header" (furniture outside articles), "furniture" (by its tag or role),
    "named" (by its class or id, or a form) or "comments"."""

    __slots__ = ("tag", "children", "why", "hash", "size", "kept", "drop")

    def __init__(self, tag: str, why: str | None):
        self.tag, self.why, self.children = tag, why, []
        self.hash = self.size = self.kept = 0
        self.drop = False


def _why(tag: str, attributes: str, in_text: bool) -> str | None:
    if tag in SILENT:
        return "silent"
    why = "furniture" if tag in FURNITURE else "named" if tag == "form" else "header" if tag == "header" else None
    if tag in ("body", "html", "article", "main") or not attributes or not _TELLING.search(attributes):
        return why
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style") or ""):
        return "silent"
    role = (found.get("role") or "").lower()
    if role in ROLES:
        return "furniture"
    if in_text and tag in INLINE:
        return why
    names = [x for k in ("class", "id") if found.get(k) for x in unescape(found[k]).split()]
    if why == "furniture":
        return why
    if any(map(COMMENT_NAMES.fullmatch, names)):
        return "comments"
    if role == "form" or any(map(FURNITURE_NAMES.fullmatch, names)):
        return "named"
    return why or ("header" if any(map(HEADER_NAMES.fullmatch, names)) else None)


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and decoded texts. Any characters give some tree, in time linear
    in their number: a tag without end is the last one, and open elements are found by their kind."""
    root = Node("html", None)
    stack, at, size = [root], 0, len(html)
    opened: dict[str, list[int]] = {}
    bounds, blocks_at = [0], [0]
    text_depth = 0  # open elements in whose text an inline element's class says nothing

    def pop_to(k: int) -> None:
        nonlocal text_depth
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            text_depth -= tag in TEXT_BLOCKS or tag == "article"
        while bounds[-1] >= k:
            bounds.pop()
        while blocks_at[-1] >= k:
            blocks_at.pop()

    while at < size:
        spot = html.find("<", at)
        if spot < 0:
            break
        if spot > at:
            stack[-1].children.append(unescape(html[at:spot]))
            at = spot
        if html.startswith("<!--", spot):
            end = html.find("-->", spot + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith("<![CDATA[", spot):
            end = html.find("]]>", spot)
            stack[-1].children.append(html[spot + 9 : end if end >= 0 else size])
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith(("<!", "<?"), spot):
            end = html.find(">", spot)
            at = end + 1 if end >= 0 else size
            continue
        if ending := _END.match(html, spot):
            at, tag = ending.end(), ending[1].lower()
            if places := opened.get(tag):
                if not (tag in INLINE or tag in ("p", "li")) or bounds[-1] <= places[-1]:
                    pop_to(places[-1])
            continue
        found = _START.match(html, spot) or _LOOSE.match(html, spot)
        if not found:
            if html.find(">", spot) < 0 and html[spot + 1 : spot + 2].isalpha():
                at = size
                break
            stack[-1].children.append("<")
            at = spot + 1
            continue
        at, tag, attributes = found.end(), found[1].lower(), found[2]
        if tag == "html" and len(stack) == 1:
            continue
        ends = SELF_CLOSING.get(tag, ())
        top = stack[blocks_at[-1]].tag
        if blocks_at[-1] and (top in ends or top == "p" and tag in BREAKS_P):
            pop_to(blocks_at[-1])
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                pop_to(len(stack) - 1)
        node = Node(tag, _why(tag, attributes, text_depth > 0))
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in TEXT_BLOCKS and tag != "div":
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else size
            continue
        place = len(stack)
        stack.append(node)
        opened.setdefault(tag, []).append(place)
        text_depth += tag in TEXT_BLOCKS or tag == "article"
        if tag in BOUND:
            bounds.append(place)
        if tag not in INLINE:
            blocks_at.append(place)
    if at < size:
        stack[-1].children.append(unescape(html[at:]))
    _finish(root)
    return root


def _down(root: Node) -> list[Node]:
    """All nodes with text to read, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and c.why != "silent")
    return order


def _finish(root: Node) -> None:
    """Hash and text size of every subtree, without recursion; silent elements count for nothing."""
    for node in reversed(_down(root)):
        parts = [node.tag]
        for child in node.children:
            if isinstance(child, Node):
                if child.why != "silent":
                    parts.append(f"{child.hash:x}")
                    node.size += child.size
            elif words := " ".join(child.split()):
                parts.append("\1" + words)
                node.size += len(words)
        node.hash = xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _articles(nodes: list[Node]) -> dict[int, int]:
    """By id of each element that has some, the outermost article elements with text in it; main elements where
    a page has no article."""
    for tag in ("article", "main"):
        out: dict[int, int] = {}
        for node in reversed(nodes):
            n = 1 if node.tag == tag and node.size else sum(out.get(id(c), 0) for c in node.children if isinstance(c, Node))
            if n:
                out[id(node)] = n
        if out:
            return out
    return {}


def _marked(root: Node) -> Iterator[tuple[Node, int, bool]]:
    """(node, parent's hash, whether inside an article) of the subtrees that may be template: blocks with text,
    but less than half of the page's, or of any size beside an article. Inside one that its name tells, only the
    whole counts."""
    articles = _articles(_down(root))
    todo = [(root, 0, False)]
    while todo:
        node, parent, inside = todo.pop()
        if not node.size or node.why == "silent":
            continue
        may = 2 * node.size < root.size or bool(articles) and not inside and id(node) not in articles
        if may and node.tag not in INLINE and node.tag not in ("html", "body"):
            yield node, parent, inside
        if may and node.why in ("furniture", "named", "comments"):
            continue
        inside = inside or node.tag in ("article", "main")
        todo.extend((c, node.hash, inside) for c in node.children if isinstance(c, Node))


def _key(node: Node, inside: bool) -> int:
    return node.hash ^ -inside


def _decide(root: Node, template: frozenset[int] | set[int]) -> None:
    """Marks what goes, and counts what is kept of every subtree."""
    if template:
        for node, _, inside in _marked(root):
            node.drop = _key(node, inside) in template
    nodes = _down(root)
    articles = _articles(nodes)
    prose: dict[int, int] = {}  # text of paragraphs and headings outside all that is furniture
    for node in reversed(nodes):
        if node.why is None:
            own = node.size if node.tag in PROSE else sum(prose.get(id(c), 0) for c in node.children if isinstance(c, Node))
            if own:
                prose[id(node)] = own
    every = articles.get(id(root), 0)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.why == "furniture":
            node.drop = True
        elif node.why in ("named", "comments") and inside:
            node.drop = True
        elif node.why in ("named", "comments", "header") and not inside:
            # what its name tells goes at any size, unless the article is in it or there is no text but it
            within = articles.get(id(node), 0)
            node.drop |= every > within and not (within and node.why != "comments") if every else 2 * node.size <= root.size or (node.tag != "form" and bool(prose.get(id(root))))
        if node.tag == "article" and inside:  # an article in an article is a comment on it
            node.drop |= 2 * node.size < root.size
        inside = inside or node.tag == "article"
        todo.extend((c, inside) for c in node.children if isinstance(c, Node) and c.why != "silent")
    for node in reversed(nodes):
        node.kept = 0 if node.drop else sum(c.kept if isinstance(c, Node) else len(" ".join(c.split())) for c in node.children)


def _inner(nodes: list[Node], tag: str) -> list[Node]:
    """The outermost kept elements of a tag, in page order."""
    out, todo = [], list(reversed(nodes))
    while todo:
        node = todo.pop()
        if node.drop or node.why == "silent":
            continue
        if node.tag == tag:
            out.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def blocks(root: Node, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the article's blocks in page order, white space as single spaces."""
    _decide(root, template)
    chosen = [root]
    for tag in ("main", "article"):
        inner = _inner(chosen, tag)
        headed = any(n.tag == "h1" and n.kept for i in inner for n in _down(i))
        if inner and (headed or 2 * sum(n.kept for n in inner) >= sum(n.kept for n in chosen)):
            chosen = inner
        elif tag == "article":  # comments or teasers beside the text
            for node in inner:
                node.drop = True
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if words := "".join(run).split():
            out.append(" ".join(words))
        run.clear()

    todo: list = list(reversed(chosen))
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        else:
            block = item.tag not in INLINE
            if block:
                flush()
            if item.drop or item.why == "silent":
                continue
            if block:
                todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return out


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; the empty string if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages and, up to LEAST_PARENTS, parents of each (host, subtree, inside) of a run of pages."""
    held: dict[tuple[str, int, bool], tuple[int, set[int]]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, n, sorted(p)) for k, (n, p) in held.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["host", "subtree", "inside", "n", "parents"])

    for batch in batches:
        for part in by_bytes(batch, "html"):
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                for (key, inside), parent in {(_key(n, i), i): p for n, p, i in _marked(parse(html or ""))}.items():
                    number, parents = held.get((host, key, inside), (0, set()))
                    if len(parents) < LEAST_PARENTS:
                        parents.add(parent)
                    held[host, key, inside] = (number + 1, parents)
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, subtree) of what is template, from pages(host, html).

    A task sends one row a distinct subtree with at most LEAST_PARENTS parents, which is enough to
    tell whether there are so many; so a hot host sends a few rows a task, not a row a page."""
    counts = pages.select("host", "html").mapInArrow(_subtrees, "host string, subtree long, inside boolean, n long, parents array<long>")
    counts = counts.groupBy("host", "subtree", "inside").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("parents")))).alias("parents"))
    counts = counts.filter((F.col("n") >= LEAST_PAGES) & (F.col("parents") >= F.least(F.col("n"), F.lit(LEAST_PARENTS))))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    share = F.when(F.col("inside"), F.lit(INSIDE)).otherwise(F.lit(SHARE))
    wide = (F.col("n") >= share * F.col("pages")) & (F.col("parents") >= F.least(F.col("pages"), F.lit(LEAST_PARENTS)))
    return counts.join(sizes, "host").filter(wide).select("host", "subtree")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks (array of the article's block texts) of every row of pages(page_id, url, html).

    Null or empty html has no blocks. Pages without a host in the url, null urls too, form one host; on a host
    of fewer than LEAST_PAGES pages nothing is template. Repeated rows stay and count as pages. An empty
    table gives an empty result; other columns are ignored. Templates of few hosts are broadcast, after their
    number is known; more of them come to the pages by a join on the host and one of SALTS keys.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", host_of(F.col("url")).alias("host"))
    template = stored(site_templates(own), "templates")
    few = template.limit(FEW + 1).collect()
    shared: dict[str, set[int]] | None = {} if len(few) <= FEW else None
    if shared is None:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        sets = template.groupBy("host").agg(F.collect_list("subtree").alias("template")).select("host", "template", salts)
        own = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(sets, ["host", "salt"], "left")
    else:
        for row in few:
            shared.setdefault(row.host, set()).add(row.subtree)
        own = own.withColumn("template", F.lit(None).cast("array<bigint>"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "html"):
                host, html, sets = (part.column(c).to_pylist() for c in ("host", "html", "template"))
                texts = [blocks(parse(t or ""), set(s or ()) if shared is None else shared.get(h, frozenset())) for h, t, s in zip(host, html, sets)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.list_(pa.string()))], ["page_id", "url", "blocks"])

    return own.select("page_id", "url", "html", "host", "template").mapInArrow(read, f"page_id {kind}, url string, blocks array<string>")
