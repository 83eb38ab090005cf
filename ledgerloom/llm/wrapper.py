"""Main text of HTML pages by wrapper induction over the pages of each host.

1. A page becomes a tree of elements; inline markup belongs to the block it stands in, and a run of equal elements
   without children is one repeated node.
2. The most frequent structures of a host are merged into its wrapper: each is aligned with it by simple tree matching,
   and what has no counterpart is added as an optional node. Hosts of too few pages share one wrapper.
3. All pages of a host are aligned with the wrapper. A text that nearly all different pages have at a node is template;
   all other text varies, and its mass is summed for each node.
4. The content region is found in the wrapper: from the root, down into the child that holds most of the varying text
   of its parent, until no child does or it would be a block of text itself. Varying headings beside the way belong to it.
5. A page's content is the text of its nodes that align with the region, less template. A page that has no such node
   is its own wrapper: the same descent over its own text.

Names break ties only: an ``article`` or ``main`` element ends the descent, as it says what it is, and inside the region
elements that are named as a whole as menus, forms, adverts, notices or comments are none of the article.
"""

from __future__ import annotations

import bisect
import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, steps
from .urlfilter import host_of

#: Element names of HTML, by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, and words in class, id and role, that are no part of an article. A name counts if all its words do: ``cookie-notice`` does, ``related-work`` does not.
NO_CONTENT = frozenset("head nav header footer aside form script style noscript template title button select option textarea input svg iframe object dialog menu".split())
NO_CONTENT_WORDS = frozenset("ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus form menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget masthead".split())
BESIDE_WORDS = frozenset("area bar block body bottom box container content footer global header inner left link links list main outer page right section site top wrap wrapper".split())
SITE_WORDS = frozenset("header footer".split())
#: Of these words, those that tell that an article or main element is none.
NOT_AN_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related replies sponsored".split())
ROLES = frozenset("banner complementary contentinfo dialog form navigation search alert".split())
REGION = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: beside the way down, below the body, they belong to the content.
PROSE = HEADINGS | frozenset("p blockquote pre".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_DIGITS = re.compile(r"\d+")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Structures that a wrapper is merged from, and the pages that a host must have for one of its own.
REFERENCES, LEAST_PAGES = 8, 3
#: Share of a host's different pages, in percent, and their least number, at which an equal text at a node is template.
TEMPLATE_PERCENT, TEMPLATE_PAGES = 60, 3
#: The same inside the content region, and the most of its text, in percent, that template may hold in an article or main element, and in others: beyond it, a host's articles are near copies.
REGION_PERCENT, REGION_PAGES, ARTICLE_SHARE, REGION_SHARE = 95, 20, 50, 90
#: Share of its parent's varying text, in percent, that a child must hold to be gone into; an article or main element must hold more than any other child.
DOMINANT = 60
#: Cells of one matching table; longer lists of children are matched by the places of equal labels. Levels of a tree that are aligned.
CELLS, LEVELS = 1 << 16, 200
#: Bytes of wrappers that are broadcast; more are merged with the pages, dealt by host and salt.
BROADCAST_BYTES, SALTS = 16 << 20, 16
#: In place of a text: the page has the repeated node.
PRESENT = 0

class Node:
    """An element: label (name and first class), children, and its own text in pieces between them (as (child index, text))."""

    __slots__ = ("attributes", "children", "label", "name", "own")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes = name, attributes
        first = attributes.get("class", "").split()[:1] or [attributes.get("id", "")]
        self.label = f"{name}.{_DIGITS.sub('#', first[0])}" if first[0] else name
        self.children: list[Node] = []
        self.own: list[tuple[int, str]] = []

    def text(self) -> str:
        return " ".join("".join(t for _, t in self.own).split())

    def whole_text(self) -> str:
        """Its own text and that of all below it."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            out.append(node.text())
            todo.extend(reversed(node.children))
        return " ".join(x for x in out if x)


def parse(source: str) -> Node:
    """The tree of a page; broken markup is read leniently, character references are decoded. Line breaks are white space."""
    root = Node("#root", {})
    stack = [root]

    def add(text: str) -> None:
        if text:
            stack[-1].own.append((len(stack[-1].children), text))

    at, raw = 0, None
    while at < len(source):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(source, at)
            text, at = (source[at : end.start()], end.end()) if end else (source[at:], len(source))
            if raw in ("title", "textarea"):
                add(html_lib.unescape(text))
            stack.pop()
            raw = None
            continue
        m = _TOKEN.match(source, at)
        at = m.end()
        if m[2] is None:
            if not m[0].startswith("<") or m[0] == "<":
                add(html_lib.unescape(m[0]))
            continue
        name = m[2].lower()
        if name in INLINE:  # its text belongs to the block around it; marked ones are elements of their own
            if m[1]:
                if any(x.name == name for x in stack[1:]):
                    while stack[-1].name in INLINE and stack[-1].name != name:
                        stack.pop()
                    if stack[-1].name == name:
                        stack.pop()
                continue
            if "=" not in (m[3] or ""):
                continue
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[3])}
            if attributes and excluded(name, attributes):
                stack[-1].children.append(node := Node(name, attributes))
                stack.append(node)
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            else:
                add(" ")
            continue
        if name in VOID:
            add(" ")
            continue
        if name in CLOSES_P:
            _close(stack, "p")
        elif name in ("li", "dt", "dd", "option", "tr", "td", "th"):
            _close(stack, name, "ul", "ol", "dl", "table", "select")
        node = Node(name, {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[3])} if m[3] else {})
        stack[-1].children.append(node)
        if m[3].endswith("/") and name in ("svg", "path"):
            continue
        stack.append(node)
        raw = name if name in RAW else None
    return root


def _close(stack: list[Node], name: str, *until: str) -> None:
    """End the nearest open element of that name, unless it is outside of one in ``until`` or of a section."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if stack[k].name in until or (not until and stack[k].name not in INLINE):
            return


def excluded(name: str, attributes: dict[str, str]) -> bool:
    """Does an element's name, or a class, id or role as a whole, say that it is no part of an article?"""
    if name in NO_CONTENT:
        return True
    if not attributes or name in ("html", "body"):
        return False
    if attributes.get("role", "").lower() in ROLES:
        return True
    for token in (t for k in ("class", "id") for t in attributes.get(k, "").lower().split()):
        parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        if name in REGION:
            if parts and all(w in NOT_AN_ARTICLE or w in BESIDE_WORDS for w in parts) and any(w in NOT_AN_ARTICLE for w in parts):
                return True
        elif parts and all(w in NO_CONTENT_WORDS or w in BESIDE_WORDS for w in parts) and (any(w in NO_CONTENT_WORDS for w in parts) or any(w in SITE_WORDS for w in parts)):
            return True
    return False


class View:
    """A node as it is aligned: one element, or a run of equal ones without children (``members``). ``number`` is its place in page order."""

    __slots__ = ("children", "cut", "label", "leaf", "members", "name", "number")

    def __init__(self, label: str, leaf: bool, members: list[Node]):
        self.label, self.leaf, self.members = label, leaf, members
        self.name = label.split(".", 1)[0]
        self.children: list[View] = []
        self.number, self.cut = -1, False

    def texts(self) -> list[str]:
        return [t for t in (m.whole_text() if self.cut else m.text() for m in self.members) if t]


def view_of(root: Node) -> View:
    """The tree as it is aligned; below ``LEVELS`` levels nothing is."""
    top = View(root.label, False, [root])
    todo = [(top, root, 0)]
    while todo:
        view, node, level = todo.pop()
        if level == LEVELS:
            view.cut = True  # what is below counts as its text
            continue
        for child in node.children:
            leaf, last = not child.children, view.children[-1] if view.children else None
            if leaf and last is not None and last.leaf and last.label == child.label:
                last.members.append(child)
                continue
            view.children.append(own := View(child.label, leaf, [child]))
            if not leaf:
                todo.append((own, child, level + 1))
    return top


def number(tree: View) -> list[View]:
    """The nodes in page order, numbered."""
    out, todo = [], [tree]
    while todo:
        view = todo.pop()
        view.number = len(out)
        out.append(view)
        todo.extend(reversed(view.children))
    return out


def packed(tree: View) -> str:
    """A tree's structure as text: depth, leaf or not, and label of each node in page order."""
    out, todo = [], [(tree, 0)]
    while todo:
        view, depth = todo.pop()
        out.append(f"{depth}{'-' if view.leaf else '+'}{view.label}")
        todo.extend((c, depth + 1) for c in reversed(view.children))
    return "\n".join(out)


def unpacked(text: str) -> View:
    path: list[View] = []
    for line in text.split("\n"):
        depth, leaf, label = re.fullmatch(r"(\d+)([-+])(.*)", line, re.S).groups()
        view = View(label, leaf == "-", [])
        del path[int(depth) :]
        if path:
            path[-1].children.append(view)
        path.append(view)
    return path[0]


class Matcher:
    """Simple tree matching of two trees: a pair of nodes with equal labels scores one and the best matching, in order, of its children; others score nothing."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def score(self, a: View, b: View) -> int:
        if a.label != b.label:
            return 0
        key = (id(a), id(b))
        if key not in self.known:
            self.known[key] = 1 + sum(self.score(p, q) for p, q in self.children(a, b))
        return self.known[key]

    def children(self, a: View, b: View) -> list[tuple[View, View]]:
        """The pairs of children in the best matching that keeps their order."""
        x, y = a.children, b.children
        if not x or not y:
            return []
        mine, theirs = [v.label for v in x], [v.label for v in y]
        if mine == theirs and len(set(mine)) == len(mine):
            return list(zip(x, y, strict=True))  # no other matching is as large at any pair
        if len(x) * len(y) > CELLS:
            return _by_place(x, y)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            row, above = best[i + 1], best[i]
            for j, q in enumerate(y):
                row[j + 1] = max(above[j + 1], row[j], above[j] + self.score(p, q) if p.label == q.label else 0)
        out, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[i], y[j]))
        return out[::-1]


def _by_place(x: list[View], y: list[View]) -> list[tuple[View, View]]:
    """Equal labels in order, each with the next one of its kind that the other list has: no table for very long lists."""
    places: dict[str, list[int]] = {}
    for j, v in enumerate(y):
        places.setdefault(v.label, []).append(j)
    out, at = [], -1
    for v in x:
        later = places.get(v.label, [])
        k = bisect.bisect_right(later, at)
        if k < len(later):
            at = later[k]
            out.append((v, y[at]))
    return out


def align(page: View, wrapper: View) -> list[tuple[View, View]]:
    """Aligned nodes, from the roots down."""
    matcher, out, todo = Matcher(), [], [(page, wrapper)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        todo.extend(matcher.children(a, b))
    return out


def merge(wrapper: View, other: View) -> None:
    """Add to ``wrapper`` what ``other`` has beyond it: each node behind the last one before it that aligns."""
    for a, b in align(other, wrapper):
        partner = {id(p): q for p, q in Matcher().children(a, b)}
        at = 0
        for child in a.children:
            if id(child) in partner:
                at = next(i for i, v in enumerate(b.children) if v is partner[id(child)]) + 1
            else:
                b.children.insert(at, child)
                at += 1


def find_region(tree: View, mass: dict[int, int]) -> list[int]:
    """Numbers of the nodes that are the content region of a numbered tree; ``mass``: varying text of each node. Empty without any."""
    nodes = number(tree)
    below = [mass.get(v.number, 0) for v in nodes]
    for v in reversed(nodes):
        below[v.number] += sum(below[c.number] for c in v.children)
    if not below[0]:
        return []
    beside, at, inside = [], tree, False
    while at.name not in REGION and at.children:
        best = max(at.children, key=lambda c: below[c.number])
        own = mass.get(best.number, 0)
        if best.name not in REGION and (100 * below[best.number] < DOMINANT * below[at.number] or 2 * own > below[best.number]):
            break  # no child holds it all, or the one that does is a block of text
        kinds = PROSE if inside else HEADINGS
        beside += [c.number for c in at.children if c is not best and c.leaf and c.name in kinds and mass.get(c.number, 0)]
        inside = inside or at.name == "body"
        at = best
    return sorted([*beside, at.number])


def hash_text(text: str) -> int:
    import xxhash

    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)) or 1


def own_mass(view: View) -> dict[int, int]:
    """Text of each node of one page that is not excluded by its name: the mass where there is no wrapper."""
    mass, todo = {}, [view]
    while todo:
        v = todo.pop()
        kept = [m for m in v.members if not excluded(m.name, m.attributes)]
        if kept:
            mass[v.number] = sum(len(m.whole_text() if v.cut else m.text()) for m in kept)
            todo.extend(v.children)
    return mass


def content(region: list[Node], template: dict[int, set[int]]) -> str:
    """The text of the region's nodes: blocks in page order, one space between. template: hashes of a node's (by identity) texts that are none."""
    blocks: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(pieces).split()):
            blocks.append(text)
        pieces.clear()

    for top in region:
        if excluded(top.name, top.attributes):
            continue
        todo = [(top, 0, 0)]  # (node, next child, next piece of its own text)
        while todo:
            node, child, piece = todo.pop()
            while piece < len(node.own) and node.own[piece][0] <= child:
                if id(node) not in template or hash_text(node.text()) not in template[id(node)]:
                    pieces.append(node.own[piece][1])
                piece += 1
            if child < len(node.children):
                todo.append((node, child + 1, piece))
                below = node.children[child]
                if below.name not in INLINE:
                    flush()
                if not excluded(below.name, below.attributes):
                    todo.append((below, 0, 0))
            elif node.name not in INLINE:
                flush()
        flush()
    return " ".join(blocks)


@dataclass
class Wrapper:
    """A host's wrapper: its tree, the numbers of its region, and texts (hashes) at its nodes that are template."""

    tree: View
    region: list[int]
    template: dict[int, set[int]]


def main_text(source: str, wrapper: Wrapper | None) -> str:
    """A page's content: where its nodes align with the wrapper's region, else by its own text."""
    page = view_of(parse(source))
    nodes = number(page)
    found: list[View] = []
    template: dict[int, set[int]] = {}
    if wrapper is not None and wrapper.region:
        region = set(wrapper.region)
        for a, b in align(page, wrapper.tree):
            if b.number in region:
                found.append(a)
            if b.number in wrapper.template:
                template.update({id(m): wrapper.template[b.number] for m in a.members})
        if not any(b.leaf is False or len(wrapper.region) == 1 for b in found):
            found = []  # a heading alone is no region
    if not found:
        found = [nodes[i] for i in find_region(page, own_mass(page))]
    found.sort(key=lambda v: v.number)
    return content([m for v in found for m in v.members], template)


def _with_wrapper(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages with their host's wrapper, or the shared one. wrappers: host, wrapper and more; their size decides how they meet."""
    size = wrappers.agg(F.sum(F.length("wrapper")).alias("n")).first().n or 0
    shared = wrappers.filter("host = ''").select(*[F.col(c).alias(f"_{c}") for c in wrappers.columns if c != "host"])  # one row
    own = wrappers.filter("host != ''")
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(own), "host", "left")
    else:
        copies = own.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(copies.hint("merge"), ["host", "_salt"], "left").drop("_salt")
    joined = joined.join(F.broadcast(shared), F.lit(True), "left")
    has = F.col("wrapper").isNotNull()
    rows = joined.withColumn("host", F.when(has, F.col("host")).otherwise(""))
    for c in wrappers.columns:
        if c != "host":
            rows = rows.withColumn(c, F.when(has, F.col(c)).otherwise(F.col(f"_{c}"))).drop(f"_{c}")
    return rows


class _Wrappers:
    """The last few wrappers, by host; rows bring theirs along."""

    def __init__(self) -> None:
        self.known: dict[str, Wrapper | None] = {}

    def __call__(self, host: str, tree: str | None, region: list | None = None, template: list | None = None) -> Wrapper | None:
        if host not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            self.known[host] = self._read(tree, region, template)
        return self.known[host]

    @staticmethod
    def _read(tree: str | None, region: list | None, template: list | None) -> Wrapper | None:
        if not tree:
            return None
        out = Wrapper(unpacked(tree), list(region or []), {})
        number(out.tree)
        for x in template or []:
            out.template.setdefault(x["node"], set()).add(x["text"])
        return out


def structures(pages: DataFrame) -> DataFrame:
    """The wrapper tree of each host with enough pages, and of the others together (host ''): host and wrapper (packed)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in steps(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([packed(view_of(parse(x))) for x in batch.column("html").to_pylist()], pa.string())], names=["host", "wrapper"])

    found = pages.select("host", "html").mapInArrow(run, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    found = materialize(found, "structures")
    large = found.groupBy("host").agg(F.sum("n").alias("pages")).filter((F.col("pages") >= LEAST_PAGES) & (F.col("host") != "")).select("host")
    few = found.join(large, "host", "left_anti").groupBy("wrapper").agg(F.sum("n").alias("n")).select(F.lit("").alias("host"), "wrapper", "n")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "wrapper"))
    best = found.join(large, "host", "left_semi").select("host", "wrapper", "n").unionByName(few).withColumn("_r", rank).filter(F.col("_r") <= REFERENCES)
    lists = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("_r", "wrapper"))).alias("w"))  # a few structures

    def together(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            trees = []
            for own in batch.column("w").to_pylist():
                tree = unpacked(own[0]["wrapper"])
                for x in own[1:]:
                    merge(tree, unpacked(x["wrapper"]))
                trees.append(packed(tree))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], names=["host", "wrapper"])

    out = materialize(lists.mapInArrow(together, "host string, wrapper string"), "wrapper-trees")
    discard(found)
    return out


WRAPPERS = "host string, wrapper string, region array<int>, template array<struct<node: int, text: long>>"


def induce(pages: DataFrame) -> DataFrame:
    """The wrapper of each host: host, wrapper (its packed tree), region (numbers of its nodes) and template (node, text).

    pages: page_id, host, html. Texts are counted over all pages of the host; pages with the same longest block, copies of
    an article under whatever menus, count once.
    """
    some = pages.filter("html is not null and html != ''")
    trees = structures(some)

    def texts(batches: Iterator[pa.RecordBatch]):
        wrapper_of = _Wrappers()
        for batch in steps(batches, "html"):
            out: list[tuple] = []
            for host, source, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                wrapper = wrapper_of(host, tree)
                page = view_of(parse(source))
                key = hash_text(max((t for v in number(page) for t in v.texts()), key=len, default=""))
                for a, b in align(page, wrapper.tree):
                    own = a.texts()
                    out += [(host, b.number, hash_text(t), len(t), key) for t in own]
                    if own and b.leaf:
                        out.append((host, b.number, PRESENT, 0, key))
                if len(out) > 50_000:
                    yield _columns(out)
                    out = []
            if out:
                yield _columns(out)

    found = _with_wrapper(some, trees).select("host", "html", "wrapper").mapInArrow(texts, "host string, node int, text long, length int, page long")
    once = materialize(found.distinct().groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.max("length").alias("length")), "slots")
    present = F.max(F.when(F.col("text") == PRESENT, F.col("n")))
    nodes = once.groupBy("host", "node").agg(F.coalesce(present, F.sum("n")).alias("pages"), F.sum(F.col("n") * F.col("length")).alias("chars"))
    same = once.filter(f"text != {PRESENT} and n >= {TEMPLATE_PAGES}").join(nodes.select("host", "node", "pages"), ["host", "node"]).filter(f"100 * n >= {TEMPLATE_PERCENT} * pages")
    same = same.groupBy("host", "node").agg(F.sum(F.col("n") * F.col("length")).alias("fixed"), F.collect_list(F.struct("text", "n", "length")).alias("same"))  # texts that most pages share
    facts = nodes.join(same, ["host", "node"], "left").groupBy("host").agg(F.collect_list(F.struct("node", "pages", "chars", "fixed", "same")).alias("facts"))  # a row per node of one wrapper

    def decide(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            regions, templates = [], []
            for tree, known in zip(batch.column("wrapper").to_pylist(), batch.column("facts").to_pylist(), strict=True):
                region, template = settled(unpacked(tree), known or [])
                regions.append(region)
                templates.append(template)
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("wrapper"), pa.array(regions, pa.list_(pa.int32())), pa.array(templates, pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64())])))], names=["host", "wrapper", "region", "template"])

    out = materialize(trees.join(facts, "host", "left").mapInArrow(decide, WRAPPERS), "wrappers")
    discard(trees, once)
    return out


def settled(tree: View, facts: list[dict]) -> tuple[list[int], list[dict]]:
    """(region, template) of a wrapper from what its nodes hold: node, pages, chars, fixed and same (text, n, length)."""
    inside, nodes = set(), number(tree)
    named, todo = set(), [(tree, False)]
    while todo:
        v, own = todo.pop()
        own = own or v.name in REGION
        named |= {v.number} if own else set()
        todo.extend((c, own) for c in v.children)
    # what an article element holds is content also where copies repeat it
    region = find_region(tree, {x["node"]: x["chars"] - (0 if x["node"] in named else x["fixed"] or 0) for x in facts})
    todo = [nodes[i] for i in region]
    while todo:
        v = todo.pop()
        inside.add(v.number)
        todo.extend(v.children)
    within = [x for x in facts if x["node"] in inside]
    pages = max((x["pages"] for x in within), default=0)
    fixed = [(x["node"], t) for x in within for t in x["same"] or [] if t["n"] >= REGION_PAGES and 100 * t["n"] >= REGION_PERCENT * pages]
    share = ARTICLE_SHARE if any(nodes[i].name in REGION for i in region) else REGION_SHARE
    if 100 * sum(t["n"] * t["length"] for _, t in fixed) > share * sum(x["chars"] for x in within):
        fixed = []  # near copies of one article
    return region, [{"node": node, "text": t["text"]} for node, t in fixed]


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    host, node, text, length, page = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(node, pa.int32()), pa.array(text, pa.int64()), pa.array(length, pa.int32()), pa.array(page, pa.int64())], names=["host", "node", "text", "length", "page"])


def extract(pages: DataFrame, host: Column | None = None, wrappers: DataFrame | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html).

    Null and empty pages have an empty text. Pages without a host, and hosts of fewer than ``LEAST_PAGES`` pages, share one
    wrapper. Repeated rows get equal texts, an empty table gives none, further columns are ignored. wrappers: those of
    ``induce`` (by default induced from these pages).
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string"), (host if host is not None else host_of(F.col("url"))).alias("host"))
    known = wrappers if wrappers is not None else induce(rows)

    def run(batches: Iterator[pa.RecordBatch]):
        wrapper_of = _Wrappers()
        for batch in steps(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("host", "html", "wrapper", "region", "template"))
            texts = [main_text(source, wrapper_of(name, tree, region, template)) if source else "" for name, source, tree, region, template in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    found = _with_wrapper(rows, known).select("page_id", "url", "html", "host", "wrapper", "region", "template").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
    return materialize(found, "texts")  # in small batches: pages come with their wrapper
