"""Main text of web pages by wrapper induction (operator 9).

1. Each page's DOM is reduced to a small tree: neighbours of one label (tag and class names) that
   are text by their tag (paragraphs, list items) become one repeated node, other siblings stay apart.
2. Trees of a host are aligned by simple tree matching with the host's most frequent tree.  A node's
   place is its partner there; a node without one is named by its parent's place, its label and its
   rank among such siblings, so that nodes which that tree lacks are counted as well.
   Nodes of all pages are counted as grouped rows (host, place, text).  A node that enough
   pages of a host have, always with the same own text, is constant; the share is applied once, to
   the counts of all pages, so nothing depends on partitions or order.  Pages with the same article
   (its text before template goes) count as one page together, so copies don't make a template.
3. A page is aligned with its host's template.  Constant nodes are template.  Varying slots are
   content unless they hang below a part that isn't article by its meaning: menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, comments.  If the page has an ``article``
   or ``main`` part, only what lies in it is content.
4. Words of class and id are hints only (``has-sidebar``, ``comments-open``).  They never count for
   ``html``, ``body``, ``main``, ``article`` and what holds the main part, nor for the part that has
   the body of the text by its place: at least half of the text that pages of the host don't share,
   and at least twice what comes before it.  Of an article's own header, headings are kept.

Headings, paragraphs and list items inside an ``article`` or ``main`` are content even if all pages
of a host share them, so only other constant nodes (share bars, bylines in ``div``) go.  Without
such a part, blocks whose whole text is constant go, but for headings beside varying text.

Text: character references decoded, white space inside a block turned into one space, blocks
trimmed and joined by an empty line in page order.

Cases: null html counts as empty and gives an empty text; a null url is the host ""; unclosed and
misnested tags close as browsers do for paragraphs, lists and tables; copies of a page count as one
page; nodes more than ``DEEPEST`` deep become siblings; equally frequent trees of a host: the
largest is used; a host with one page has no constant nodes; empty tables give empty results; other
columns are not looked at.
"""

from __future__ import annotations

import functools
import html as htmllib
import itertools
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .urls import parse as parse_url

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
th thead title tr ul""".split())
CLOSES_P = BLOCK - frozenset("body dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
#: Opening one of these closes an open one of the second set, up to the third.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Parts that are not article, by tag, role, and words of class and id.
NOT_ARTICLE_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea input head title dialog menu object canvas".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOT_ARTICLE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments
commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe signup login pagination pager skip widget""".split())
CONTENT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote td th figcaption b i em strong a span code".split())
#: Neighbours of one label among these are one repeated node.
REPEATED = CONTENT_TAGS | VOID | {"tr", "option"}
#: Parts that class and id say nothing about, headings, and words of a header.
STRUCTURE, HEADINGS, HEADER = frozenset("#page html body main article".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset({"header"})
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Deeper nodes become siblings, as in browsers; their text is kept.
DEEPEST = 200


class Node:
    __slots__ = ("tag", "names", "role", "kids", "label")

    def __init__(self, tag: str, names: frozenset = frozenset(), role: str = ""):
        self.tag, self.names, self.role, self.kids = tag, names, role, []
        self.label = tag + "".join("." + n for n in sorted(names))

    def not_article(self) -> bool:
        """By tag and role."""
        return self.tag in NOT_ARTICLE_TAGS or self.role in NOT_ARTICLE_ROLES

    def is_main(self) -> bool:
        return self.tag in ("article", "main") or self.role in ("article", "main")

    def words(self) -> frozenset:
        """Words of class and id that hint at other parts than the article."""
        found = self.names & NOT_ARTICLE_WORDS
        return found - HEADER if self.tag in HEADINGS else found

    def own_header(self) -> bool:
        return self.role not in NOT_ARTICLE_ROLES and self.words() <= HEADER and (self.tag == "header" or (self.tag not in NOT_ARTICLE_TAGS and bool(self.words())))


def parse(page: str) -> Node:
    """A tolerant DOM: nodes with children and text strings (character references still encoded)."""
    root = Node("#page")
    stack, at, n = [root], 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].kids.append(page[at:])
            break
        if lt > at:
            stack[-1].kids.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page.find(">", lt) < 0 and re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):
                break  # a tag cut off at the end
            stack[-1].kids.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag == "p" and stack[i].tag in ("div", "article", "section", "body"):
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in IMPLIED:
            shut, scope = IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in shut:
                    del stack[i:]
                    break
        names, role = frozenset(), ""
        if rest and ("=" in rest or "hidden" in rest):
            found = [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(rest)]
            names = frozenset(w for k, v in found if k in ("class", "id") for w in _WORD.findall(v.lower()))
            role = next((v.lower() for k, v in found if k == "role"), "")
        node = Node(tag, names, role)
        stack[-1].kids.append(node)
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            stop = m.start() if m else n
            node.kids.append(page[at:stop])
            at = m.end() if m else n
        elif tag not in VOID and not rest.endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


# ------------------------------------------------------------------ reduced trees
def key(text: str) -> int:
    """64 bits of a text, 0 for an empty one."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if text else 0


_label_key = functools.lru_cache(1 << 14)(key)


def reduced(page: Node) -> tuple[list[int], list[int], list[int], list[list[Node]]]:
    """(labels, depths, own texts, nodes) of a page's reduced tree in page order; labels and texts as 64-bit keys.

    Neighbours of one label that are text by their tag (paragraphs, list items, rows) are one repeated
    node; inside such a node, all children of one label are.  Every other sibling stands for itself.
    """
    labels, depths, texts, found = [], [], [], []
    todo = [([page], 0)]
    while todo:
        nodes, depth = todo.pop()
        joined = len(nodes) > 1 or nodes[0].tag in CONTENT_TAGS
        text: list[str] = []
        groups: list[list[Node]] = []
        by_label: dict[str, list[Node]] = {}
        for node in nodes:
            for kid in node.kids:
                if isinstance(kid, str):
                    text.append(kid)
                elif joined and kid.label in by_label:
                    by_label[kid.label].append(kid)
                elif not joined and kid.tag in REPEATED and groups and groups[-1][0].label == kid.label:
                    groups[-1].append(kid)
                else:
                    groups.append([kid])
                    by_label[kid.label] = groups[-1]
        labels.append(_label_key(nodes[0].label))
        depths.append(depth)
        texts.append(key(" ".join("".join(text).split())))
        found.append(nodes)
        todo.extend((g, depth + 1) for g in reversed(groups))
    return labels, depths, texts, found


# ------------------------------------------------------------------ simple tree matching
class Aligner:
    """Places of pages' nodes in a host's tree, found by simple tree matching.

    A matching pairs roots of one label and, in order, children whose subtrees match, so that most
    nodes are paired.  Subtrees are numbered by shape: equal ones match whole, at both ends of two rows
    of children without a search, and two shapes are matched once.  Rows are cut in halves
    (Hirschberg), so memory is linear in their length.
    """

    def __init__(self, labels: list[int], depths: list[int]):
        self.numbers: dict[tuple, int] = {}
        self.label: list[int] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.known: dict[tuple, list[int]] = {}
        self.seed = labels, depths
        self.tree = self.read(labels, depths)

    def read(self, labels: list[int], depths: list[int]) -> tuple[list[list[int]], list[int]]:
        """(children, shape) of each node of a tree in page order."""
        kids: list[list[int]] = [[] for _ in labels]
        above: list[int] = []
        for i, depth in enumerate(depths):
            del above[depth:]
            if above:
                kids[above[-1]].append(i)
            above.append(i)
        shape = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            form = labels[i], tuple(shape[k] for k in kids[i])
            if form not in self.numbers:
                self.numbers[form] = len(self.size)
                self.label.append(form[0])
                self.kids.append(form[1])
                self.size.append(1 + sum(self.size[k] for k in form[1]))
            shape[i] = self.numbers[form]
        return kids, shape

    def matched(self, a: int, b: int) -> int:
        """Most nodes that a matching of two shapes pairs, 0 if their roots differ."""
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        if (a, b) not in self.weights:
            found = 1 + sum(self.matched(x, y) for x, y in self._paired(self.kids[a], self.kids[b]))
            if len(self.weights) > 1_000_000:
                self.weights.clear()
            self.weights[a, b] = found
        return self.weights[a, b]

    def _paired(self, xs, ys) -> list[tuple[int, int]]:
        return [(xs[i], ys[j]) for i, j in self.pairs(xs, ys)]

    def _best(self, xs, ys) -> np.ndarray:
        """Most nodes paired between all of ``xs`` and each beginning of ``ys``."""
        place: dict[int, int] = {}
        at = np.array([place.setdefault(y, len(place)) for y in ys])
        best = np.zeros(len(ys) + 1, np.int64)
        for x in xs:
            weight = np.array([self.matched(x, y) for y in place])[at]
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + weight))
        return best

    def pairs(self, xs, ys) -> list[tuple[int, int]]:
        """Places paired by the ordered matching of two rows of shapes that pairs most nodes."""
        both = {self.label[x] for x in xs} & {self.label[y] for y in ys}
        at = [i for i, x in enumerate(xs) if self.label[x] in both]
        to = [j for j, y in enumerate(ys) if self.label[y] in both]
        xs, ys = [xs[i] for i in at], [ys[j] for j in to]
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            while a < b and c < d and xs[a] == ys[c]:
                out.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and xs[b - 1] == ys[d - 1]:
                b, d = b - 1, d - 1
                out.append((b, d))
            if a == b or c == d:
                continue
            if b - a == 1:
                weight = [self.matched(xs[a], y) for y in ys[c:d]]
                if max(weight):
                    out.append((a, c + weight.index(max(weight))))
                continue
            mid = (a + b) // 2
            front = self._best(xs[a:mid], ys[c:d])
            back = self._best(xs[mid:b][::-1], ys[c:d][::-1])[::-1]
            cut = c + int(np.argmax(front + back))
            todo += [(a, mid, c, cut), (mid, b, cut, d)]
        return sorted((at[i], to[j]) for i, j in out)

    def places(self, labels: list[int], depths: list[int]) -> list[int]:
        """Place of each node: its partner's in the host's tree, else a key of its parent's place, its label and its rank among such siblings."""
        form = tuple(labels), tuple(depths)
        if form in self.known:
            return self.known[form]
        if len(self.numbers) > 200_000 or len(self.known) > 200:  # shapes of earlier pages
            self.__init__(*self.seed)
        kids, shape = self.read(labels, depths)
        seed_kids, seed_shape = self.tree
        out = [0] * len(labels)
        todo: list[tuple[int, int | None]] = [(0, 0)]
        while todo:
            i, partner = todo.pop()
            others = [] if partner is None else seed_kids[partner]
            mine = dict(self.pairs([shape[k] for k in kids[i]], [seed_shape[k] for k in others]))
            rank: dict[int, int] = {}
            for n, k in enumerate(kids[i]):
                if n in mine:
                    out[k] = others[mine[n]]
                    todo.append((k, out[k]))
                else:
                    rank[labels[k]] = rank.get(labels[k], 0) + 1
                    out[k] = key(f"{out[i]} {labels[k]} {rank[labels[k]]}")
                    todo.append((k, None))
        self.known[form] = out
        return out


# ------------------------------------------------------------------ extraction
def weigh(page: Node, common: set[int]) -> tuple[dict[int, int], set[int]]:
    """Characters of each node outside of menus, forms and the like and of ``common`` nodes' own text; nodes that hold the main part.

    The main part is every ``main`` and the largest ``article``.
    """
    weight: dict[int, int] = {}
    mains: list[tuple[Node, list[int]]] = []
    above: list[int] = []

    def of(node: Node) -> int:
        total = 0
        if not node.not_article():
            if node.is_main():
                mains.append((node, list(above)))
            above.append(id(node))
            own = 0 if id(node) in common else 1
            total = sum(own * len("".join(k.split())) if isinstance(k, str) else of(k) for k in node.kids)
            above.pop()
        weight[id(node)] = total
        return total

    of(page)
    articles = [m for m in mains if m[0].tag == "article" or m[0].role == "article"]
    largest = max(articles, key=lambda m: weight[id(m[0])], default=None)
    return weight, {i for m in mains if m not in articles or m is largest for i in m[1]}


def _headings(node: Node) -> list[Node]:
    out: list[Node] = []
    for kid in node.kids:
        if isinstance(kid, Node) and not kid.not_article() and kid.words() <= HEADER:
            out += [kid] if kid.tag in HEADINGS else _headings(kid)
    return out


def settled(page: Node, common: set[int]) -> set[int]:
    """Nodes with text whose whole text, own and below, is in ``common`` nodes."""
    out: set[int] = set()

    def of(node: Node) -> tuple[bool, bool]:
        """(some text, all of it common)"""
        if node.not_article():
            return False, True
        own = any(isinstance(k, str) and not k.isspace() for k in node.kids)
        below = [of(k) for k in node.kids if isinstance(k, Node)]
        some, same = own or any(x for x, _ in below), (not own or id(node) in common) and all(y for _, y in below)
        if some and same:
            out.add(id(node))
        return some, same

    of(page)
    return out


def blocks(page: Node, shared: list[list[Node]] | None) -> list[str]:
    """The article's blocks of a page, given its nodes that are constant in its host's template."""
    common: set[int] = set()    # nodes of this page whose own text its host's pages share
    constant: set[int] = set()  # those of them that are template
    for nodes in shared or ():
        common.update(map(id, nodes))
        if nodes[0].tag not in CONTENT_TAGS:
            constant.update(map(id, nodes))
    weight, holders = weigh(page, common)
    hinted = lambda node: node.tag not in STRUCTURE and not node.is_main() and id(node) not in holders and bool(node.words())
    # by its place, a part has the body of the text
    body = lambda node, root, seen: weight[id(node)] >= max(weight[id(root)] / 2, 2 * seen, 1)
    roots, stack = [], [page]
    while stack:  # the outermost article or main parts, in page order
        node = stack.pop()
        if node.not_article() or (hinted(node) and not body(node, page, 0)):
            continue
        if node.is_main():
            roots.append(node)
        else:
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(htmllib.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    # without a main part to go by, constant blocks are template whole, but for headings
    whole = settled(page, common) if common and not roots else set()
    for root in roots or [page]:
        seen, todo = 0, [root]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
                continue
            elif x.not_article() or (hinted(x) and not body(x, root, seen)) or (id(x) in whole and x.tag in BLOCK and x.tag not in HEADINGS):
                if x.tag in BLOCK:
                    flush()
                if root.is_main() and x.own_header():
                    todo.extend(reversed(_headings(x)))
            elif x.tag == "br":
                line.append("\n")
            else:
                block = x.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                drop = id(x) in constant
                own = [k for k in x.kids if isinstance(k, str)]
                todo.extend(k for k in reversed(x.kids) if not (drop and isinstance(k, str)))
                if id(x) not in common:
                    seen += sum(len("".join(k.split())) for k in own)
        flush()
    return out


#: Bytes of templates, and of articles with copies, up to which they are sent to all executors; beyond, pages are joined with them by shuffle.
BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame, row_bytes) -> DataFrame:
    """Stored ``df``, to be broadcast if its size allows it."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32()), pa.array([x for r in rows for x in r], kind))


class _Hosts:
    """Aligners of the hosts that a task meets; the oldest go when they are many."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def of(self, host: str, make) -> tuple:
        if host not in self.known:
            if len(self.known) >= 20:
                del self.known[next(iter(self.known))]
            self.known[host] = make()
        return self.known[host]


def induce(pages: DataFrame, min_pages: int = 3, share: float = 0.5) -> DataFrame:
    """(host, labels, depths, constant): the tree of each host with constant nodes and their places, of (host, html) rows.

    The tree that pages are aligned with is the host's most frequent one (ties: the largest).
    """
    def run(batches):
        for batch in batches:
            parsed = [parse(html) for html in batch.column(1).to_pylist()]
            found = [reduced(page)[:3] for page in parsed]
            articles = pa.array([key("\n\n".join(blocks(page, None))) for page in parsed], pa.int64())
            columns = [_lists([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), articles, *columns], names=["host", "article", "labels", "depths", "texts"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, article long, labels array<long>, depths array<int>, texts array<long>")
    rows = stored(rows.withColumn("shape", F.xxhash64("labels", "depths")), "nodes")
    articles = stored(rows.groupBy(F.col("host").alias("a_host"), F.col("article").alias("a_article")).agg(F.count("*").alias("copies")), "articles")
    totals = articles.groupBy(F.col("a_host").alias("t_host")).agg(F.count("*").alias("total"))
    copies = _small(articles.filter("copies > 1"), F.octet_length("a_host") + 32)
    rows = rows.join(copies, (F.col("host") == F.col("a_host")) & (F.col("article") == F.col("a_article")), "left").withColumn("part", 1 / F.coalesce("copies", F.lit(1)))

    shapes = rows.groupBy("host", "shape").agg(F.round(F.sum("part"), 6).alias("pages"), F.max(F.size("labels")).alias("size"))
    shapes = shapes.groupBy(F.col("host").alias("s_host")).agg(F.max(F.struct("pages", "size", "shape"))["shape"].alias("s_shape"))
    shapes = _small(stored(shapes, "shapes"), F.octet_length("s_host") + 16)
    seeds = rows.join(shapes, (F.col("host") == F.col("s_host")) & (F.col("shape") == F.col("s_shape"))).groupBy("s_host").agg(F.min(F.struct("labels", "depths")).alias("seed"))
    seeds = stored(seeds.select("s_host", F.col("seed.labels").alias("s_labels"), F.col("seed.depths").alias("s_depths")), "seeds")
    sent = _small(seeds, 12 * F.size("s_labels") + F.octet_length("s_host"))

    def place(batches):
        hosts = _Hosts()
        for batch in batches:
            host, labels, depths, seed_labels, seed_depths = (batch.column(i) for i in (0, 2, 3, 5, 6))
            out = []
            for i, name in enumerate(host.to_pylist()):
                aligner = hosts.of(name, lambda: Aligner(seed_labels[i].as_py(), seed_depths[i].as_py()))
                out.append(aligner.places(labels[i].as_py(), depths[i].as_py()))
            yield pa.RecordBatch.from_arrays([host, batch.column(1), _lists(out, pa.int64()), batch.column(4)], names=["host", "part", "places", "texts"])

    nodes = rows.join(sent, F.col("host") == F.col("s_host")).select("host", "part", "labels", "depths", "texts", "s_labels", "s_depths")
    nodes = nodes.mapInArrow(place, "host string, part double, places array<long>, texts array<long>")
    nodes = nodes.select("host", "part", F.explode(F.arrays_zip("places", "texts")).alias("x")).select("host", "part", "x.places", "x.texts")
    # by text first: a place that all pages of a large host have is counted in many tasks
    nodes = nodes.groupBy("host", "places", "texts").agg(F.sum("part").alias("n")).groupBy("host", "places").agg(
        F.round(F.sum("n"), 6).alias("pages"), F.count("*").alias("n_texts"), F.max("texts").alias("text"))
    nodes = nodes.filter((F.col("n_texts") == 1) & (F.col("text") != 0) & (F.col("pages") >= min_pages))
    nodes = nodes.join(totals, F.col("host") == F.col("t_host")).filter(F.col("pages") >= share * F.col("total"))
    constant = nodes.groupBy("host").agg(F.collect_list("places").alias("constant"))
    return constant.join(seeds, F.col("host") == F.col("s_host")).select("host", F.col("s_labels").alias("labels"), F.col("s_depths").alias("depths"), "constant")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        parse_url(F.col(url_col))[0].alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    templates = stored(induce(rows), "templates").withColumnRenamed("host", "t_host")
    sent = _small(templates, 8 * F.size("constant") + 12 * F.size("labels") + F.octet_length("t_host"))
    joined = rows.join(sent, rows.host == sent.t_host, "left")

    def run(batches):
        hosts = _Hosts()
        for batch in batches:
            labels, depths, constant = (batch.column(i) for i in (4, 5, 6))
            texts = []
            for i, (html, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                page, shared = parse(html), None
                if constant[i].is_valid:
                    aligner, places = hosts.of(host, lambda: (Aligner(labels[i].as_py(), depths[i].as_py()), set(constant[i].as_py())))
                    mine, depth, _, nodes = reduced(page)
                    shared = [n for n, at in zip(nodes, aligner.places(mine, depth)) if at in places]
                texts.append("\n\n".join(blocks(page, shared)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "labels", "depths", "constant").mapInArrow(run, "page_id long, url string, text string, n_chars long")
