"""HTML extraction by wrapper induction.

A page's host is that of its url; its reference is a typical page of the host:
with text, of the set of tags that most of the different pages have, of smallest id.  Each page becomes a DOM tree and is aligned with the reference by
simple tree matching: siblings are aligned in order so that the most nodes
match, with runs of equally labelled siblings matched in order as a whole (runs at both ends that agree are matched as they are, so like pages take linear time).
Subtrees of equal labels are one shape, so two of them are compared once however often they stand side by side, and a
table of runs is worked out a row at a time; pages of any width are aligned exactly.  A text block
then is a slot of the reference, or new.  Over all different pages of a host, slots whose
text is the reference's in CONSTANT of at least FEWEST pages are template;
varying slots and new blocks are content.  Pages whose articles have the same
texts count once, so copies of one article do not vote it out.  Whatever the
reference lacks is found without it: a text that CONSTANT of the different pages
with its path of labels have there, on at least FEWEST pages, is template too.

Where on a page the content is, the host's pages tell too: of all their elements, told by
the path of labels (tag and class, without class the place among equals), the deepest that holds SHARE of all
text, a first heading counting as half a page, is the host's region.
On hosts of fewer than FEWEST different pages, without such a region, and on pages that lack it, tags tell:
all outermost ``article`` elements in page
order (but the largest, not those that are comments and so on by class or id), else
those of ``main``, else the body.  Elements that are menus, sidebars, notices, adverts,
forms, scripts, styles or reader comments by tag, role, class or id are left out.  Within the content a name tells so only where a whole class is made of
such words, none of them one that articles use themselves (AMBIGUOUS); an id or a part of a name tells so outside of it only.  Character references are
decoded, white space in a block becomes one space, blocks are joined by \\n.

Null or empty html gives an empty text; a null url is a host of its own (one for all);
repeated rows give equal rows; an empty table gives an empty result; broken and
truncated markup is read as far as it goes, to any depth.
"""

import html
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import saved
from tarn.llm.url_filter import host_and_path

CONSTANT, FEWEST, SHARE = 0.9, 8, 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of the key ends an open element of the value.
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
#: Elements that an implied end does not reach beyond.
WALLS = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote".split())

DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg select button input textarea object embed canvas audio video menu dialog".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login "
    "sidebar sidebars aside widget widgets menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer foot bottombar "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations skip".split()
)
#: Words that name parts of articles as well as of pages.
AMBIGUOUS = frozenset("discussion related recommended recommendations reply replies respond header masthead foot skip banner banners promotion login social widget widgets".split())
#: Words that a name may have beside one of WORDS and still be the name of such a part within the content.
FILLERS = frozenset("area bar block body bottom box button buttons container content inner item items left link links list outer panel primary right secondary section slot title top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
LOOSE = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "label", "drop", "weak", "kids", "parent", "told", "rows", "shape")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.parent, self.kids, self.label = tag, parent, [], tag
        self.drop, self.told, self.weak, self.rows, self.shape = tag in DROPPED, False, False, None, -1
        if attributes:
            holds = tag in ("html", "body", "article", "main")
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                value, name = (a or b or c).lower(), name.lower()
                if name == "class":
                    self.label = f"{tag}.{value}"
                if name == "role":
                    named = whole = bool(ROLES.intersection(value.split()))
                else:
                    words = set(re.split(r"[^a-z]+", value))
                    named = bool(words & WORDS)
                    whole = named and name == "class" and any(map(_whole, value.split()))
                self.told = self.told or named
                self.weak = self.weak or named and not holds
                self.drop = self.drop or whole and not holds


def _whole(name: str) -> bool:
    """Whether a class is nothing but the name of a part that is no content."""
    words = set(re.split(r"[^a-z]+", name)) - {""}
    return bool(words & (WORDS - AMBIGUOUS)) and words <= (WORDS - AMBIGUOUS) | FILLERS


class Text:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def parse(page: str) -> Node:
    """The DOM, tolerant of missing ends. Text is a kid like an element."""
    root = here = Node("html", "", None)
    at, n = 0, len(page)
    pattern = TOKEN
    while at < n:
        start = page.find("<", at)
        if start < 0:
            here.kids.append(Text(page[at:]))
            break
        m = pattern.match(page, start)
        if m is None and start + 1 < n and (page[start + 1].isalpha() or page[start + 1] == "/"):
            pattern = LOOSE  # quotes do not pair: from here on a tag ends at the first >
            m = pattern.match(page, start)
        if m is None:
            here.kids.append(Text(page[at : start + 1]))
            at = start + 1
            continue
        if start > at:
            here.kids.append(Text(page[at:start]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            x = here
            while x is not None and x.tag != tag:
                x = x.parent
            if x is not None and x.parent is not None:
                here = x.parent
            continue
        if tag == "html":
            continue
        if tag in ENDS:
            x, ends, last = here, ENDS[tag], None
            while x.parent is not None and x.tag not in WALLS:
                if x.tag in ends:
                    last = x
                x = x.parent
            if last is not None:
                here = last.parent
        if tag == "body":  # ends the head
            while here.parent is not None:
                here = here.parent
        node = Node(tag, m[3], here)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
            here = node
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
    return root


def _elements(node: Node) -> list[Node]:
    return [k for k in node.kids if type(k) is Node and not k.drop]


def _runs(node: Node) -> list[list[Node]]:
    """Runs of equally labelled elements among the kids."""
    if node.rows is None:
        node.rows = []
        for k in _elements(node):
            if node.rows and node.rows[-1][0].label == k.label:
                node.rows[-1].append(k)
            else:
                node.rows.append([k])
    return node.rows


def _ends(x: list, y: list) -> tuple[int, int]:
    """How many runs agree in label at the start and at the end."""
    most, start = min(len(x), len(y)), 0
    while start < most and x[start][0] == y[start][0]:
        start += 1
    end = 0
    while end < most - start and x[-1 - end][0] == y[-1 - end][0]:
        end += 1
    return start, end


class Shapes:
    """Trees by their labels alone: equal ones have one number, so any two are compared once.

    ``runs`` has the kids of each shape as runs (label, shapes of the run, number of the run), ``size`` its elements.
    """

    def __init__(self, other: "Shapes | None" = None):
        self.ids: dict = dict(other.ids) if other else {}
        self.run_ids: dict = dict(other.run_ids) if other else {}
        self.runs: list = list(other.runs) if other else []
        self.size: list[int] = list(other.size) if other else []
        self.known: dict[tuple[int, int], int] = {}
        self.worths: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        """Gives all elements below and at the root their shape; a list instead of recursion."""
        order = [root]
        for node in order:  # grows as it goes
            order.extend(_elements(node))
        for node in reversed(order):
            runs = []
            for run in _runs(node):
                key = (run[0].label, tuple(k.shape for k in run))
                runs.append((*key, self.run_ids.setdefault(key, len(self.run_ids))))
            key = (node.label, tuple(r[2] for r in runs))
            if key not in self.ids:
                self.ids[key] = len(self.runs)
                self.runs.append(runs)
                self.size.append(1 + sum(self.size[k] for r in runs for k in r[1]))
            node.shape = self.ids[key]

    def _worth(self, u: tuple, v: tuple) -> int:
        """Nodes that match in two runs of one label, whose pairs are known."""
        key = u[2], v[2]
        if key not in self.worths:
            self.worths[key] = sum(self.size[p] if p == q else self.known[p, q] for p, q in zip(u[1], v[1], strict=False))
        return self.worths[key]

    def _missing(self, x: list, y: list) -> list[tuple[int, int]]:
        """Pairs of shapes that have to be known to align two lists of runs."""
        start, end = _ends(x, y)
        by_label: dict = {}
        for v in {r[2]: r for r in y[start : len(y) - end]}.values():
            by_label.setdefault(v[0], []).append(v)
        pairs = [*zip(x[:start], y[:start], strict=True), *zip(x[len(x) - end :], y[len(y) - end :], strict=True)]
        pairs += [(u, v) for u in {r[2]: r for r in x[start : len(x) - end]}.values() for v in by_label.get(u[0], ())]
        return [(p, q) for u, v in pairs if (u[2], v[2]) not in self.worths for p, q in zip(u[1], v[1], strict=False) if p != q and (p, q) not in self.known]

    def _weights(self, x: list, y: list) -> list:
        """For each run of x the runs of y with its label, and what each is worth."""
        columns: dict = {}
        for j, v in enumerate(y):
            columns.setdefault(v[0], []).append(j)
        memo: dict = {}
        for u in x:
            if u[0] in columns and u[2] not in memo:
                memo[u[2]] = np.array(columns[u[0]]), np.array([self._worth(u, y[j]) for j in columns[u[0]]], dtype=np.int64)
        return [memo.get(u[2]) for u in x]

    @staticmethod
    def _next(row: np.ndarray, weights) -> np.ndarray:
        """The next row of the table of best sums."""
        best = row.copy()
        if weights is not None:
            j, w = weights
            best[j + 1] = np.maximum(best[j + 1], row[j] + w)
        return np.maximum.accumulate(best)

    def _total(self, x: list, y: list) -> int:
        start, end = _ends(x, y)
        total = sum(self._worth(u, v) for u, v in [*zip(x[:start], y[:start], strict=True), *zip(x[len(x) - end :], y[len(y) - end :], strict=True)])
        x, y = x[start : len(x) - end], y[start : len(y) - end]
        row = np.zeros(len(y) + 1, dtype=np.int64)
        for weights in self._weights(x, y) if x and y else ():
            row = self._next(row, weights)
        return total + int(row[-1])

    def score(self, pairs: list[tuple[int, int]]) -> None:
        """Works out how many nodes match below and at pairs of shapes, by simple tree matching; a stack instead of recursion."""
        stack = list(pairs)
        while stack:
            p, q = stack[-1]
            if p == q or (p, q) in self.known:
                stack.pop()
            elif need := self._missing(self.runs[p], self.runs[q]):
                stack.extend(need)
            else:
                self.known[p, q] = 1 + self._total(self.runs[p], self.runs[q])
                stack.pop()

    def chosen(self, x: list, y: list) -> list[tuple[int, int]]:
        """The places of the runs that are matched. Rows of the table are kept at every root of their number, and those between worked out again."""
        start, end = _ends(x, y)
        out = [(k, k) for k in range(start)] + [(len(x) - end + k, len(y) - end + k) for k in range(end)]
        x, y = x[start : len(x) - end], y[start : len(y) - end]
        if not x or not y:
            return out
        weights = self._weights(x, y)
        step = math.isqrt(len(x)) + 1
        row, kept = np.zeros(len(y) + 1, dtype=np.int64), []
        for i, w in enumerate(weights):
            if i % step == 0:
                kept.append(row)
            row = self._next(row, w)
        i, j, rows, first = len(x), len(y), [], len(x) + 1
        while i and j:
            if i - 1 < first:
                first = (i - 1) // step * step
                rows = [kept[first // step]]
                for w in weights[first:i]:
                    rows.append(self._next(rows[-1], w))
            here, above = rows[i - first], rows[i - 1 - first]
            if x[i - 1][0] == y[j - 1][0] and here[j] == above[j - 1] + self._worth(x[i - 1], y[j - 1]):
                out.append((start + i - 1, start + j - 1))
                i, j = i - 1, j - 1
            elif here[j] == above[j]:
                i -= 1
            else:
                j -= 1
        return out


def match(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching: the matched pairs of two equally labelled nodes; ``shapes`` has numbered b."""
    if shapes is None:
        shapes = Shapes()
        shapes.number(b)
    shapes = Shapes(shapes)
    shapes.number(a)
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        rx, ry = shapes.runs[x.shape], shapes.runs[y.shape]
        shapes.score(shapes._missing(rx, ry))
        for i, j in shapes.chosen(rx, ry):
            stack.extend(zip(_runs(x)[i], _runs(y)[j], strict=False))
    return pairs


def _step(h: int, node: Node, place: int) -> int:
    """A 64-bit hash of the path to a node, from that of its parent; without a class its place among equals counts."""
    h = (h ^ zlib.crc32(f"{node.label}\0{place if node.label == node.tag else ''}".encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1
    return h ^ h >> 29


def _walk(root: Node) -> list[tuple[Node, int, int, int]]:
    """(element, path, depth, place of its parent in this list) of all elements that may hold content."""
    out = [(root, 1, 0, -1)]
    for i, (node, h, depth, _) in enumerate(out):  # grows as it goes
        places: dict[str, int] = {}
        for k in node.kids:
            if type(k) is Node and not (k.drop or k.weak or k.tag == "header"):
                place = places.get(k.label, 0)
                places[k.label] = place + 1
                out.append((k, _step(h, k, place), depth + 1, i))
    return out


def masses(page: str) -> list[tuple[int, int, float]]:
    """(path, depth, text in it) of the elements that hold a tenth of the page; a first heading counts as half of its text."""
    walk = _walk(parse(page))
    text = [sum(len(k.text.strip()) for k in node.kids if type(k) is Text) for node, *_ in walk]
    heading = [node.tag == "h1" for node, *_ in walk]
    for i in range(len(walk) - 1, 0, -1):
        up = walk[i][3]
        text[up] += text[i]
        heading[up] |= heading[i]
    return [(_signed(h), depth, t + text[0] / 2 * head) for (node, h, depth, _), t, head in zip(walk, text, heading, strict=True) if t and 10 * t >= text[0] and (node.tag in BLOCK or not depth)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def content(root: Node, region: int | None) -> list[Node]:
    """The elements at the host's region, else what tags tell."""
    found = [node for node, h, *_ in _walk(root) if _signed(h) == region] if region is not None else []
    return found if any(map(_weight, found)) else article(root)


def _weight(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for k in stack.pop().kids:
            if type(k) is Text:
                total += len(k.text.strip())
            elif not k.drop:
                stack.append(k)
    return total


def article(root: Node) -> list[Node]:
    """The elements that hold the main text, in page order."""
    for tag in ("article", "main", "body"):
        found, stack = [], [root]
        while stack:
            here = stack.pop()
            if here.tag == tag:
                found.append(here)
            else:
                stack.extend(k for k in reversed(here.kids) if type(k) is Node and not k.drop and not k.weak)
        weights = [_weight(x) for x in found]
        if any(weights):
            most = max(weights)
            return [x for x, w in zip(found, weights, strict=True) if w == most or not x.told]
    return [root]


def blocks(node: Node, region: bool = False) -> list[tuple[Node, str]]:
    """(innermost block element, text) in page order; blocks without text are left out."""
    out: list[tuple[Node, str]] = []
    parts: list[str] = []

    def end(owner: Node) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((owner, text))
            parts.clear()

    inside = region or node.tag == "article"
    stack: list = [(node, iter(node.kids), node)]
    while stack:
        here, kids, owner = stack[-1]
        k = next(kids, None)
        if k is None:
            if here.tag in BLOCK:
                end(owner)
            stack.pop()
        elif type(k) is Text:
            parts.append(k.text)
        elif k.tag in ("br", "hr", "wbr"):
            if k.tag != "wbr":
                parts.append(" ") if k.tag == "br" else end(owner)
        elif not k.drop and (inside or not k.weak and k.tag != "header"):
            if k.tag in BLOCK:
                end(owner)
            stack.append((k, iter(k.kids), k if k.tag in BLOCK else owner))
        elif k.tag in BLOCK:
            end(owner)
    return out


def _content_blocks(root: Node, region: int | None) -> list[tuple[Node, str]]:
    return [x for part in content(root, region) for x in blocks(part, region is not None and part.tag != "body")]


@lru_cache(maxsize=256)
def _reference(page: str, region: int | None) -> tuple[Node, dict[int, int], dict[int, list[str]], Shapes]:
    """A reference's tree, its block elements' numbers and texts, its shapes; kept while pages of its host follow."""
    root, shapes = parse(page), Shapes()
    shapes.number(root)
    numbers: dict[int, int] = {}
    texts: dict[int, list[str]] = {}
    for node, text in _content_blocks(root, region):
        i = numbers.setdefault(id(node), len(numbers))
        texts.setdefault(i, []).append(text)
    return root, numbers, texts, shapes


def _path(node: Node, known: dict[int, int]) -> int:
    """A 64-bit hash of the labels from the root to the node; ``known`` has those of its page so far."""
    chain = []
    while node is not None and id(node) not in known:
        chain.append(node)
        node = node.parent
    h = known[id(node)] if node is not None else 0
    for x in reversed(chain):
        h = (h ^ zlib.crc32(x.label.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1
        h ^= h >> 29
        known[id(x)] = h
    return _signed(h)


def aligned(page: str, reference: str, region: int | None = None) -> tuple[list[int], list[bool], list[str], list[int]]:
    """For each block of the article: its slot in the reference (-1 if new), whether the text is the reference's, the text, the hash of its path."""
    root = parse(page)
    other, numbers, texts, shapes = _reference(reference, region)
    slot: dict[int, int] = {}
    for a, b in match(root, other, shapes):
        if id(b) in numbers:
            slot[id(a)] = numbers[id(b)]
    nodes, same, out, paths = [], [], [], []
    known: dict[int, int] = {}
    for node, text in _content_blocks(root, region):
        i = slot.get(id(node), -1)
        nodes.append(i)
        same.append(i >= 0 and text in texts[i])
        out.append(text)
        paths.append(_path(node, known))
    return nodes, same, out, paths


def _regions(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """host, region: the path of the deepest element that holds SHARE of the text of a host's pages, of which FEWEST or more differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, int, int], float] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, depth, mass in masses(page):
                    sums[host, path, depth] = sums.get((host, path, depth), 0.0) + mass
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array([k[2] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["host", "path", "depth", "mass"])

    held = rows.select("host", "html").mapInArrow(run, "host string, path long, depth int, mass double").groupBy("host", "path", "depth").agg(F.sum("mass").alias("mass"))
    held = saved(held, "masses")
    whole = held.where("depth = 0").groupBy("host").agg(F.sum("mass").alias("whole"))
    many = shapes.groupBy("host").agg(F.sum("c").alias("n")).where(F.col("n") >= FEWEST)
    deep = held.where("depth > 1").join(whole, "host").where(F.col("mass") >= SHARE * F.col("whole"))
    return deep.join(many, "host").groupBy("host").agg(F.max_by("path", F.struct("depth", "mass", "path")).alias("region"))


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, url, text, n_chars."""
    host, _ = host_and_path(F.col("url"))
    page = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), "url", host.alias("host"), page.alias("html"))
    tags = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)))
    shapes = rows.select("host", "id", F.xxhash64("html").alias("page"), F.xxhash64(tags).alias("tags"), (~F.rlike("html", F.lit(r"(?:\A|>)\s*+[^<\s]"))).alias("blank"))
    shapes = saved(shapes.groupBy("host", "blank", "tags", "page").agg(F.min("id").alias("id")).groupBy("host", "blank", "tags").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "page")).alias("first")), "shapes")
    typical = shapes.groupBy("host").agg(F.min_by("first.page", F.struct("blank", -F.col("c"), "first")).alias("page")).select(F.col("host").alias("_host"), "page")
    # Written first: a join right above an aggregate keeps its partitioning, and adaptive execution does not split a hot host there.
    texts = rows.join(typical, (F.col("host") == F.col("_host")) & (F.xxhash64("html") == F.col("page"))).groupBy("host").agg(F.min("html").alias("reference"))
    references = saved(texts.join(_regions(rows, shapes), "host", "left"), "references")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [aligned(*x) for x in zip(*(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.bool_())), pa.array([g[2] for g in got], pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.int64()))],
                names=["id", "url", "host", "nodes", "same", "texts", "paths"],
            )

    joined = rows.join(references, "host").select("id", "url", "host", "html", "reference", "region")
    seen = saved(joined.mapInArrow(run, f"id {kind}, url string, host string, nodes array<int>, same array<boolean>, texts array<string>, paths array<bigint>"), "blocks")
    mark = lambda x: F.xxhash64(x["paths"], x["texts"])
    marks = F.array_distinct(F.transform(F.arrays_zip("paths", "texts"), lambda x: F.struct(x["paths"].alias("path"), mark(x).alias("mark"))))
    each = F.struct(F.arrays_zip("nodes", "same").alias("slots"), F.array_distinct("paths").alias("paths"), marks.alias("marks"))
    different = saved(seen.groupBy("host", F.xxhash64("texts").alias("page")).agg(F.min(each).alias("x")).select("host", "x.*"), "different")
    votes = different.select("host", F.explode("slots").alias("x")).where("x.nodes >= 0").groupBy("host", F.col("x.nodes").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count_if("x.same").alias("k"))
    with_path = different.select("host", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    with_text = different.select("host", F.explode("marks").alias("x")).groupBy("host", "x.path", "x.mark").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= FEWEST)
    often = lambda df: df.where((F.col("n") >= FEWEST) & (F.col("k") >= CONSTANT * F.col("n")))
    found = often(votes).select("host", "node", F.lit(None).cast("bigint").alias("mark")).unionAll(often(with_text.join(with_path, ["host", "path"])).select("host", F.lit(None).cast("int"), "mark"))
    template = saved(found.groupBy("host").agg(F.collect_set("node").alias("constant"), F.collect_set("mark").alias("marks")), "template")  # slots of one page, and what most pages share
    both = seen.join(template, "host", "left")
    content = F.filter(F.arrays_zip("nodes", "same", "texts", "paths"), lambda x: F.col("constant").isNull() | ~(x["same"] & F.array_contains("constant", x["nodes"]) | F.array_contains("marks", mark(x))))
    text = F.array_join(F.transform(content, lambda x: x["texts"]), "\n")
    return both.select(F.col("id").alias(id_col), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
