"""Main text of web pages by wrapper induction.

Each page becomes a small tree of its blocks. The pages of a host are aligned
with some of them, the host's references, by simple tree matching: the largest
order-preserving match of equal tags, found by dynamic programming over the
children of each pair of matched nodes. Every aligned page votes on each
reference node: the same text (constant) or another (varying). Nodes that are
constant in most pages become the host's template; in every page aligned with
it the template goes and the varying slots stay.

What a tag or a class names as chrome (navigation, footers, adverts, forms,
comments, scripts and so on) goes on every page, also on hosts with a single
page. Where a page marks its article or main part, the template's
constant nodes go from that part, too; outside of it a block stays only if the
template has it as a varying slot, so where a host has no template the mark
alone decides.

The references hold every place (the path of tags, with a number among equal
siblings) that enough pages of the host have: for each the page with the
smallest digest, among those with the place's text if most have the same.

All pages of a host vote; the votes are added up by (host, node), so a host with
a third of all pages is no heavier for any one task.

Defined results: a null or empty html has an empty text; pages without a host
have no template; pages of equal blocks vote once; rows that are equal get equal results.
Blocks are joined by two line feeds.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, texts

#: Pages of a host that must have a node for it to become template, and the share of them with the same text.
LEAST_PAGES = 4
CONSTANT_SHARE = 0.6
#: Share of the pages with the parent of a node outside the marked parts that must have the node's text.
LEAST_SHARE = 1 / 3
#: Bytes of references up to which they are broadcast; rows of a host that one task takes beyond that; nodes of remembered alignments.
MOST_BROADCAST, GROUP_ROWS, MOST_HELD = 64 << 20, 16384, 1_000_000
#: Children of a node up to which an alignment's table is computed cell by cell.
SMALL = 24

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Start tags that end an open element of the named kinds, up to the nearest of the limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
ENDS_P = BLOCK - {"option", "optgroup", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "button", "select", "option", "dialog", "head", "title", "object", "applet", "audio", "video", "map", "menu", "textarea", "label", "fieldset", "search", "noembed", "noframes", "math", "datalist"}
CHROME_WORDS = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion "
    "recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola tags toolbar topbar widget widgets"
).split()
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
CONTENT_TAGS = {"article", "main"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_CHROME = frozenset(CHROME_WORDS)
#: Names that an article's own title may have.
_TITLE_WORDS = frozenset(("header", "banner", "masthead"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass(slots=True)
class Node:
    """An element: its tag, whether it is chrome, its text pieces and children in page order."""

    tag: str
    chrome: bool = False
    parts: list = field(default_factory=list)


def is_chrome(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a tag or its attributes name a part that is never main text."""
    if tag in CHROME_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    kept = _TITLE_WORDS if inside or tag in _HEADINGS else frozenset()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id") and any(w in _CHROME and w not in kept for w in _NAME.findall(value)):
            return True
        if name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _ended_by(tag: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """What open elements a start tag ends, and the elements beyond which it ends none."""
    kinds, limits = CLOSES.get(tag, (set(), set()))
    if tag in ENDS_P:
        kinds, limits = kinds | {"p"}, limits | {"table", "td", "th", "caption", "button"}
    return (frozenset(kinds), frozenset(limits)) if kinds else None


_ENDED_BY = {tag: found for tag in {*CLOSES, *ENDS_P} if (found := _ended_by(tag))}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do in the common cases."""
    root = Node("#root")
    stack, content, at, n = [root], 0, 0, len(page)
    search = _TOKEN.search
    while at < n:
        m = search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        start, after = m.span()
        if start > at:
            stack[-1].parts.append(page[at:start])
        at = after
        closing, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag == "p" and not any(x.tag == "p" for x in stack) or tag == "br":
                stack[-1].parts.append(Node(tag))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if content:
                        content -= sum(x.tag in CONTENT_TAGS for x in stack[k:])
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        if ended := _ENDED_BY.get(tag):
            kinds, limits = ended
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limits:
                    break
                if stack[k].tag in kinds:
                    del stack[k:]
        node = Node(tag, is_chrome(tag, attributes, content > 0))
        stack[-1].parts.append(node)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            node.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and (tag in BLOCK or not attributes.rstrip().endswith("/")):
            stack.append(node)
            content += tag in CONTENT_TAGS
    return root


def _text(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _short(text: str) -> str:
    return text if len(text) <= 32 else xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def blocks(node: Node, marked: Collection[int] = ()) -> list[tuple[str, bool, int]]:
    """The texts of the blocks below a node, chrome left out; whether each is in a marked part; its place in the skeleton.

    ``marked`` has the marked nodes' identities.
    """
    out: list[tuple[str, bool, int]] = []
    held: list[str] = []
    inside, path, n = int(id(node) in marked), [0], 1

    def flush() -> None:
        if held and (text := _text(held)):
            out.append((text, inside > 0, path[-1]))
        held.clear()

    work: list = list(reversed(node.parts))
    while work:
        x = work.pop()
        if isinstance(x, str):
            held.append(x)
        elif isinstance(x, int):
            flush()
            inside -= x
            path.pop()
        elif x.chrome:
            if x.tag in BLOCK:
                flush()
        elif x.tag in BLOCK:
            flush()
            here = int(id(x) in marked)
            inside += here
            path.append(n)
            n += 1
            work.append(here)
            work.extend(reversed(x.parts))
        elif x.tag == "br":
            held.append(" ")
        else:
            work.extend(reversed(x.parts))
    flush()
    return out


def content_nodes(root: Node) -> list[Node]:
    """The outermost marked articles and main parts that aren't chrome; articles within a main part win."""
    found: list[Node] = []
    work = [root]
    while work:
        x = work.pop()
        if x.tag in CONTENT_TAGS:
            inner = content_nodes(Node("#part", parts=x.parts)) if x.tag == "main" else []
            found += inner or [x]
        else:
            work += [p for p in reversed(x.parts) if isinstance(p, Node) and not p.chrome]
    return [x for x in found if _has_text(x)]


def _has_text(node: Node) -> bool:
    work = list(node.parts)
    while work:
        x = work.pop()
        if isinstance(x, str):
            if _text([x]):
                return True
        elif not x.chrome:
            work += x.parts
    return False


# A skeleton is a page's block tree in page order: [depth, tag, text] of each node
# outside chrome, the text being the node's own, or its digest where that is shorter.
Skeleton = list[tuple[int, str, str]]


def skeleton(root: Node) -> Skeleton:
    """The block nodes of a page, those of its marked parts too."""
    tree: list[tuple[int, str, list[str]]] = []
    work: list[tuple[int, Node | str, list[str]]] = [(0, root, [])]
    while work:
        depth, x, own = work.pop()
        if isinstance(x, str):
            own.append(x)
        elif x.chrome:
            continue
        elif x is root or x.tag in BLOCK:
            own = []
            tree.append((depth, x.tag, own))
            work += [(depth + 1, p, own) for p in reversed(x.parts)]
        elif x.tag == "br":
            own.append(" ")
        else:
            work += [(depth, p, own) for p in reversed(x.parts)]
    return [(depth, tag, _short(_text(own))) for depth, tag, own in tree]


def _children(tree: Skeleton) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in tree]
    path: list[int] = []
    for i, (depth, _, _) in enumerate(tree):
        del path[depth:]
        if path:
            kids[path[-1]].append(i)
        path.append(i)
    return kids


def _codes(a: Skeleton, b: Skeleton) -> tuple[np.ndarray, np.ndarray]:
    """A number for each (tag, text) of either tree."""
    known: dict[tuple[str, str], int] = {}
    return tuple(np.array([known.setdefault(x[1:], len(known)) for x in tree], np.int64) for tree in (a, b))


class Bits:
    """A row of truth values, one bit each."""

    __slots__ = ("packed",)

    def __init__(self, row: np.ndarray) -> None:
        self.packed = np.packbits(row)

    def __getitem__(self, k: int) -> int:
        return int(self.packed[k >> 3]) >> (7 - (k & 7)) & 1


def align(a: Skeleton, b: Skeleton) -> list[tuple[int, int]]:
    """Matched nodes (place in a, place in b) by simple tree matching.

    Of each table only two bits a cell stay: whether the match is as large
    without the left node, or without the right. Rows of wide tables are
    computed whole, small tables cell by cell; both give the same.
    """
    if not a or not b or a[0][1] != b[0][1]:
        return []
    kids_a, kids_b = _children(a), _children(b)
    own_a, own_b = _codes(a, b)
    codes_a, codes_b = own_a.tolist(), own_b.tolist()
    tags: dict[str, int] = {}
    tag_a, tag_b = (np.array([tags.setdefault(x[1], len(tags)) for x in tree], np.int64) for tree in (a, b))
    sizes: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], tuple[list, list]] = {}
    inner_b = [[(k, y) for k, y in enumerate(kids) if kids_b[y]] for kids in kids_b]

    def measure(i: int, j: int) -> None:
        """Nodes in the largest match of the subtrees at i and j, whose children's are known; an equal text breaks ties."""
        left, right = kids_a[i], kids_b[j]
        top, ups, lefts = 0, [], []
        if left and right and len(right) <= SMALL:
            before = [0] * (len(right) + 1)
            for x in left:
                now, up, on, best, wide, tag, own = [0], [True], [], 0, kids_a[x], a[x][1], codes_a[x]
                for k, y in enumerate(right):
                    size = before[k + 1]
                    if wide and kids_b[y]:
                        more = before[k] + sizes.get((x, y), 0)
                    else:
                        more = before[k] + (1001 if own == codes_b[y] else 1000 if tag == b[y][1] else 0)
                    if more > size:
                        size = more
                    if best > size:
                        size = best
                    up.append(size == before[k + 1])
                    on.append(size == best)
                    now.append(size)
                    best = size
                ups.append(up)
                lefts.append(on)
                before = now
            top = before[-1]
            tables[i, j] = ups, lefts
        elif left and right:
            tag, own = tag_b[right], own_b[right]
            above = np.zeros(len(right) + 1, np.int64)
            for x in left:
                gain = 1000 * (tag == tag_a[x]) + (own == own_a[x])
                if kids_a[x]:
                    for k, y in inner_b[j]:
                        gain[k] = sizes.get((x, y), 0)
                row = above.copy()
                np.maximum(row[1:], above[:-1] + gain, out=row[1:])
                np.maximum.accumulate(row, out=row)
                ups.append(Bits(row == above))
                lefts.append(Bits(row[1:] == row[:-1]))
                above = row
            top = int(above[-1])
            tables[i, j] = ups, lefts
        sizes[i, j] = top + 1000 + int(own_a[i] == own_b[j])

    stack = [(0, 0, False)]
    while stack:
        i, j, ready = stack.pop()
        if ready:
            measure(i, j)
        elif (i, j) not in sizes:
            stack.append((i, j, True))
            stack += [(x, y, False) for x in kids_a[i] if kids_a[x] for _, y in inner_b[j] if a[x][1] == b[y][1]]
    pairs, work = [], [(0, 0)]
    while work:
        i, j = work.pop()
        pairs.append((i, j))
        if (i, j) not in tables:
            continue
        (ups, lefts), left, right = tables[i, j], kids_a[i], kids_b[j]
        x, y = len(left), len(right)
        while x and y:
            if ups[x - 1][y]:
                x -= 1
            elif lefts[x - 1][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                work.append((left[x], right[y]))
    return pairs


def decide(tree: Skeleton, votes: Collection[tuple[int, int, int]]) -> tuple[frozenset[int], frozenset[int]]:
    """The nodes that enough pages voted on, and the constant ones, from (node, pages that have it, those with its text).

    A constant node has its text in most pages that have the node, and in enough
    of those that have its parent: a line that some articles share is aligned
    with itself wherever it stands, but most articles don't have it.
    """
    above, marked, path = [0] * len(tree), [False] * len(tree), []
    for i, (depth, tag, _) in enumerate(tree):
        del path[depth:]
        if path:
            above[i] = path[-1]
            marked[i] = marked[path[-1]]
        marked[i] |= tag in CONTENT_TAGS
        path.append(i)
    n = {i: k for i, k, _ in votes}
    decided = frozenset(i for i, k in n.items() if k >= LEAST_PAGES)
    constant = frozenset(i for i, k, same in votes if k >= LEAST_PAGES and tree[i][2] and same >= CONSTANT_SHARE * k and same >= (CONSTANT_SHARE if marked[i] else LEAST_SHARE) * n.get(above[i], k))
    return decided, constant


class Reference:
    """A reference tree and the alignments with it that a worker remembers.

    An alignment depends on a page's tags and on which of its texts the tree has
    under the same tag, so pages that differ in other texts share one.
    """

    held = 0

    def __init__(self, tree: Skeleton, digest: int = 0, votes: Collection[tuple[int, int, int]] = ()) -> None:
        self.tree, self.digest = tree, digest
        self.decided, self.constant = decide(tree, votes)
        self.texts = {x[1:] for x in tree}
        self.fixed = {tree[i][1:] for i in self.constant}
        self.seen: dict[tuple, list[tuple[int, int]]] = {}

    def key(self, own: Skeleton) -> tuple:
        """A page as this tree sees it: texts that the tree lacks are left out."""
        return tuple([x if x[1:] in self.texts else (x[0], x[1], None) for x in own])

    def matched(self, key: tuple) -> list[tuple[int, int]]:
        if key not in self.seen:
            self.seen[key] = align(self.tree, key)
            Reference.held += len(key)
        return self.seen[key]

    def align(self, own: Skeleton) -> list[tuple[int, int]]:
        return self.matched(self.key(own))


def main_text(root: Node, templates: Collection[Reference] = ()) -> str:
    """The page's text: its blocks without the templates' constant nodes.

    Where the page marks content, a block outside of it stays only if the
    templates have it as a varying slot.
    """
    marked = {id(x) for x in content_nodes(root)}
    found = blocks(root, marked)
    outside = bool(marked) and any(not inside for _, inside, _ in found)
    gone, slots = set(), set()
    useful = [x for x in templates if outside or x.fixed] if found else []  # the others could take nothing away
    own = skeleton(root) if useful else []
    have = {x[1:] for x in own}
    for reference in useful:
        if not outside and have.isdisjoint(reference.fixed):
            continue
        for i, j in reference.align(own):
            if i in reference.constant and reference.tree[i][2] == own[j][2]:
                gone.add(j)
            elif i in reference.decided:
                slots.add(j)
    return "\n\n".join(text for text, inside, place in found if place not in gone and (inside or not marked or place in slots))


def _pack(tree: Skeleton) -> str:
    """One line a node; no tag or text has a tab or a line feed."""
    return "\n".join(f"{d}\t{tag}\t{text}" for d, tag, text in tree)


def _unpack(nodes: str) -> Skeleton:
    split = [x.split("\t") for x in nodes.split("\n")] if nodes else []
    return [(int(d), tag, text) for d, tag, text in split]


def host(url: Column) -> Column:
    """A URL's host in lower case; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        trees = [_pack(skeleton(parse(x.decode()))) for x in texts(batch.column("html"))]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], ["host", "nodes"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, place, text, digest) of every node: its place's and its text's hash, its page's digest."""

    def digest(x: str) -> int:
        return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)

    for batch in pieces(batches, "nodes"):
        rows: list[tuple[str, int, int, int]] = []
        for row in batch.to_pylist():
            path: list[int] = []
            seen: Counter = Counter()
            for depth, tag, text in _unpack(row["nodes"]):
                del path[depth:]
                key = (path[-1] if path else 0, tag)
                path.append(digest(f"{key[0]} {tag} {seen[key]}"))
                seen[key] += 1
                rows.append((row["host"], path[-1], digest(text), row["digest"]))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *[pa.int64()] * 3], strict=True)], ["host", "place", "text", "digest"])


class Known:
    """The references of the hosts a task has met, from a broadcast table or from rows among the pages.

    What it remembers is bounded: hosts come grouped in the second case, and
    alignments are forgotten beyond ``MOST_HELD`` nodes.
    """

    def __init__(self, shared: Any) -> None:
        self.shared = shared
        self.now: tuple[str | None, list[Reference]] = (None, [])
        self.made: dict[str, list[Reference]] = {}

    @staticmethod
    def _made(packed: list[dict]) -> list[Reference]:
        return [Reference(_unpack(x["nodes"]), x["digest"], [(v["place"], v["n"], v["same"]) for v in x["votes"] or ()]) for x in packed or ()]

    def learn(self, name: str, packed: list[dict]) -> None:
        if self.now[0] != name:
            self.now = (name, self._made(packed))

    def of(self, name: str) -> list[Reference]:
        if Reference.held > MOST_HELD:
            Reference.held = 0
            for reference in [*self.now[1], *(r for found in self.made.values() for r in found)]:
                reference.seen.clear()
        if self.shared is None:
            return self.now[1] if self.now[0] == name else []
        if name not in self.made:
            self.made[name] = self._made(self.shared.value.get(name, []))
        return self.made[name]


def meet(rows: DataFrame, made: DataFrame, by: str, work: Callable[[pa.RecordBatch, Known], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on batches of rows, with the references of their hosts.

    ``rows`` has columns host, ``by`` (what spreads a host's rows) and others;
    ``made`` has (host, references). Up to ``MOST_BROADCAST`` bytes, measured on
    the written table, the references are broadcast. Beyond, they travel as rows
    of their own: a host's rows are dealt over as many groups as its size asks
    for, each led by a copy of the references.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "host"]
    total = made.agg(F.sum(F.length(F.to_json("references")))).first()[0] or 0
    if total <= MOST_BROADCAST:
        table = {r["host"]: [x.asDict() for x in r["references"]] for r in made.collect()}  # MOST_BROADCAST bytes at most
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Known(shared)
            for batch in pieces(batches, names[-1]):
                yield work(batch, known)

        return rows.mapInArrow(run, schema)

    counts = rows.groupBy("host").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).alias("groups"))
    counts = materialize(counts.join(made.select("host"), "host", "left_semi"), "wrapper-groups")
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("groups")), F.lit(0)).alias("salt")
    led = rows.join(counts, "host", "left").select("host", salt, F.lit(1).alias("order"), *names, F.lit(None).cast(made.schema["references"].dataType).alias("references"))
    heads = made.join(counts, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("order"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "references")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = led.unionByName(heads).repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "order")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(None)
        for batch in pieces(batches, names[-1]):
            heads = [k for k, x in enumerate(batch.column("order").to_pylist()) if x == 0]
            for k, end in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
                if k >= 0:
                    known.learn(batch.column("host")[k].as_py(), batch.column("references")[k].as_py())
                if end > k + 1:
                    yield work(batch.slice(k + 1, end - k - 1), known)

    return dealt.mapInArrow(stream, schema)


def _votes(batch: pa.RecordBatch, known: Known) -> pa.RecordBatch:
    seen: Counter = Counter()
    for name, packed in zip(batch.column("host").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
        own = _unpack(packed)
        seen.update((name, reference, reference.key(own)) for reference in known.of(name))
    votes: dict[tuple[str, int, int], list[int]] = {}
    for (name, reference, key), times in seen.items():
        tree = reference.tree
        for i, j in reference.matched(key):
            vote = votes.setdefault((name, reference.digest, i), [0, 0])
            vote[0] += times
            vote[1] += times * (tree[i][2] == key[j][2])
    columns = list(zip(*[(*k, *v) for k, v in votes.items()], strict=True)) or [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "digest", "place", "n", "same"])


def references(trees: DataFrame) -> DataFrame:
    """(host, digest) of each host's reference pages."""
    seen = trees.mapInArrow(_places, "host string, place long, text long, digest long")
    per_text = seen.groupBy("host", "place", "text").agg(F.count("*").alias("n"), F.min("digest").alias("digest"))
    most = F.min(F.struct((-F.col("n")).alias("n"), "digest")).alias("most")
    per_place = per_text.groupBy("host", "place").agg(F.sum("n").alias("n"), F.min("digest").alias("least"), most).where(F.col("n") >= LEAST_PAGES)
    chosen = F.when(-F.col("most.n") >= CONSTANT_SHARE * F.col("n"), F.col("most.digest")).otherwise(F.col("least"))
    return per_place.select("host", chosen.alias("digest")).distinct()


REFERENCES = "array<struct<digest:long,nodes:string,votes:array<struct<place:int,n:long,same:long>>>>"


def templates(pages: DataFrame) -> DataFrame:
    """(host, references): the trees of each host's references with the votes on their nodes.

    One row per host; pages with equal trees vote once.
    """
    narrow = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null and host <> ''")
    parsed = narrow.mapInArrow(_skeletons, "host string, nodes string").withColumn("digest", F.xxhash64("nodes"))
    trees = materialize(parsed.dropDuplicates(["host", "digest"]), "wrapper-trees")
    chosen = materialize(trees.join(references(trees), ["host", "digest"], "left_semi"), "wrapper-references")
    grouped = chosen.groupBy("host").agg(F.collect_list(F.struct("digest", "nodes", F.lit(None).alias("votes"))).cast(REFERENCES).alias("references"))
    votes = meet(trees.select("host", "digest", "nodes"), materialize(grouped, "wrapper-grouped"), "digest", _votes, "host string, digest long, place int, n long, same long")
    counted = votes.groupBy("host", "digest", "place").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    per_tree = counted.groupBy("host", "digest").agg(F.sort_array(F.collect_list(F.struct("place", "n", "same"))).alias("votes"))
    made = chosen.join(per_tree, ["host", "digest"]).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("digest", "nodes", "votes"))).cast(REFERENCES).alias("references"))
    return materialize(made, "wrapper-templates")


def _extract(batch: pa.RecordBatch, known: Known) -> pa.RecordBatch:
    out = [main_text(parse(page.decode()), known.of(name)) for page, name in zip(texts(batch.column("html")), batch.column("host").to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(host(F.col("url")).alias("host"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return meet(rows, templates(pages), "page_id", _extract, "page_id long, url string, text string, n_chars long")
