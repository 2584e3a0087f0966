"""Main text of web pages by wrapper induction.

Every page becomes a tree of labelled elements in which runs of like siblings are one node. The different trees of one host
are aligned by simple tree matching and merged into the host's wrapper, in groups of bounded size and level by level, the
most common first, so that neither the order of pages nor their partitions matter and no host is gathered in one task. Then
every page is aligned with its host's wrapper, and an ordinary aggregation counts the pages of each node and of each text at
a node. What a full wrapper has no room for is counted too, by its labels below the node that it hangs on. Texts that stand
at one node in half of its pages (3 at least) are template; what varies is content. Pages of equal content count once.

Elements that say what they are (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles,
hidden ones) are left out whether or not they vary. Where a page marks its article, only that is taken, less the template
in it (copies of a page don't erase each other, as equal content counts once). Where none is marked, lists of three blocks
or more that are links throughout are menus and go.

Pages are read by a scanner that takes time in proportion to their length, whatever they hold, and no step recurses deeper
than ``DEEP`` levels: elements further down share the node of their ancestor at that depth, and what follows ``WIDE``
different children shares the nodes of like label, or one node for all. Their texts are taken and counted like all others.

Defined results: a null or empty html gives an empty text; a null url is a host of its own; broken markup is read as far
as it goes (an unclosed tag ends with its parent, a ``<`` that opens no tag is text, a quote that never closes is none, an
unclosed comment or script ends with the page); a reference to no character is U+FFFD; repeated rows stay; an empty table
gives no rows; other columns are ignored. White space of any kind in a block becomes one blank.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafloom.llm.common import slices, written

MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"[^\s/>]+")
STOP = re.compile(r"[>\"']")
REFERENCE = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*))")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source br".split())
#: Elements that the start of the same kind ends, and the scopes in which open ones are looked for.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
ENDED = frozenset(ENDS) | {"thead"}
LISTS = frozenset("ul ol dl table select".split())
STOPS = frozenset("ul ol dl table body html article section div main td th".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
OUT_TAGS = frozenset("nav footer aside form head button select option input textarea dialog menu svg canvas object audio video map datalist".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "nav navbar navigation navi menu submenu breadcrumb breadcrumbs sidebar sidenav aside footer foot masthead topbar header banner ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment commentlist disqus respond reply replies widget pagination pager copyright toolbar search skip outbrain taboola paywall".split()
)
MAIN_NAMES = frozenset("articlebody article-body article-content entry-content post-content main-content story-body post-body".split())
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
MOST_NODES = 400  # of a wrapper; what comes later is told by its labels
DEEP, WIDE = 64, 64
TREES = 2_000  # of one host that are merged in one task
HOT_PAGES, HOT_HOSTS = 20_000, 100_000  # pages under one key of a join; hosts of more, at most
SHARE, LEAST = 0.5, 3


def kind_of(tag: str, attributes: str) -> tuple[str, int]:
    """(label, what it is: 1 left out, 2 article, 4 a header)."""
    return _kind_held(tag, attributes) if len(attributes) <= 200 else _kind(tag, attributes)


def _kind(tag: str, attributes: str) -> tuple[str, int]:
    names, out = [], 0
    if attributes:
        found: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value.strip("\"'"))
        names = [n for k in ("class", "id") for n in found.get(k, "").split()]
        roles = set(found.get("role", "").lower().split())
        style = found.get("style", "").replace(" ", "").lower()
        if roles & OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            out |= 1
        if "main" in roles or found.get("itemprop", "").lower() == "articlebody" or any(n.lower() in MAIN_NAMES for n in names):
            out |= 2
        if tag not in ("html", "body", "article", "main") or not out:
            for n in names:
                parts = [p.lower() for p in NAME_PART.findall(n)]
                if not parts or parts[0] in ("has", "with", "no", "without"):
                    continue
                if any(p in OUT_NAMES for p in parts) and tag not in ("html", "body", "main"):
                    out |= 4 if set(parts) & OUT_NAMES == {"header"} else 1
    if tag in ("article", "main") and not out & 1:
        out |= 2
    if tag in OUT_TAGS:
        out |= 1
    if tag == "header":
        out |= 4
    return (f"{tag}.{names[0]}" if names else tag)[:40], out


_kind_held = lru_cache(65536)(_kind)


class Node:
    __slots__ = ("label", "children")

    def __init__(self, label: str):
        self.label, self.children = label, []


class Block:
    """A block's text and where it stood."""

    __slots__ = ("links", "main", "node", "out", "parts", "text")

    def __init__(self, node: Node, out: bool, main: bool):
        self.node, self.out, self.main, self.parts, self.links, self.text = node, out, main, [], 0, ""


class Scanner:
    """The marks of a page, one after another; every failed look ahead is remembered, so that none is made twice."""

    def __init__(self, source: str):
        self.source, self.last, self.dead = source, source.rfind(">"), set()
        self.cdata = True

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose attributes begin here: at the next ``>`` outside quotes, or else the next one."""
        source, opened, here = self.source, [], at
        while True:
            found = STOP.search(source, here)
            if found is None:
                break
            k = found.start()
            if source[k] == ">":
                return k
            if k in self.dead:
                break
            opened.append(k)
            close = source.find(source[k], k + 1)
            if close < 0:
                break
            here = close + 1
        self.dead.update(opened)  # no quote that opens at one of these leads to a tag's end
        return source.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, tag, whether it closes, attributes) of the next mark; a mark that is no tag has an empty tag."""
        source = self.source
        while True:
            found = MARK.search(source, at)
            if found is None:
                return None
            begin, at = found.start(), found.end()
            if source.startswith("!--", begin + 1):
                end = source.find("-->", at)
                return begin, len(source) if end < 0 else end + 3, "", False, ""
            if source.startswith("![", begin + 1) and self.cdata:
                end = source.find("]]>", at)
                if end >= 0:
                    return begin, end + 3, "", False, ""
                self.cdata = False
            if begin > self.last:
                continue  # no tag ends any more
            if source[begin + 1] in "!?":
                return begin, source.find(">", at) + 1, "", False, ""
            closes = source[begin + 1] == "/"
            name = TAG.match(source, begin + 1 + closes)
            end = self.tag_end(name.end())
            return begin, end + 1, name[0].lower(), closes, source[name.end() : end]


def child_of(parent: Node, label: str) -> Node:
    children = parent.children
    if children and children[-1].label == label:
        return children[-1]
    if len(children) >= WIDE:
        for c in children:
            if c.label == label:
                return c
        if children[-1].label == "*":
            return children[-1]
        label = "*"
    children.append(Node(label))
    return children[-1]


def parse(source: str) -> tuple[Node, list[Block]]:
    """The collapsed tree and the blocks of a page, in page order."""
    root = Node("#")
    # (tag, node, left out, in an article, inside a link)
    stack: list[tuple[str, Node, bool, bool, bool]] = [("#", root, False, False, False)]
    blocks: list[Block] = []
    block: Block | None = None
    at, n = 0, len(source)
    scanner = Scanner(source)
    # what is open: block-level tags; inline tags of each block-level element; p of each scope; items of each list
    opened: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]
    paragraphs, items = [0], [Counter()]
    base_at = [0]  # places in the stack of the elements that aren't inline

    def put(text: str) -> None:
        nonlocal block
        if block is None:
            if not text.strip():
                return
            _, node, out, main, _ = stack[base_at[-1]]
            top = stack[-1]
            block = Block(node, out or top[2], main or top[3])
            blocks.append(block)
        block.parts.append(text)
        if stack[-1][4]:
            block.links += len(text)

    def push(tag: str, node: Node, out: bool, main: bool, link: bool) -> None:
        base_at.append(len(stack))
        stack.append((tag, node, out, main, link))
        opened[tag] += 1
        inline.append(Counter())
        if tag == "p":
            paragraphs[-1] += 1
        elif tag in STOPS:
            paragraphs.append(0)
        if tag in ENDED:
            items[-1][tag] += 1
        elif tag in LISTS:
            items.append(Counter())

    def pop_to(k: int) -> None:
        nonlocal block
        while len(stack) > k:
            tag = stack.pop()[0]
            if base_at[-1] < len(stack):
                inline[-1][tag] -= 1
                continue
            block = None
            base_at.pop()
            inline.pop()
            opened[tag] -= 1
            if tag == "p":
                paragraphs[-1] -= 1
            elif tag in STOPS:
                paragraphs.pop()
            if tag in ENDED:
                items[-1][tag] -= 1
            elif tag in LISTS:
                items.pop()

    def pop_last(kinds: frozenset[str] | set[str]) -> int:
        """Close the last open element of these kinds; its place."""
        k = len(stack) - 1
        while stack[k][0] not in kinds:
            k -= 1
        pop_to(k)
        return k

    while at < n:
        found = scanner.next(at)
        if found is None:
            put(source[at:])
            break
        begin, end, tag, closes, attributes = found
        if begin > at:
            put(source[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if tag == "br":
                put(" ")
            elif tag in INLINE:
                if inline[-1][tag] > 0:
                    pop_last({tag})
            elif opened[tag] > 0:
                pop_last({tag})
            else:
                block = None
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(source, at)
            at = close.end() if close else n
            if tag in ("textarea", "title"):
                block = None
            continue
        if tag in INLINE:
            if tag == "br":
                put(" ") if block is not None else None
            elif tag not in VOID:
                _, node, out, main, link = stack[-1]
                out = out or bool(attributes) and bool(kind_of(tag, attributes)[1] & 1)
                stack.append((tag, node, out, main, link or tag == "a"))
                inline[-1][tag] += 1
            continue
        block = None
        if tag in VOID:
            continue
        if tag in CLOSES_P and paragraphs[-1]:
            pop_last({"p"})
        if tag in ENDS:
            kinds = ENDS[tag]
            if any(items[-1][x] > 0 for x in kinds):
                low = pop_last(kinds)
                while low > 1 and stack[low - 1][0] in kinds:
                    low -= 1
                pop_to(low)
        label, what = kind_of(tag, attributes)
        _, parent, out, main, link = stack[-1]
        node = parent if len(base_at) > DEEP else child_of(parent, label)
        main = main or bool(what & 2)
        out = out or bool(what & 1) or (bool(what & 4) and not main)
        push(tag, node, out, main, link)
    for b in blocks:
        b.text = " ".join(decoded("".join(b.parts)).split())
    return root, [b for b in blocks if b.text]


def decoded(text: str) -> str:
    """A text with its character references read, however many digits they have."""
    if "&" not in text:
        return text

    def short(m: re.Match) -> str:
        sign, digits = ("&#x", m[1]) if m[1] is not None else ("&#", m[2])
        if not digits:
            return m[0] if not m[0].endswith("0") else sign + "0"
        return sign + (digits if len(digits) <= 7 else "110000" if m[1] is not None else "1114112")

    return entities.unescape(REFERENCE.sub(short, text) if "&#" in text else text)


def text_key(text: str, rest: int = 0) -> int:
    """Of a text at a node, or below it where ``rest`` tells the labels from there."""
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8, salt=rest.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


# A wrapper's node: [label, pages, {text key: pages}, children]; the key of an empty text has the pages of what is below the node


def matching(a: list, b: list, label, below) -> list[tuple[int, int]]:
    """Simple tree matching of two ordered lists of children: the pairs of the largest matching."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n == m and all(label(x, 0) == label(y, 1) for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            w = 1 + below(a[i - 1], b[j - 1]) if label(a[i - 1], 0) == label(b[j - 1], 1) else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    out, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def tree_of(x: Node) -> list:
    """A page's tree as the wrapper of itself: its first ``MOST_NODES`` nodes, level by level."""
    out = [x.label, 1, {}, []]
    room, level = MOST_NODES - 1, [(x, out)]
    while level:
        below = []
        for node, held in level:
            for c in node.children[:room]:
                held[3].append([c.label, 1, {}, []])
                below.append((c, held[3][-1]))
            room -= len(held[3])
        level = below
    return out


def nodes(w: list) -> int:
    return 1 + sum(map(nodes, w[3]))


def merge(a: list, b: list, room: list[int], sizes: dict | None = None) -> None:
    """Put wrapper b into a: matched nodes add up, others are inserted in order while there is room."""
    sizes = {} if sizes is None else sizes

    def size(x: list, y: list) -> int:
        if (id(x), id(y)) not in sizes:
            pairs = matching(x[3], y[3], lambda z, _: z[0], size)
            sizes[id(x), id(y)] = sum(1 + size(x[3][i], y[3][j]) for i, j in pairs)
        return sizes[id(x), id(y)]

    pairs = matching(a[3], b[3], lambda x, _: x[0], size)
    for i, j in pairs:
        merge(a[3][i], b[3][j], room, sizes)
    matched = {j: i for i, j in pairs}
    shift, last = 0, -1
    for j, child in enumerate(b[3]):
        if j in matched:
            last = matched[j] + shift
        elif room[0] >= (n := nodes(child)):
            room[0] -= n
            last += 1
            a[3].insert(last, child)
            shift += 1


def merged(wrappers: Iterator[list]) -> list | None:
    out, room = None, [0]
    for w in wrappers:
        if out is None:
            out, room = w, [MOST_NODES - nodes(w)]
        else:
            merge(out, w, room)
    return out


def in_order(w: list) -> list[list]:
    """A wrapper's nodes, parents first."""
    return [w, *(x for c in w[3] for x in in_order(c))]


def places(root: Node, wrapper: list) -> dict[int, tuple[int, int]]:
    """By a page's node: the number of the wrapper's node that it is aligned with, or else that of the next aligned one above and a digest of the labels from there."""
    number = {id(w): k for k, w in enumerate(in_order(wrapper))}
    out: dict[int, tuple[int, int]] = {}
    sizes: dict[tuple[int, int], int] = {}

    def label(x, side: int) -> str:
        return x.label if side else x[0]

    def size(w: list, p: Node) -> int:
        if (id(w), id(p)) not in sizes:
            sizes[id(w), id(p)] = sum(1 + size(w[3][i], p.children[j]) for i, j in matching(w[3], p.children, label, size))
        return sizes[id(w), id(p)]

    def align(w: list, p: Node, rest: int) -> None:
        out[id(p)] = number[id(w)], rest
        pairs = {} if rest else {j: i for i, j in matching(w[3], p.children, label, size)}
        for j, c in enumerate(p.children):
            if j in pairs:
                align(w[3][pairs[j]], c, 0)
            else:
                align(w, c, text_key(c.label, rest) or 1)

    align(wrapper, root, 0)
    return out


def template(root: Node, blocks: list[Block], wrapper: list | None) -> list[bool]:
    """Whether each block stands in the wrapper as a recurring text."""
    if not wrapper:
        return [False] * len(blocks)
    held, place = in_order(wrapper), places(root, wrapper)
    out = []
    for b in blocks:
        at, rest = place[id(b.node)]
        _, pages, counts, _ = held[at]
        if rest:
            pages = counts.get(str(text_key("", rest)), 0)
        out.append(counts.get(str(text_key(b.text, rest)), 0) >= max(LEAST, SHARE * pages))
    return out


def telling(blocks: list[Block]) -> list[Block]:
    """The blocks that can be content: those of the marked article, if there is one."""
    article = any(b.main and not b.out for b in blocks)
    return [b for b in blocks if not b.out and (b.main or not article)]


def content(source: str, wrapper: list | None) -> tuple[str, int]:
    """A page's text, and how many blocks the wrapper took from it."""
    root, blocks = parse(source)
    article = any(b.main and not b.out for b in blocks)
    fixed = {id(b) for b, t in zip(blocks, template(root, blocks, wrapper), strict=True) if t}
    may = telling(blocks)
    rest = [b for b in may if id(b) not in fixed]
    taken = len(may) - len(rest)
    if not article:
        lists: dict[int, list[Block]] = {}
        for b in rest:
            lists.setdefault(id(b.node), []).append(b)
        menus = {k for k, held in lists.items() if len(held) >= 3 and held[0].node.label.split(".")[0] != "p" and all(b.links >= 0.9 * sum(map(len, b.parts)) for b in held)}
        rest = [b for b in rest if id(b.node) not in menus]
    return "\n".join(b.text for b in rest), taken


def host(url: str = "url"):
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(found, F.lit(""))


def wrappers(pages: DataFrame, most: int | None = None) -> DataFrame:
    """host, wrapper (JSON), pages: the different trees of each host's pages, aligned and merged; no texts yet."""
    most = most or TREES

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["host", "wrapper", "pages"])

        for batch in batches:
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[h, json.dumps(tree_of(parse(source.as_py())[0]))] += 1
                if len(held) > 5_000:  # a worker holds so many trees at most
                    yield out()
        yield out()

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pages", "wrapper"], ascending=[False, True])
        return pd.DataFrame({"host": [frame.host.iloc[0]], "wrapper": [json.dumps(merged(map(json.loads, frame.wrapper)))], "pages": [frame.pages.sum()]})

    kind = "host string, wrapper string, pages long"
    trees = written(pages.mapInArrow(inside, kind).groupBy("host", "wrapper").agg(F.sum("pages").alias("pages")), "trees")
    while (n := trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > most:
        salted = trees.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(math.ceil(2 * n / most))))
        trees = written(salted.groupBy("host", "salt").applyInPandas(lambda f: together(f), kind), "trees")
    return trees.groupBy("host").applyInPandas(together, kind)


def beside(pages: DataFrame, found: DataFrame, most_bytes: int, keep: list[str], run, schema) -> DataFrame:
    """``run(part, sources, wrappers)`` over all pages, 256 at a time, each beside its host's wrapper. part has the host and the columns of ``keep``.

    Wrappers of up to ``most_bytes`` in all are broadcast. More are joined by host; a host of very many pages is dealt over
    several keys, as many as its pages ask for, and its wrapper goes to each. There are ``HOT_HOSTS`` such hosts at most.
    """
    facts = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64).alias("bytes"), F.sum("pages").alias("pages")).first()
    small = (facts.bytes or 0) <= most_bytes
    held = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in found.select("host", "wrapper").collect()}) if small else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list | None] = ("", None)
        read: dict[str, list | None] = {}
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("html")):
                own = []
                for i, h in enumerate(part.column("host").to_pylist()):
                    if held is not None:
                        if h not in read:
                            if len(read) > 2_000:
                                read.clear()
                            read[h] = json.loads(held.value[h]) if h in held.value else None
                        own.append(read[h])
                    else:
                        if last[0] != h or last[1] is None:
                            stored = part.column("wrapper")[i].as_py()
                            last = h, json.loads(stored) if stored else None
                        own.append(last[1])
                yield run(part, part.column("html").to_pylist(), own)

    columns = [*keep, "host", "html"]
    if small:
        return pages.select(*columns).mapInArrow(each, schema)
    hot = max(HOT_PAGES, math.ceil((facts.pages or 0) / HOT_HOSTS))  # so there are HOT_HOSTS of them at most
    keys = found.select("host", F.ceil(F.col("pages") / hot).cast("long").alias("keys")).where("keys > 1")
    dealt = pages.join(F.broadcast(keys), "host", "left").withColumn("key", F.floor(F.rand(7) * F.coalesce("keys", F.lit(1))))
    copies = found.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("pages") / hot).cast("long") - 1))).select("host", "wrapper", "key")
    return dealt.join(copies, ["host", "key"], "left").select(*columns, "wrapper").mapInArrow(each, schema)


def counted(pages: DataFrame, found: DataFrame, most_bytes: int) -> DataFrame:
    """host, wrapper (JSON), pages: with the exact counts of the texts that recur. Pages of equal content are one."""

    def seen(part: pa.RecordBatch, sources: list[str], own: list) -> pa.RecordBatch:
        rows = []
        for h, source, w in zip(part.column("host").to_pylist(), sources, own, strict=True):
            root, blocks = parse(source)
            page = text_key("\n".join(b.text for b in telling(blocks)))
            place = places(root, w)
            stood = {(*at, text_key("", at[1])) for at in place.values()}
            texts = {(*place[id(b.node)], text_key(b.text, place[id(b.node)][1])) for b in blocks if not b.out}
            rows += [(h, *x, page) for x in stood | texts]
        types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["host", "node", "rest", "key", "page"])

    at = ["host", "node", "rest"]
    rows = beside(pages, found, most_bytes, [], seen, "host string, node int, rest long, key long, page long")
    often = written(rows.distinct().groupBy(*at, "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST), "wrapper-texts")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stored, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = json.loads(stored)
                held = in_order(w)
                for t in texts or []:
                    x = held[t["node"]]
                    if t["rest"]:
                        x[2][str(text_key("", t["rest"]))] = t["pages"]
                    else:
                        x[1] = t["pages"]
                    x[2][str(t["key"])] = t["n"]
                out.append(json.dumps(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(3)], ["host", "wrapper", "pages"])

    # an empty text's key is that of the place itself
    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_key("", r) for r in b.column(2).to_pylist()], pa.int64())], [*b.schema.names, "own"])

    keyed = often.select(*at, "key", "n").mapInArrow(own_keys, "host string, node int, rest long, key long, n long, own long")
    stood = keyed.where("key = own").select(*at, F.col("n").alias("pages"))
    texts = keyed.where("key <> own").join(stood, at).where(F.col("n") >= SHARE * F.col("pages"))
    by_host = texts.groupBy("host").agg(F.collect_list(F.struct("node", "rest", "key", "n", F.col("pages").alias("pages"))).alias("texts"))  # two texts a block of a page at most
    return found.join(by_host, "host", "left").select("host", "wrapper", "texts", "pages").mapInArrow(filled, "host string, wrapper string, pages long")


def extract(pages: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks that the wrapper took out of what could be content)."""
    plain = pages.select("page_id", "url", host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = written(wrappers(plain.select("host", "html")), "wrappers")
    found = written(counted(plain, found, most_bytes), "wrappers")

    def run(part: pa.RecordBatch, sources: list[str], own: list) -> pa.RecordBatch:
        out, taken = zip(*map(content, sources, own), strict=True)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(taken, pa.int64())], ["page_id", "url", "text", "n_chars", "n_template"])

    out = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_template", T.LongType())])
    return beside(plain, found, most_bytes, ["page_id", "url"], run, out)
