"""Main text of web pages by wrapper induction.

Pages are parsed into DOM trees, whose nodes are elements, named by tag, class, id and role, and blocks of text.  Pages of a host that have
the same elements at the top are of one layout, and one of them, chosen by a hash of its id, represents it.  Every page is aligned with
the page of its layout by simple tree matching: nodes of equal names are matched level by level so that the number of matched nodes is
largest.  The representative's nodes are the layout's slots.  Over all pages of the layout, with page copies counted once, a slot whose
text is the same on nine of ten pages, and that at least half of the pages have, is template; one whose text varies is content, unless
most of it is in links.  A layout whose pages hardly vary, as copies of one page with small edits do, has no template.  Where pages mark
their article, slots outside it are not content, and those inside are judged by their texts like others, but their links are the article's; slots in elements that hold no article text by their meaning
(``DROP_TAGS``, ``DROP_WORDS`` in class, id or role, hidden ones) are furniture.

A page's text is then what stands in content slots, in page order.  A block that is matched with no slot follows its own meaning, then
the nearest element around it that is.  Blocks are cut at block elements and line breaks; their character references are decoded and
white space becomes single spaces.  Nothing else is dropped or cut.

Simple tree matching weighs all pairs of children with equal names; children of nodes with over ``WIDE`` such pairs, and of all nodes
once a page has used ``BUDGET``, are paired by name and number among that name instead, as many as stay in order.

Edge cases: null or empty html gives an empty text; a null or odd url is a host of its own name; a layout of under three distinct pages
has no template and its slots follow their meaning alone; unclosed, misnested and truncated markup is closed where its parents end,
however deep or wide; repeated rows and ties give equal texts; a row without an id is extracted like any other; an empty table gives an
empty result; further columns are ignored.  Wrappers are sent to all executors only if they are under ``MOST_BROADCAST`` bytes
together, else joined by host and layout.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, OrderedDict
from dataclasses import dataclass
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, saved, small_batches
from .textkernel import mix64

MOST_BROADCAST = 32 << 20
#: Pairs of children weighed at one pair of nodes, and for one page.
WIDE, BUDGET = 10_000, 400_000
#: Distinct pages from which a slot is judged, the share of them with one text that makes it template, the share of text that has to
#: vary in a layout, and the share of text in links that makes a slot furniture.
LEAST_PAGES, CONSTANT, VARIED, LINKED = 3, 0.9, 0.1, 0.6
# Element names and words of class, id and role of what is not article text.
DROP_TAGS = frozenset("aside button canvas datalist dialog embed footer form frame frameset head iframe input legend map menu meter nav noscript object option progress script select style svg template textarea title".split())
DROP_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline-social comment comments commentlist complementary consent contentinfo cookie cookies disqus footer form gdpr "
    "hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
MAIN_TAGS = frozenset("article main".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
CONTAINERS = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+(?:[0-9]+)?|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


FURNITURE, ARTICLE = 1, 2


class Tree:
    """Nodes in page order; node 0 is the root.  Names of elements are hashes of what they are called, those of blocks of text are below 0.

    Names tell flags too, so that only nodes of equal flags match.
    """

    def __init__(self):
        self.names, self.parents, self.flags, self.kids = [0], [-1], [0], [[]]
        #: of blocks: node, text or its hash, characters, and how many of them are in links
        self.blocks: list[tuple[int, str | int, int, int]] = []
        self._shape: tuple[list[int], list[int]] | None = None

    def add(self, name: int, parent: int, flags: int) -> int:
        node = len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        self.flags.append(flags)
        self.kids.append([])
        self.kids[parent].append(node)
        return node

    def shape(self) -> tuple[list[int], list[int]]:
        """For each node a hash of the names below it and how many nodes it has, itself included."""
        if self._shape is None:
            n = len(self.names)
            hashes, sizes = [0] * n, [1] * n
            for k in range(n - 1, -1, -1):
                kids = self.kids[k]
                hashes[k] = hash((self.names[k], *[hashes[c] for c in kids]))
                sizes[k] += sum([sizes[c] for c in kids])
            self._shape = hashes, sizes
        return self._shape

    def marked(self) -> bool:
        """Whether the page marks its article."""
        return any(self.flags[b[0]] == ARTICLE for b in self.blocks)

    def layout(self) -> int:
        """A hash of the elements at the top, down to the children of the body, and of whether there is an article."""
        depth, found = [0] * len(self.names), set()
        for k in range(1, len(self.names)):
            depth[k] = depth[self.parents[k]] + 1
            if depth[k] <= 3 and self.names[k] > 0:
                found.add((depth[k], self.names[k]))
        return crc32(repr((sorted(found), self.marked())).encode())

    def packed(self) -> bytes:
        """The tree with hashes for its texts."""
        nodes = np.array([self.names, self.parents, self.flags], "<i8").ravel()
        blocks = np.array([(n, text_hash(t), c, k) for n, t, c, k in self.blocks], "<i8").ravel()
        return compress(np.concatenate([[len(self.names)], nodes, blocks]).astype("<i8").tobytes(), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        a = np.frombuffer(decompress(data), "<i8").tolist()
        n, out = a[0], cls()
        out.names, out.parents, out.flags = a[1 : 1 + n], a[1 + n : 1 + 2 * n], a[1 + 2 * n : 1 + 3 * n]
        out.kids = [[] for _ in range(n)]
        for k in range(1, n):
            out.kids[out.parents[k]].append(k)
        rest = a[1 + 3 * n :]
        out.blocks = [tuple(rest[k : k + 4]) for k in range(0, len(rest), 4)]
        return out


def text_hash(text: str | int) -> int:
    return text if isinstance(text, int) else crc32(text.encode())


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """What class, id and role call the element (digits left out), whether it is furniture by its words, whether its role is main."""
    names, drop, main = [], False, False
    for key, a, b, c in _ATTR.findall(raw):
        value, key = (a or b or c).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            drop = True
        elif key in ("class", "id", "role"):
            names.append(_DIGITS.sub("", value))
            drop = drop or not DROP_WORDS.isdisjoint(_WORD.findall(value))
            main = main or key == "role" and value == "main"
    return ".".join(names), drop, main


_DIGITS = re.compile(r"[0-9]+")


def parse(html: str) -> Tree:
    """The tree of a page, blocks with their texts."""
    tree = Tree()
    # open elements: name, flags, whether in a link, node, node of the nearest block element
    stack: list[tuple[str, int, bool, int, int]] = [("#root", 0, False, 0, 0)]
    opened: Counter = Counter()
    parts: list[str] = []
    linked = 0
    top = stack[0]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tree.blocks.append((tree.add(-1 - top[1], top[4], top[1]), text, len(text), min(linked, len(text))))
            parts.clear()
        linked = 0

    def close_from(k: int) -> None:
        nonlocal top
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]
        top = stack[-1]

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        end = m.start() if m else size
        if end > at:
            text = html[at:end]
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if top[2]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        close, name, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if close:
            if name in BLOCK_TAGS or name in DROP_TAGS:
                flush()
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close_from(k)
            continue
        if name in BLOCK_TAGS or name in DROP_TAGS:
            flush()
        if name in VOID_TAGS:
            continue
        if name in RAW_TAGS:
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
            at = found.end() if found else size
            continue
        closes = CLOSES.get(name) or (("p",) if name in BLOCK_TAGS else ())
        if any(opened[x] for x in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    close_from(k)
                    break
                if stack[k][0] in CONTAINERS:
                    break
        label, drop, main = _attributes(raw) if "=" in raw or "hidden" in raw else ("", False, False)
        own = name in MAIN_TAGS or main
        drop = top[1] & FURNITURE or name in DROP_TAGS or (drop and name not in ("html", "body") and not own) or (name == "header" and not top[1] & ARTICLE)
        flags = (FURNITURE if drop else 0) | (ARTICLE if own or top[1] & ARTICLE else 0)
        node = tree.add(crc32(f"{name}.{label}.{flags}".encode()) + 1, top[3], flags)
        top = (name, flags, top[2] or name == "a", node, node if name in BLOCK_TAGS else top[4])
        stack.append(top)
        opened[name] += 1
    flush()
    return tree


def _by_number(x: list[int], y: list[int], a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Children paired by name and number among that name, as many as stay in order."""
    where: dict[tuple[int, int], int] = {}
    count: Counter = Counter()
    for j, q in enumerate(y):
        where[b[q], count[b[q]]] = j
        count[b[q]] += 1
    count.clear()
    pairs = []
    for i, p in enumerate(x):
        if (j := where.get((a[p], count[a[p]]))) is not None:
            pairs.append((i, j))
        count[a[p]] += 1
    # a longest increasing run of the second numbers
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back[k] = last[at - 1] if at else -1
        if at == len(ends):
            ends.append(j)
            last.append(k)
        else:
            ends[at], last[at] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append((x[pairs[k][0]], y[pairs[k][1]]))
        k = back[k]
    return out[::-1]


def align(a: Tree, b: Tree) -> tuple[list[int], int]:
    """Simple tree matching: for each node of a the matched node of b or -1, and how many are matched."""
    (ha, sa), (hb, _) = a.shape(), b.shape()
    na, nb, ka, kb = a.names, b.names, a.kids, b.kids
    worth: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    plans: dict[tuple[int, int], tuple] = {}
    used = 0
    # equal subtrees match as a whole, leaves match alone; other pairs wait on the stack for their children's pairs
    known = lambda p, q: sa[p] if ha[p] == hb[q] else 1 if not ka[p] or not kb[q] else worth.get((p, q))
    stack = [(0, 0)]
    while stack:
        pair = stack[-1]
        if pair in worth:
            stack.pop()
            continue
        plan = plans.get(pair)
        if plan is None:
            x, y = ka[pair[0]], kb[pair[1]]
            low, most = 0, min(len(x), len(y))
            while low < most and ha[x[low]] == hb[y[low]]:
                low += 1
            up = 0
            while up < most - low and ha[x[-1 - up]] == hb[y[-1 - up]]:
                up += 1
            same = [*zip(x[:low], y[:low], strict=True), *zip(x[len(x) - up :], y[len(y) - up :], strict=True)]
            x, y = x[low : len(x) - up], y[low : len(y) - up]
            cells = len(x) * len(y)
            numbered = cells > WIDE or used + cells > BUDGET
            used += 0 if numbered else cells
            cells_ = _by_number(x, y, na, nb) if numbered else [(p, q) for p in x for q in y if na[p] == nb[q]]
            plan = plans[pair] = (same, x, y, cells_, numbered)
            waiting = [c for c in cells_ if known(*c) is None]
            if waiting:
                stack.extend(waiting)
                continue
        same, x, y, cells_, numbered = plan
        picked = same + (cells_ if numbered else _best(x, y, {c: known(*c) for c in cells_}))
        chosen[pair], worth[pair] = picked, 1 + sum([known(*c) for c in picked])
        del plans[pair]
        stack.pop()
    out = [-1] * len(na)
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        out[p] = q
        if (p, q) in chosen:
            stack.extend(chosen[p, q])
        elif ha[p] == hb[q]:
            stack.extend(zip(ka[p], kb[q], strict=True))
    return out, worth[0, 0]


def _best(x: list[int], y: list[int], value: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The pairs, in order on both sides, with the largest sum."""
    if not value:
        return []
    table = [[0] * (len(y) + 1)]
    for p in x:
        above, row = table[-1], [0]
        for j, q in enumerate(y):
            here = max(above[j + 1], row[j])
            v = value.get((p, q))
            row.append(here if v is None else max(here, above[j] + v))
        table.append(row)
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
    return out[::-1]


@dataclass
class Wrapper:
    """A layout: its page's tree, the texts (slot, hash) that are template, and the slots that are menus."""

    tree: Tree
    template: frozenset[tuple[int, int]]
    menus: frozenset[int]

    def __post_init__(self):
        marked = self.tree.marked()
        self.content = [f == ARTICLE if marked else not f & FURNITURE for f in self.tree.flags]

    def text_of(self, page: Tree) -> str:
        """What stands in the page's content slots."""
        slots, _ = align(page, self.tree)
        out = []
        for node, text, *_ in page.blocks:
            slot = slots[node]
            if slot >= 0:
                keep = self.content[slot] and slot not in self.menus and (slot, text_hash(text)) not in self.template
            elif page.flags[node] & FURNITURE:
                keep = False
            else:
                up = page.parents[node]
                while slots[up] < 0:
                    up = page.parents[up]
                # an element that marks an article of its own is one, wherever it stands
                keep = self.content[slots[up]] or bool(page.flags[node] & ARTICLE)
            if keep:
                out.append(text)
        return "\n".join(out)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def shapes(pages: DataFrame) -> DataFrame:
    """Of pages (page_id, host, html) with html: host, layout, a hash h of the id, one of the content, whether it may represent its layout (the least h of a task so far), and the tree."""

    def run(batches):
        least: dict[tuple[str, int], int] = {}
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            ids = np.asarray(b.column("page_id").fill_null(-1), np.int64)
            hashes = (mix64(ids.view(np.uint64)) >> np.uint64(1)).astype(np.int64).tolist()
            for h, host, html in zip(hashes, b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if not html:
                    continue
                tree = parse(html)
                layout = tree.layout()
                first = h < least.get((host, layout), 1 << 63)
                if first:
                    if len(least) > 100_000:
                        least.clear()
                    least[host, layout] = h
                content = crc32(repr([(n, t) for n, t, *_ in tree.blocks]).encode()) << 31 | crc32(repr(tree.names).encode()) >> 1
                for c, x in zip(cols, (host, layout, h, content, first, tree.packed()), strict=True):
                    c.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], SHAPE)

    return pages.mapInArrow(lean(run), "host string, layout long, h long, content long, first boolean, tree binary")


SHAPE = ["host", "layout", "h", "content", "first", "tree"]


def induce(shaped: DataFrame) -> DataFrame:
    """(host, layout, tree, template, menus): the wrappers, from the shapes of all pages."""
    key = ["host", "layout"]
    best = shaped.filter("first").groupBy(*key).agg(F.min(F.struct("h", "tree")).alias("best")).select(*key, F.col("best.tree").alias("tree"))
    reps = saved(best)
    distinct = saved(shaped.select(*key, "content", "tree").dropDuplicates([*key, "content"]))

    def count(batches):
        trees: OrderedDict[bytes, Wrapper] = OrderedDict()
        found: dict[tuple, list[int]] = {}

        def rows():
            keys, sums = list(found), list(found.values())
            kinds = (pa.string(), *[pa.int64()] * 6)
            cols = [*zip(*keys, strict=True), *zip(*sums, strict=True)] if keys else [[]] * 7
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "layout", "slot", "text", "n", "chars", "linked"])

        for b in batches:
            for host, layout, own, rep in zip(*(b.column(c).to_pylist() for c in ("host", "layout", "tree", "rep")), strict=True):
                if rep not in trees:
                    trees[rep] = Wrapper(Tree.unpacked(rep), frozenset(), frozenset())
                    if len(trees) > 64:
                        trees.popitem(last=False)
                page = Tree.unpacked(own)
                layout_page = trees[rep]
                slots, _ = align(page, layout_page.tree)
                for node, text, chars, linked in page.blocks:
                    if slots[node] >= 0 and layout_page.content[slots[node]]:
                        linked = 0 if page.flags[node] == ARTICLE else linked
                        at = found.setdefault((host, layout, slots[node], text), [0, 0, 0])
                        at[0], at[1], at[2] = at[0] + 1, at[1] + chars, at[2] + linked
            if len(found) > 200_000:
                yield rows()
        yield rows()

    pairs = distinct.join(reps.withColumnRenamed("tree", "rep"), key).select(*key, "tree", "rep")
    texts = pairs.mapInArrow(lean(count), "host string, layout long, slot long, text long, n long, chars long, linked long")
    texts = texts.groupBy(*key, "slot", "text").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked")))
    slots = texts.groupBy(*key, "slot").agg(F.max(F.struct("n", "text")).alias("top"), *(F.sum(c).alias(c) for c in ("n", "chars", "linked")))
    slots = slots.join(distinct.groupBy(*key).agg(F.count("*").alias("pages")), key)
    menu = (F.col("n") >= LEAST_PAGES) & (F.col("linked") > LINKED * F.col("chars"))
    fixed = ~menu & (F.col("n") >= LEAST_PAGES) & (2 * F.col("n") >= F.col("pages")) & (F.col("top.n") >= CONSTANT * F.col("n"))
    per = slots.withColumn("menu", menu).withColumn("fixed", fixed).groupBy(*key).agg(
        F.sum(F.when(~F.col("menu"), F.col("chars"))).alias("chars"),
        F.sum(F.when(~F.col("menu") & ~F.col("fixed"), F.col("chars"))).alias("varied"),
        F.collect_list(F.when(F.col("fixed"), F.struct("slot", F.col("top.text").alias("text")))).alias("template"),
        F.collect_list(F.when(F.col("menu"), F.col("slot"))).alias("menus"),
    )
    enough = F.coalesce(F.col("varied") >= VARIED * F.col("chars"), F.lit(False))
    none = F.array().cast("array<struct<slot:bigint,text:bigint>>")
    per = per.select(*key, F.when(enough, F.col("template")).otherwise(none).alias("template"), "menus")
    return saved(reps.join(per, key, "left"))


def read_wrapper(row) -> Wrapper:
    return Wrapper(Tree.unpacked(bytes(row["tree"])), frozenset((x["slot"], x["text"]) for x in row["template"] or ()), frozenset(row["menus"] or ()))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url and text."""
    small_batches(pages.sparkSession)
    context = pages.sparkSession.sparkContext
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of("url"))
    wrappers = induce(saved(shapes(p.select("page_id", "host", "html"))))
    schema = "page_id long, url string, text string"

    def texts(b: pa.RecordBatch, htmls: list, find) -> pa.RecordBatch:
        out = []
        for k, html in enumerate(htmls):
            page = parse(html) if html else None
            out.append(find(k, page.layout()).text_of(page) if page else "")
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    size = wrappers.agg(F.sum(64 + F.octet_length("host") + F.octet_length("tree") + 16 * F.coalesce(F.size("template"), F.lit(0)))).first()[0] or 0
    if size <= MOST_BROADCAST:
        shipped = context.broadcast({(r.host, r.layout): r.asDict(recursive=True) for r in wrappers.collect()})

        def run(batches):
            known: dict[tuple[str, int], Wrapper] = {}
            for b in batches:
                hosts = b.column("host").to_pylist()

                def find(k, layout, hosts=hosts):
                    key = hosts[k], layout
                    if key not in known:
                        known[key] = read_wrapper(shipped.value[key])
                    return known[key]

                yield texts(b, b.column("html").to_pylist(), find)

        return p.mapInArrow(lean(run), schema)

    def lay(batches):
        for b in batches:
            layouts = [parse(html).layout() if html else None for html in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(layouts, pa.int64())], [*b.schema.names, "layout"])

    def run_joined(batches):
        known: OrderedDict[bytes, Wrapper] = OrderedDict()
        for b in batches:
            rows = b.select(["tree", "template", "menus"]).to_pylist()

            def find(k, layout, rows=rows):
                key = rows[k]["tree"]
                if key not in known:
                    known[key] = read_wrapper(rows[k])
                    if len(known) > 64:
                        known.popitem(last=False)
                return known[key]

            yield texts(b, b.column("html").to_pylist(), find)

    # two plain sides, so that Spark can split the pages of a busy host
    joined = p.mapInArrow(lean(lay), "page_id long, url string, html string, host string, layout long").join(wrappers, ["host", "layout"], "left")
    return joined.select("page_id", "url", "html", "tree", "template", "menus").mapInArrow(lean(run_joined), schema)
