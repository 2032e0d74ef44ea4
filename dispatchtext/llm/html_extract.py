"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: elements, told apart by their path of open elements, and blocks of text. Per host,
elements with the same occurrence vector (how often they occur on each page) form an equivalence class. Classes of
two or more elements that occur once on nearly every page are candidates. A class is valid when its elements keep
one order over the pages (elements that do not are taken out of it) and when it does not interleave with a larger
class; the elements of valid classes, nested by their paths, are the host's template.

Texts fill the template's slots. A slot's variation is the size of its distinct texts over the size of all its
texts: menus, adverts and footers repeat, articles do not. From the root the template is followed down as long as
one container holds nearly all distinct text; that element is the article slot of the host. Template elements inside
it whose text repeats far more than the slot's are left out. Word lists only leave out what is named as an advert, a
menu or a comment inside the slot; hosts of fewer than MIN_PAGES pages share one template. Pages without a template
fall back to article and main elements, else to all text that is not marked.

Occurrence vectors are never gathered: each page adds a hash of (page, count) to an element's sum, so equal vectors
have equal sums. Pages are parsed twice, once into a small outline of hashes, once for the text; all steps between
are aggregations over outlines that combine before they shuffle, so a host of any size is spread over all tasks.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table

#: Hosts with fewer pages than this share one template.
MIN_PAGES = 5
#: A template element occurs on at least this share of a host's pages, and keeps its order there.
MIN_SHARE = 0.9
#: The article slot holds this share of its parent's distinct text.
SLOT_SHARE = 0.8
#: An element of the slot repeats if its variation is at most this share of the slot's.
REPEAT_SHARE = 0.3
#: Orders of one class that are compared; a class that needs more of them to cover MIN_SHARE of the pages is not valid.
MAX_ORDERS = 8
#: Paths kept in one process; the tree starts anew beyond that (results do not change).
MAX_NODES = 100_000
#: Characters in which a whole tag is looked for by one pattern; longer and broken ones are scanned.
SHORT = 256
#: Stands for all small hosts; no host name holds this character.
ALL = "*"

#: Elements without content of their own, raw-text elements, elements that end a block, elements
#: that can hold an article, elements that are never part of one, words in a class or id that say the same, and
#: words that say it only outside article and main elements of pages without a template.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDS = frozenset("html body main article section div center table tbody tr td".split())
APART = frozenset("head title nav footer aside form button select dialog menu".split()) | RAW
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|sidebar\w*|footer|breadcrumbs?|"
    r"comments?|commentlist|replies|respond|cookies?|consent|newsletter|subscribe|related|pagination|pager)(?:$|[\s_-])",
    re.I,
)
NAMED_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:side|header|masthead|reply|notice\w*|alert|popup|modal|share|social|recommend\w*|toolbar|widget\w*|disclaimer|copyright|legal|login|search)(?:$|[\s_-])", re.I
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDS = BLOCK - {"br", "body", "html", "head", "title", "caption", "option"}
INLINE = frozenset("b strong i em u a span small big font code tt s strike sub sup mark abbr cite q label".split())

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_SHORT = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")  # a whole tag, looked for in SHORT characters
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?<![\w:.-])([a-zA-Z_:][\w:.-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Node:
    """An element by its path. key: a hash of the path, the same in every process."""

    __slots__ = ("apart", "article", "holds", "key", "kids", "name", "outside", "up")

    def __init__(self, up: Node | None, sign: str):
        self.name, _, marks = sign.partition(".")
        self.up, self.kids = up, {}
        self.key = _signed(xxhash.xxh64_intdigest(f"{up.key}/{sign}")) if up else 0
        self.article = bool(up) and up.article or self.name in ("article", "main")
        self.holds = self.name in HOLDS
        marks = marks.replace(".", " ")
        named = self.name in APART or self.name == "header" and not self.article or bool(marks and NAMED.search(marks))
        self.apart = bool(up) and up.apart or named
        self.outside = bool(up) and up.outside or bool(marks and not self.article and NAMED_OUTSIDE.search(marks))

    def above(self) -> Iterator[Node]:
        """The element and its ancestors, without the root above html."""
        at = self
        while at.up:
            yield at
            at = at.up


class Paths:
    """A tree of all paths seen by one task."""

    def __init__(self):
        self.root, self.size = Node(None, ""), 0

    def under(self, up: Node, sign: str) -> Node:
        got = up.kids.get(sign)
        if got is None:
            self.size += 1
            got = up.kids[sign] = Node(up, sign)
        return got

    def fit(self) -> None:
        if self.size > MAX_NODES:
            self.__init__()


class Tags:
    """Finds the markup of a page from left to right, in time that grows with the page's length however broken it is.

    What has no end is text. A tag ends at the first > outside quotes; quotes that turned out to lead to no end are
    remembered, so that no later tag follows them again.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {x: page.rfind(x) for x in ("\"", "'", ">", "]]>")}
        self.dead: set[int] = set()
        self.seen = (0, -1)  # no stop lies between the first place and the second, which is one (or the page's end)

    def _stop(self, at: int) -> int:
        if not self.seen[0] <= at <= self.seen[1]:
            m = _STOP.search(self.page, at)
            self.seen = (at, m.start() if m else len(self.page))
        return self.seen[1]

    def _find(self, what: str, at: int) -> int:
        return self.page.find(what, at) if at <= self.last[what] else -1

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at `at`, or -1."""
        opened = []
        while (stop := self._stop(at)) < len(self.page) and stop not in self.dead:
            if self.page[stop] == ">":
                return stop
            opened.append(stop)
            close = self._find(self.page[stop], stop + 1)
            if close < 0:
                break
            at = close + 1
        self.dead.update(opened)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name with / if it closes, attributes) of the next markup from `at` on; comments and the like have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if m := _SHORT.match(page, start, start + SHORT):
                return start, m.end(), m[1], m[2]
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", ""
            if page.startswith("<![CDATA[", start) and (end := self._find("]]>", start + 9)) >= 0:
                return start, end + 3, "", ""
            if page[at : at + 1] in ("!", "?") and (end := self._find(">", at + 1)) >= 0:
                return start, end + 1, "", ""
            if (m := _NAME.match(page, at)) and (end := self.tag_end(m.end())) >= 0:
                return start, end + 1, m[0], page[m.end() : end]
        return None


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, signature) and ("close", name, "") in page order.

    The signature is the element's name with its class, id and role, numbers in them as #. Raw-text elements give
    one open and one close without their content. Character references are decoded in texts.
    """
    at, n, tags = 0, len(page), Tags(page)
    while at < n:
        found = tags.next(at)
        if not found:
            yield "text", _html.unescape(page[at:]), ""
            return
        start, end, name, rest = found
        if start > at:
            yield "text", _html.unescape(page[at:start]), ""
        at = end
        if not name:
            continue
        name = name.lower()
        if name[0] == "/":
            yield "close", name[1:], ""
            continue
        sign = name
        if rest:
            attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(rest)}
            sign += "".join(f".{_DIGITS.sub('#', attrs[k].lower())}" for k in ("class", "id", "role") if attrs.get(k))
        yield "open", name, sign
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            yield "close", name, ""
        elif name in VOID or rest.rstrip().endswith("/"):
            yield "close", name, ""


def walk(page: str, paths: Paths) -> Iterator[tuple[str, Node, str]]:
    """(kind, node, text or name): "text" (in node), "open" (node is the element) and "close" (node is what stays open).

    Inline markup, which authors leave unclosed, makes no nodes.
    """
    node = paths.root
    depth: dict[str, int] = {}  # open elements by name
    for kind, name, extra in events(page):
        if kind == "text":
            yield "text", node, name
        elif kind == "open":
            for drop in CLOSES.get(name, ()):
                if node.name == drop:
                    depth[drop] -= 1
                    node = node.up
            if name in P_ENDS and node.name == "p":
                depth["p"] -= 1
                node = node.up
            if name in INLINE:
                yield "open", node, name
            elif name in VOID or name in RAW:
                yield "open", paths.under(node, extra), name
            else:
                node = paths.under(node, extra)
                depth[name] = depth.get(name, 0) + 1
                yield "open", node, name
        else:
            if name not in INLINE and depth.get(name):
                while True:
                    closed, node = node.name, node.up
                    depth[closed] -= 1
                    if closed == name:
                        break
            yield "close", node, name


def texts(page: str, paths: Paths, wanted) -> Iterator[tuple[Node, str]]:
    """(node of its first piece, text) of every block with text of wanted nodes, white space tidied."""
    pieces: list[str] = []
    first = None
    for kind, node, text in walk(page, paths):
        if kind == "text":
            if wanted(node):
                first = node if not pieces else first
                pieces.append(text)
        elif text in BLOCK and pieces:
            block = _SPACE.sub(" ", "".join(pieces)).strip()
            if block:
                yield first, block
            pieces = []
    block = _SPACE.sub(" ", "".join(pieces)).strip()
    if block:
        yield first, block


def _not_apart(node: Node) -> bool:
    return not node.apart


OUTLINE = "host string, page long, tags array<struct<key:long,ups:array<long>,holds:boolean,n:int,pos:int>>, blocks array<struct<ups:array<long>,text:long,size:int>>"
_ARROW = {
    "tags": pa.list_(pa.struct([("key", pa.int64()), ("ups", pa.list_(pa.int64())), ("holds", pa.bool_()), ("n", pa.int32()), ("pos", pa.int32())])),
    "blocks": pa.list_(pa.struct([("ups", pa.list_(pa.int64())), ("text", pa.int64()), ("size", pa.int32())])),
}


def outlines(pages: DataFrame) -> DataFrame:
    """OUTLINE of each page (row, host, html): elements outside marked places with their ancestors, counts and places, and hashes of its text blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for part in slices(batches, "html"):
            tags, blocks = [], []
            for page in part.column("html").to_pylist():
                paths.fit()
                seen: dict[int, list] = {}
                for pos, (kind, node, _) in enumerate(walk(page or "", paths)):
                    if kind == "open" and not node.apart and node.up:
                        if node.key in seen:
                            seen[node.key][3] += 1
                        else:
                            seen[node.key] = [node.key, [a.key for a in node.above()][1:], node.holds, 1, pos]
                tags.append([dict(zip(("key", "ups", "holds", "n", "pos"), x)) for x in seen.values()])
                found = texts(page or "", paths, _not_apart)
                blocks.append([{"ups": [a.key for a in node.above()], "text": _signed(xxhash.xxh64_intdigest(t)), "size": len(t)} for node, t in found])
            names = [xxhash.xxh64_intdigest(r) >> 1 for r in part.column("row").to_pylist()]
            yield pa.record_batch([part.column("host"), pa.array(names, pa.int64()), pa.array(tags, _ARROW["tags"]), pa.array(blocks, _ARROW["blocks"])], names=["host", "page", "tags", "blocks"])

    return pages.mapInArrow(run, OUTLINE)


def classes(pages: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """host and its candidate elements (key, ups, holds, support and the vector that names the class) from grouped outlines.

    A candidate occurs once on nearly every page of the host and shares its occurrence vector with another one.
    """
    tag = pages.select("host", "page", F.explode("tags").alias("t"))
    hashed = F.xxhash64("page", "t.n").cast("decimal(38,0)")
    tokens = tag.groupBy("host", F.col("t.key").alias("key")).agg(
        F.count("*").alias("support"), F.sum("t.n").alias("total"), F.sum(hashed).alias("vector"), F.first("t.ups").alias("ups"), F.first("t.holds").alias("holds")
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    once = tokens.filter("total = support").join(sizes, "host").filter(F.col("support") >= min_share * F.col("pages"))
    both = F.collect_list(F.struct("key", "ups", "holds"))  # a class is part of one page, so it is no longer than a page
    found = once.groupBy("host", "pages", "support", "vector").agg(both.alias("members")).filter("size(members) >= 2")
    # Classes by size: the larger one wins where two interleave.
    order = F.array_sort(F.collect_list(F.struct((-F.size("members")).alias("size"), F.col("vector").cast("string").alias("vector"), "support", "members")))
    return found.groupBy("host", "pages").agg(order.alias("classes"))


def _gap(of: list[int], start: int, end: int) -> bool:
    """Whether start and end lie between the same two of the sorted places."""
    return np.searchsorted(of, start) == np.searchsorted(of, end)


def observations(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, what, a, b, n, seq: what each page says of its host's candidates.

    what 0: a the class, seq its elements in page order, b a hash of seq. what 1: a the class that interleaves with a
    larger one. what 2: a the innermost candidate around a block of text, b the text's hash, n its size.
    """
    schema = "host string, what int, a long, b long, n long, seq binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            hosts = batch.column("host").to_pylist()
            for host, tags, blocks, groups in zip(hosts, *(batch.column(c).to_pylist() for c in ("tags", "blocks", "keys"))):
                place = {t["key"]: t["pos"] for t in tags if t["n"] == 1}
                known = {k for g in groups for k in g}
                spans = []
                for i, g in enumerate(groups):
                    own = sorted((place[k], k) for k in g if k in place)
                    if len(own) < len(g):
                        spans.append(None)
                        continue
                    seq = np.array([k for _, k in own], "<i8").tobytes()
                    out.append((host, 0, i, _signed(xxhash.xxh64_intdigest(seq)), 1, seq))
                    at = [p for p, _ in own]
                    for larger in spans:
                        if larger and not _gap(larger, at[0], at[-1]) and not _gap(at, larger[0], larger[-1]):
                            out.append((host, 1, i, 0, 1, None))
                            break
                    spans.append(at)
                for b in blocks:
                    inner = next((k for k in b["ups"] if k in known), 0)
                    out.append((host, 2, inner, b["text"], b["size"], None))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    keys = F.transform("classes", lambda c: c["members"]["key"]).alias("keys")
    return pages.join(found.select("host", keys), "host").select("host", "tags", "blocks", "keys").mapInArrow(run, schema)


def _common(a: list[int], b: list[int]) -> list[int]:
    """Longest common subsequence of two orders of the same elements."""
    place = {k: i for i, k in enumerate(b)}
    best: list[list[int]] = []
    for i, k in enumerate(a):
        prior = max((best[j] for j in range(i) if place[a[j]] < place[k]), key=len, default=[])
        best.append([*prior, k])
    return max(best, key=len, default=[])


def template(pages: int, found: list[dict], orders: list[dict], clashes: dict[int, int], min_share: float = MIN_SHARE) -> dict[int, tuple[int, bool]]:
    """Element -> (nearest template element around it or 0, whether it can hold an article), for valid classes."""
    kept: dict[int, tuple[list[int], bool]] = {}
    for i, c in enumerate(found):
        most = sorted((o for o in orders if o["a"] == i), key=lambda o: (-o["k"], o["b"]))
        seen, common = 0, None
        for o in most:
            seq = np.frombuffer(o["seq"], "<i8").tolist()
            common = seq if common is None else _common(common, [k for k in seq if k in set(common)])
            seen += o["k"]
            if seen >= min_share * c["support"]:
                break
        if seen < min_share * c["support"] or clashes.get(i, 0) > (1 - min_share) * c["support"]:
            continue
        members = {m["key"]: m for m in c["members"]}
        kept |= {k: (members[k]["ups"], members[k]["holds"]) for k in common or ()}
    return {k: (next((u for u in ups if u in kept), 0), holds) for k, (ups, holds) in kept.items()}


def choose(tree: dict[int, tuple[int, bool]], ups: dict[int, list[int]], masses: list[dict], pages: int) -> tuple[int, list[int]]:
    """(article slot, elements in it that repeat) of a template; slot 0 if no container holds most of the distinct text.

    masses: candidate element, size of the distinct texts and of all texts whose innermost candidate it is.
    """
    own: dict[int, list[float]] = {k: [0.0, 0.0, 0.0] for k in [0, *tree]}
    for m in masses:
        at = m["a"]
        if at not in own:  # a candidate of a class that is not valid
            at = next((u for u in ups.get(at, ()) if u in tree), 0)
        for i, name in enumerate(("distinct", "total", "most")):
            own[at][i] = max(own[at][i], m[name]) if i == 2 else own[at][i] + m[name]
    kids: dict[int, list[int]] = {}
    for k, (up, _) in tree.items():
        kids.setdefault(up, []).append(k)
    whole = {k: [0.0, 0.0] for k in own}
    for k, (d, t, _) in own.items():
        at = k
        while True:
            whole[at][0] += d
            whole[at][1] += t
            if not at:
                break
            at = tree[at][0]
    slot = 0
    while True:
        inner = max((k for k in kids.get(slot, ()) if tree[k][1]), key=lambda k: (whole[k][0], k), default=None)
        if inner is None or whole[inner][0] < SLOT_SHARE * whole[slot][0] or not whole[slot][0]:
            break
        slot = inner
    limit = REPEAT_SHARE * whole[slot][0] / whole[slot][1] if whole[slot][1] else 0.0
    drop, todo = [], list(kids.get(slot, ()))
    while todo:
        k = todo.pop()
        d, t = whole[k]
        constant = not kids.get(k) and own[k][2] >= MIN_SHARE * pages  # one text on nearly every page
        if t and d / t <= limit and (tree[k][1] or constant):
            drop.append(k)
        else:
            todo += kids.get(k, ())
    return slot, sorted(drop)


def templates(grouped: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """host, slot and drop of every group of outlines that has a template with an article slot."""
    found = materialize(classes(grouped, min_share), "html-classes")
    seen = observations(grouped, found).groupBy("host", "what", "a", "b").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.first("seq").alias("seq"))
    seen = materialize(seen, "html-observations")
    top = F.row_number().over(Window.partitionBy("host", "a").orderBy(F.desc("k"), "b"))
    orders = seen.filter("what = 0").withColumn("rank", top).filter(F.col("rank") <= MAX_ORDERS).groupBy("host").agg(F.collect_list(F.struct("a", "b", "k", "seq")).alias("orders"))
    clashes = seen.filter("what = 1").groupBy("host").agg(F.collect_list(F.struct("a", "k")).alias("clashes"))
    mass = seen.filter("what = 2").groupBy("host", "a").agg(F.sum("n").cast("double").alias("distinct"), F.sum(F.col("n") * F.col("k")).cast("double").alias("total"), F.max("k").cast("double").alias("most"))
    masses = mass.groupBy("host").agg(F.collect_list(F.struct("a", "distinct", "total", "most")).alias("masses"))
    joined = found.join(orders, "host").join(masses, "host", "left").join(clashes, "host", "left")
    schema = "host string, slot long, drop array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                clash = {c["a"]: c["k"] for c in r["clashes"] or ()}
                tree = template(r["pages"], r["classes"], r["orders"], clash, min_share)
                ups = {m["key"]: m["ups"] for c in r["classes"] for m in c["members"]}
                slot, drop = choose(tree, ups, r["masses"] or [], r["pages"])
                if slot:
                    out.append({"host": r["host"], "slot": slot, "drop": drop})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("host", pa.string()), ("slot", pa.int64()), ("drop", pa.list_(pa.int64()))]))

    return joined.select("host", "pages", "classes", "orders", "masses", "clashes").mapInArrow(run, schema)


def extract(page: str | None, slot: int = 0, drop: frozenset[int] = frozenset(), paths: Paths | None = None) -> str:
    """The main text of one page, a line per block: text of the slot; of a page without the slot's element, or with slot 0,
    text of article and main elements, else all text that is not marked."""
    paths = paths or Paths()
    chosen: dict[Node, bool] = {}

    def inside(node: Node) -> bool:
        got = chosen.get(node)
        if got is None:
            keys = {a.key for a in node.above()}
            got = chosen[node] = not node.apart and slot in keys and keys.isdisjoint(drop)
        return got

    if slot:
        text = "\n".join(t for _, t in texts(page or "", paths, inside))
        if text or any(kind == "open" and node.key == slot for kind, node, _ in walk(page or "", paths)):
            return text
    found = [(node.article, t) for node, t in texts(page or "", paths, lambda n: not n.apart and not n.outside)]
    some = any(a for a, _ in found)
    return "\n".join(t for a, t in found if a or not some)


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null html is empty and gives an empty text. Pages without a url are one small host. A page whose host has a
    template but which lacks the slot's element is read like a page without a template. Null or repeated page_ids and
    repeated rows stay as they are. An empty table gives no rows. Other columns of pages are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
        F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
    )
    keyed = rows.select(F.concat_ws(":", F.col("page_id").cast("string"), F.xxhash64("url", "html").cast("string")).alias("row"), "host", "html")
    outline = materialize(outlines(keyed), "html-outlines")
    large = outline.groupBy("host").agg(F.count("*").alias("n")).filter((F.col("n") >= min_pages) & (F.col("host") != "")).select("host", F.lit(True).alias("large"))
    grouped = outline.join(large, "host", "left").withColumn("host", F.when(F.col("large"), F.col("host")).otherwise(ALL))
    found = materialize(templates(grouped), "html-templates")
    shared = found.filter(F.col("host") == ALL).first()  # one row: parts of one page
    own = rows.join(found.filter(F.col("host") != ALL), "host", "left").join(large, "host", "left")
    if shared is not None:
        own = own.withColumns(
            {
                "slot": F.when(F.col("large"), F.col("slot")).otherwise(F.lit(shared["slot"])),
                "drop": F.when(F.col("large"), F.col("drop")).otherwise(F.array(*map(F.lit, shared["drop"])).cast("array<long>")),
            }
        )
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for part in slices(batches, "html"):
            out = []
            for page, slot, drop in zip(*(part.column(c).to_pylist() for c in ("html", "slot", "drop"))):
                paths.fit()
                out.append(extract(page, slot or 0, frozenset(drop or ()), paths))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.select("page_id", "url", "html", "slot", "drop").mapInArrow(run, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
