"""Main text of web pages by template deduction from equivalence classes.

A page's tokens are its containers (by their path of tags and classes) and the
texts in each. A token's occurrence vector says how often each page of the host
holds it; it is kept as two random sums (exclusive or of hashes of page and
count), so tokens of equal vectors form an equivalence class without bringing
a host's pages together. A class is frequent from ``LEAST`` pages and
``SHARE`` of the host's pages on, and part of the template if it has a
container. Its texts are the template's if they stand in one order in their
container on every page; containers nest by their paths. What the template
leaves open are slots: each text belongs to the innermost container of the
template around it.

Slots of links are menus and go. The region of the article is found by going
down the template from its root as long as one container holds ``DOMINANT`` of
the slots' text. Slots outside it that hold little of the host's open text
(``SMALL``) go from pages that have text in the region. What is left goes only where element and class names (navigation,
adverts, forms, reader comments …) say that it is no article; none of them counts
around the region.
An ``article`` or ``main`` element is judged as one text. Pages of equal text
count once. Hosts with fewer than ``LEAST`` pages take the containers that are
frequent on all pages as their template.

A host's row holds at most ``1 / SHARE`` times the tokens of its average page.

Defined results: a null or empty page, or one without an article, has an empty
text; unclosed or stray tags are tolerated; repeated rows are reported each; a
page without url is a host of its own kind (the empty one).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

ANY_HOST = "//"  # no host is named so
LEAST = 3  # pages of a frequent class
SHARE = 0.2  # and its share of the host's pages
DOMINANT = 0.8  # of a container's text in one container below: the region is there
SMALL = 0.2  # of the open text of a host: a slot outside the region that holds no more goes
LINKED = 0.7  # a slot of links alone is a menu
BROADCAST_ROWS = 50_000
ROOT = 1  # the page itself as a container

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

_RAW = frozenset("script style noscript template title textarea iframe svg math canvas object xmp".split())
_NO_TEXT = _RAW | frozenset("head select option datalist audio video".split())
_CONTAINERS = frozenset("html body main article section div center table tbody tr td ul ol dl nav header footer aside form fieldset details".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_NEXT = {"p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article footer header nav aside form blockquote pre hr main".split()), "li": frozenset(["li"])}
# Names that break ties between small slots.
_SIDE_ELEMENTS = frozenset("nav footer aside form button dialog menu label fieldset figure-ad".split())
_SIDE = re.compile(
    r"^(?:ads?|adv|advert\w*|advertis\w*|banner|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|notices?|notification\w*|alert|"
    r"comments?\w*|disqus\w*|respond|replies|side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|foot|footer|masthead|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|popup|modal|overlay|widgets?|toolbar|pagination|pager|login|search|skip-?link)$"
)
_HEAD = frozenset(["header", "head", "site-header", "page-header", "topbar"])


def _hash(*parts: object) -> int:
    """A positive 63-bit hash."""
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts))) >> 1


class Node:
    """A container of a page: its path, the one around it, how often it occurs, whether its name speaks against it."""

    __slots__ = ("path", "parent", "times", "side", "article")

    def __init__(self, path: int, parent: int, side: bool, article: int):
        self.path, self.parent, self.times, self.side, self.article = path, parent, 0, side, article


class Page:
    """Containers and blocks of text of a page, in order; time and memory grow with the source only."""

    def __init__(self, source: str | None):
        self.nodes: dict[int, Node] = {ROOT: Node(ROOT, 0, False, 0)}
        self.nodes[ROOT].times = 1
        self.blocks: list[tuple[int, str, int]] = []  # path of the nearest container, text, characters in links
        # Open elements: name, path of the nearest container, text left out?
        self.stack: list[tuple[str, int, bool]] = []
        self.open_at: dict[str, list[int]] = {}
        self.block_at: list[int] = []  # open elements that are no inline ones
        self.pieces: list[str] = []
        self.linked = 0
        self._read(source or "")

    def keyed(self) -> list[tuple[int, int]]:
        """Of each block its holder (the outermost article around it, else its container) and its text's token."""
        whole: dict[int, list[str]] = {}
        for path, text, _ in self.blocks:
            if self.nodes[path].article:
                whole.setdefault(self.nodes[path].article, []).append(text)
        key = {path: _hash("article", path, *texts) for path, texts in whole.items()}
        return [(a, key[a]) if (a := self.nodes[path].article) else (path, _hash("text", path, text)) for path, text, _ in self.blocks]

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append((self.stack[-1][1] if self.stack else ROOT, text, self.linked))
        self.pieces.clear()
        self.linked = 0

    def _text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1][2]):
            text = html.unescape(raw)
            self.pieces.append(text)
            if self.open_at.get("a"):
                self.linked += len(text.strip())

    def _read(self, source: str) -> None:
        at = 0
        while (m := _TAG.search(source, at)) is not None:
            self._text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name)
                continue
            self._open(name, m[3] or m[6] or "")
            if name in _RAW and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                self._close(name)
        self._text(source[at:])
        self._flush()

    def _open(self, name: str, attributes: str) -> None:
        if name in _VOID:
            if name in ("br", "hr"):
                self.pieces.append(" ")
            return
        around = self.stack[self.block_at[-1]][0] if self.block_at else ""
        if name in _CLOSED_BY_NEXT.get(around, ()):
            self._close(around)
        inline = name in _INLINE
        if not inline:
            self._flush()
        known = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        words = [w.lower() for k in ("class", "id", "role") for w in known.get(k, "").split()]
        _, path, out = self.stack[-1] if self.stack else ("", ROOT, False)
        side = name in _SIDE_ELEMENTS or any(map(_SIDE.match, words))
        side = side or (not self.nodes[path].article and (name == "header" or any(w in _HEAD for w in words)))
        out = out or name in _NO_TEXT or (inline and side)
        if not inline and not out and (name in _CONTAINERS or side):
            path = self._enter(name, path, side, known, words)
        self.open_at.setdefault(name, []).append(len(self.stack))
        if not inline:
            self.block_at.append(len(self.stack))
        self.stack.append((name, path, out))

    def _enter(self, name: str, around: int, side: bool, known: dict[str, str], words: list[str]) -> int:
        path = _hash(around, name, side, *sorted(set(known.get("class", "").lower().split())))
        if path not in self.nodes:
            article = self.nodes[around].article
            if not article and not side and (name in ("article", "main") or "main" in known.get("role", "").lower().split()):
                article = path
            self.nodes[path] = Node(path, around, side, article)
        self.nodes[path].times += 1
        return path

    def _close(self, name: str) -> None:
        if not self.open_at.get(name):
            if name not in _INLINE:
                self._flush()  # the end of no open block still ends a block's text
            return
        place = self.open_at[name][-1]
        block = self.block_at[-1] if self.block_at else -1
        if name in _INLINE and block > place:
            return  # a stray inline end does not close blocks
        if block >= place:
            self._flush()
        while len(self.stack) > place:
            gone = self.stack.pop()[0]
            self.open_at[gone].pop()
            if self.block_at and self.block_at[-1] == len(self.stack):
                self.block_at.pop()


def host_of(url: str | None) -> str:
    found = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", url or "")
    return found[1].lower() if found else ""


def _structs(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_NODES = _structs(path=pa.int64(), parent=pa.int64(), times=pa.int32(), side=pa.bool_())
_TEXTS = _structs(token=pa.int64(), parent=pa.int64(), times=pa.int32())
_BLOCKS = _structs(node=pa.int32(), text=pa.int32(), chars=pa.int32(), linked=pa.int32())
#: A page's containers, its text tokens (with their holders), its blocks as places in these two lists, and the blocks' words.
READ = (
    "page_id long, url string, host string, digest binary, nodes array<struct<path:long,parent:long,times:int,side:boolean>>, "
    "texts array<struct<token:long,parent:long,times:int>>, blocks array<struct<node:int,text:int,chars:int,linked:int>>, words array<string>"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one reading of a page."""
    for whole in batches:
        for batch in common.chunks(whole, "html"):
            hosts, digests, nodes, texts, blocks, words = [], [], [], [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = Page(source)
                place = {path: k for k, path in enumerate(page.nodes)}
                token: dict[tuple[int, int], int] = {}
                at = [token.setdefault(pair, len(token)) for pair in page.keyed()]
                times = Counter(at)
                hosts.append(host_of(url))
                digests.append(xxhash.xxh3_128_digest(repr(([(n.path, n.times) for n in page.nodes.values()], page.blocks))))
                nodes.append([{"path": n.path, "parent": n.parent, "times": n.times, "side": n.side} for n in page.nodes.values()])
                texts.append([{"token": key, "parent": holder, "times": times[k]} for (holder, key), k in token.items()])
                blocks.append([{"node": place[p], "text": k, "chars": len(t), "linked": n} for (p, t, n), k in zip(page.blocks, at, strict=True)])
                words.append([t for _, t, _ in page.blocks])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(nodes, _NODES), pa.array(texts, _TEXTS),
                    pa.array(blocks, _BLOCKS), pa.array(words, pa.list_(pa.string())),
                ],
                ["page_id", "url", "host", "digest", "nodes", "texts", "blocks", "words"],
            )
    common.tidy()


def classes(pages: DataFrame) -> DataFrame:
    """One row per host: ``tags`` (container, the one around it, side) and ``texts`` of its frequent classes, with the class of each.

    ``pages`` are distinct (host, digest). Only hosts of ``LEAST`` pages and the row of all hosts come out.
    """
    tag = pages.select("host", "digest", F.explode("nodes").alias("t")).select("host", "digest", F.col("t.path").alias("token"), F.col("t.parent").alias("parent"), "t.times", F.lit(False).alias("is_text"), "t.side")
    text = pages.select("host", "digest", F.explode("texts").alias("t")).select("host", "digest", "t.token", "t.parent", "t.times", F.lit(True).alias("is_text"), F.lit(False).alias("side"))
    vector = [F.bit_xor(F.xxhash64(F.lit(k), "host", "digest", "times")).alias(f"v{k}") for k in (1, 2)]
    own = tag.unionByName(text).groupBy("host", "token").agg(*vector, F.count(F.lit(1)).alias("support"), F.max("parent").alias("parent"), F.bool_or("is_text").alias("is_text"), F.bool_or("side").alias("side"))
    # Over all hosts only containers count: a text of one host says nothing there. Sums of vectors are vectors.
    every = own.where("not is_text").groupBy("token").agg(F.bit_xor("v1").alias("v1"), F.bit_xor("v2").alias("v2"), F.sum("support").alias("support"), F.max("parent").alias("parent"), F.lit(False).alias("is_text"), F.bool_or("side").alias("side"))
    tokens = own.unionByName(every.select(F.lit(ANY_HOST).alias("host"), "token", "v1", "v2", "support", "parent", "is_text", "side"))
    sizes = tokens.where(F.col("token") == ROOT).select("host", F.col("support").alias("n")).where((F.col("n") >= LEAST) | (F.col("host") == ANY_HOST))
    frequent = tokens.join(sizes, "host").where((F.col("support") >= SHARE * F.col("n")) & ((F.col("support") >= LEAST) | (F.col("n") < LEAST)))
    member = F.struct("token", "parent", "is_text", "side")
    classed = frequent.groupBy("host", "v1", "v2").agg(F.collect_list(member).alias("members"), F.bool_and("is_text").alias("bare")).where("not bare")
    each = classed.select("host", F.col("v1").alias("class"), F.explode("members").alias("m")).select("host", "class", "m.*")
    return each.groupBy("host").agg(
        F.collect_list(F.when(~F.col("is_text"), F.struct("token", "parent", "side"))).alias("tags"),
        F.collect_list(F.when(F.col("is_text"), F.struct("token", "class", F.col("parent").alias("holder")))).alias("texts"),
    )


def orders(tokens: list[tuple[int, int]], of_class: dict[int, int]) -> list[tuple[int, int, int]]:
    """(class, holder, order) of a page's (holder, text token) rows: a hash of how a class's texts follow each other in a container, in whole rounds if they do."""
    found: dict[tuple[int, int], list[int]] = {}
    for holder, key in tokens:
        if key in of_class:
            found.setdefault((of_class[key], holder), []).append(key)
    out = []
    for (cls, holder), keys in found.items():
        single = list(dict.fromkeys(keys))
        out.append((cls, holder, _hash(*(single if single * (len(keys) // len(single)) == keys else keys))))
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, own, blocks, texts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            tokens = [(own[b["text"]]["parent"], own[b["text"]]["token"]) for b in blocks]
            rows += [(host, *x) for x in orders(tokens, {t["token"]: t["class"] for t in texts or ()})]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["host", "class", "holder", "order"])


def slots_of(nodes: list[dict], tags: set[int]) -> list[int]:
    """Of each container of a page the innermost one of the template at or around it (containers come before those inside)."""
    slot, out = {0: ROOT}, []
    for n in nodes:
        slot[n["path"]] = n["path"] if n["path"] in tags else slot[n["parent"]]
        out.append(slot[n["path"]])
    return out


def _masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text that the template leaves open, by slot: characters, and those in links."""
    for batch in batches:
        mass: dict[tuple[str, int], list[int]] = {}
        for key, nodes, texts, blocks, tags, fixed in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            slot, gone = slots_of(nodes, {t["token"] for t in tags or ()}), set(fixed or ())
            for b in blocks:
                if texts[b["text"]]["token"] not in gone:
                    own = mass.setdefault((key, slot[b["node"]]), [0, 0])
                    own[0] += b["chars"]
                    own[1] += b["linked"]
        keys, sums = list(mass), list(mass.values())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()), pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64())], ["host", "slot", "chars", "linked"])


def region_of(tags: list[dict], slots: list[dict]) -> tuple[list[int], list[int], list[int]]:
    """(containers from the root down to the region of the article, menus, slots outside the region that hold little)."""
    parent = {t["token"]: t["parent"] for t in tags}
    menus = {s["slot"] for s in slots if s["chars"] and s["linked"] >= LINKED * s["chars"]}
    below: dict[int, int] = {}
    children: dict[int, set[int]] = {}
    for s in slots:
        path = s["slot"]
        while s["slot"] not in menus and path:
            below[path] = below.get(path, 0) + s["chars"]
            children.setdefault(parent.get(path, 0), set()).add(path)
            path = parent.get(path, 0)
    spine, at = [], ROOT
    while at is not None:
        spine.append(at)
        at = next((c for c in sorted(children.get(at, ())) if below[c] > 0 and below[c] >= DOMINANT * below[spine[-1]]), None)
    def inside(path: int) -> bool:
        while path and path != spine[-1]:
            path = parent.get(path, 0)
        return path == spine[-1]

    most = SMALL * below.get(ROOT, 0)
    minor = [s["slot"] for s in slots if s["slot"] not in menus and s["chars"] <= most and not inside(s["slot"])]
    return spine, sorted(menus - {spine[-1]}), sorted(minor)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [region_of(tags, slots) for tags, slots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        longs = lambda values: pa.array(values, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(longs([x[k] for x in found]) for k in range(3))], ["host", "spine", "menus", "minor"])


def main_text(nodes: list[dict], texts: list[dict], blocks: list[dict], words: list[str], tags: set[int], fixed: set[int], spine: list[int], menus: set[int], minor: set[int], hints: bool = True) -> str:
    """Blocks that stand in a slot of the article and are not the template's, in order, joined by one space.

    On pages with text in the region the slots outside it that hold little on the host go. Without ``hints`` names have
    no say.
    """
    slot, region = slots_of(nodes, tags), spine[-1] if spine else ROOT
    side, inside = {0: False}, {0: False}
    for n in nodes:  # names around the region do not count
        side[n["path"]] = hints and n["path"] not in spine and (n["side"] or side[n["parent"]])
        inside[n["path"]] = n["path"] == region or inside[n["parent"]]
    free = [(b, said) for b, said in zip(blocks, words, strict=True) if texts[b["text"]]["token"] not in fixed and slot[b["node"]] not in menus]
    if any(inside[nodes[b["node"]]["path"]] for b, _ in free):
        free = [(b, said) for b, said in free if slot[b["node"]] not in minor]
    return " ".join(said for b, said in free if not side[nodes[b["node"]]["path"]])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for *page, tags, fixed, spine, menus, minor in zip(*(batch.column(k).to_pylist() for k in range(2, 11)), strict=True):
            texts.append(main_text(*page, {t["token"] for t in tags or ()}, set(fixed or ()), spine or [], set(menus or ()), set(minor or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _small(table: DataFrame, *arrays: str) -> DataFrame:
    """The table, marked for broadcast if its checked size allows."""
    weight = table.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in arrays]).first()
    return F.broadcast(table) if sum(weight) <= BROADCAST_ROWS else table


def templates(read: DataFrame) -> DataFrame:
    """One row per host: tags and fixed texts of its template, the spine of containers down to its region, its menus."""
    # Copies of a page say nothing about its template. Words stay behind: only numbers are dealt out.
    single = read.select("host", "digest", "nodes", "texts", "blocks").dropDuplicates(["host", "digest"])
    found = common.cut(classes(single), "classes")
    texts = _small(found.where("size(texts) > 0").select("host", "texts"), "texts")
    order = single.select("host", F.col("texts").alias("own"), "blocks").join(texts, "host").mapInArrow(_orders, "host string, class long, holder long, order long")
    order = order.groupBy("host", "class", "holder").agg((F.min("order") == F.max("order")).alias("ordered"))
    # A class's texts hang together in each container: those out of order leave the template.
    loose = order.where("not ordered").select("host", "class", "holder")
    fixed = found.select("host", F.explode("texts").alias("t")).select("host", "t.*").join(loose, ["host", "class", "holder"], "left_anti")
    template = found.select("host", "tags").join(fixed.groupBy("host").agg(F.collect_list("token").alias("fixed")), "host", "left")
    template = common.cut(template, "template")
    small = _small(template, "tags", "fixed")
    mass = keyed(single, template).select("key", "nodes", "texts", "blocks").join(small.withColumnRenamed("host", "key"), "key").mapInArrow(_masses, "host string, slot long, chars long, linked long")
    slots = mass.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "linked")).alias("slots"))
    regions = template.select("host", "tags").join(slots, "host").mapInArrow(_decide, "host string, spine array<long>, menus array<long>, minor array<long>")
    return common.cut(template.join(regions, "host", "left"), "regions")


def keyed(read: DataFrame, template: DataFrame) -> DataFrame:
    """Pages with ``key``: the host whose template they take."""
    own = template.where(F.col("host") != ANY_HOST).select("host", F.col("host").alias("own"))
    return read.join(own, "host", "left").withColumn("key", F.coalesce("own", F.lit(ANY_HOST))).drop("own")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text."""
    common.extra(pages, ("page_id", "url", "html"))
    common.ship(pages.sparkSession)
    read = common.cut(pages.select("page_id", "url", "html").mapInArrow(_read, READ), "pages", "zstd")
    found = templates(read)
    chosen = keyed(read, found).join(_small(found, "tags", "fixed", "spine", "menus", "minor").withColumnRenamed("host", "key"), "key", "left")
    return chosen.select("page_id", "url", "nodes", "texts", "blocks", "words", "tags", "fixed", "spine", "menus", "minor").mapInArrow(_extract, "page_id long, url string, text string")


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    found = extract_pages(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
