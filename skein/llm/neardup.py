"""Near-duplicate classes: MinHash with banding, and alternating stars.

A document's set holds its distinct 5-word shingles. Equal sets collapse to
one node first. Each node gets minima of universal hash functions (a row of
``BANDINGS`` says how many), cut into bands; nodes that agree on a band meet in a bucket. A bucket links
its members to its smallest node and to one drawn by hash, never all pairs. Candidates
pass a check of their signatures and then the exact check on full sets.
Components come from alternating large-star and small-star steps. Nodes of
buckets that still hold several components get a second, exact look: each
files its rarest shingles, as many as a partner in another component must hit
(a prefix filter; shingles of one component alone come first and are hit by
none, then the rarest), and pairs that meet there early enough to be similar
(a positional filter) are confirmed too. Components meet before their nodes
do, so members of one class never pair up here. No link between different
texts is lost to the choice of leaders.

At a similarity of 0.85 a pair shares no band with probability 1.2e-5
(24 bands of 6), and its signature falls below the floor with probability
2e-6; at 0.80 these are 7e-6 (30 bands of 5) and 1e-7.

Defined results: null or empty texts (no words) have an empty set, are linked
with nothing and are kept; a row without id gets a null component and is kept;
rows that repeat an id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

WIDTH = 5
SEED = 20_240_601
STEP = 1.05  # sizes of sets that are a step apart meet under keys of their own
OP2_PERCENT = 85  # the similarity of op2's contract; the operator's own default is 80
# From this similarity on (percent): bands, rows of a band, least share of equal minima.
BANDINGS = {85: (24, 6, 0.70), 80: (30, 5, 0.62)}


class Banding:
    """Hash functions, their cut into bands and the floor of signatures for a similarity."""

    def __init__(self, percent: int):
        least = max((p for p in BANDINGS if p <= percent), default=None)
        if least is None:
            raise ValueError(f"no banding for a similarity of {percent} percent; the lowest is {min(BANDINGS)}")
        self.bands, self.rows, self.floor = BANDINGS[least]
        self.hashes = self.bands * self.rows
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64)

SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, bytes binary"


def shingle_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    if not len(words):
        return words
    return np.unique(common.window_hashes(words, min(width, len(words))))


def _sets(batch: pa.RecordBatch, column: str, hashes: common.WordHashes) -> list[np.ndarray]:
    texts = common.as_bytes(batch.column(batch.schema.get_field_index(column)))
    return [shingle_set(hashes.of(t.translate(common.LOWER).split())) if t else np.empty(0, np.uint64) for t in texts]


def minima(sets: list[np.ndarray], banding: Banding) -> np.ndarray:
    """Signatures (documents x hashes) of non-empty sets."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), banding.hashes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(banding.hashes):
            out[:, k] = np.minimum.reduceat((flat * banding.a[k] + banding.b[k]) >> np.uint64(32), starts)
    return out


def _sign(banding: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for whole in batches:
            for batch in common.chunks(whole, "text", 400_000):
                sets = _sets(batch, "text", hashes)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                short: list[bytes | None] = [None] * len(sets)
                if full:
                    signatures = minima([sets[i] for i in full], banding)
                    with np.errstate(over="ignore"):
                        cut = common.window_hashes(signatures.reshape(-1).astype(np.uint64), banding.rows)[:: banding.rows].reshape(len(full), banding.bands)
                        cut = common.mix(cut + np.arange(1, banding.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    low = (signatures & np.uint32(255)).astype(np.uint8)
                    for j, i in enumerate(full):
                        keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                        bands[i], short[i] = cut[j].view(np.int64), low[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "bands", "bytes"],
                )
        common.tidy(hashes)

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = common.WordHashes()
    for whole in batches:
        for batch in common.chunks(whole, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch, "text", hashes)], pa.binary())], ["node", "members"])
    common.tidy(hashes)


def _alike(banding: Banding):
    """Pairs whose signatures agree on enough of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, banding.hashes) for k in (2, 3))
            good = (one == two).mean(1) >= banding.floor
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[place] == y).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough, first by signature, then exactly."""
    short = nodes.select("node", "bytes")
    signed = (
        pairs.join(short.withColumnsRenamed({"node": "a", "bytes": "one"}), "a")
        .join(short.withColumnsRenamed({"node": "b", "bytes": "two"}), "b")
        .select("a", "b", "one", "two")
    )
    alike = common.cut(signed.mapInArrow(_alike(Banding(percent)), "a long, b long"), "alike")
    involved = alike.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = texts.withColumnRenamed("doc_id", "node").join(involved, "node").select("node", "text").mapInArrow(_full_sets, "node long, members binary")
    sets = common.cut(sets, "sets")
    full = (
        alike.join(sets.withColumnsRenamed({"node": "a", "members": "one"}), "a")
        .join(sets.withColumnsRenamed({"node": "b", "members": "two"}), "b")
        .select("a", "b", "one", "two")
    )
    out = common.cut(full.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "links")
    common.drop(alike)
    common.drop(sets)
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component, set size) and a text to one row for each shingle of its set."""
    hashes = common.WordHashes()
    for whole in batches:
        for batch in common.chunks(whole, "text", 400_000):
            sets = _sets(batch, "text", hashes)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            spread = [pa.array(np.repeat(np.asarray(batch.column(k)), sizes)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*spread, pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "component", "n", "token"])
    common.tidy(hashes)


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """Of each node its rarest shingles, as many as a partner in another component must hit.

    A partner of a set of n holds ``percent`` of it, so it hits each choice of
    more than the remaining shingles. Shingles that one component alone holds
    come first in that order: no partner elsewhere has them. ``rest`` counts
    the shingles from this one on.
    """
    held = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("times")).where("low < high")
    shared = common.cut(tokens.join(held.select("token", "times"), "token"), "shared")
    reach = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.col("common"))
    able = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("common")).withColumn("reach", reach).where("reach > 0").select("node", "n", "common", "reach")
    rarest = Window.partitionBy("node", "n").orderBy("times", "token")
    ranked = shared.join(able, ["node", "n"]).withColumn("at", F.row_number().over(rarest) - 1).where("at < reach")
    out = common.cut(ranked.select("token", "component", "node", "n", (F.col("common") - F.col("at")).alias("rest")), "prefix")
    common.drop(shared)
    return out


def placed_by_size(prefix: DataFrame, percent: int) -> DataFrame:
    """Prefix shingles by the sizes of node and partner (steps of ``STEP``), where they come early enough for such a partner.

    Seen from the first shingle that two similar sets share, at most ``rest`` of either are left, and these must
    hold ``percent`` of the union: a partner of nearly the same size must be met within the first shingles.
    """
    step = math.log(STEP)
    own = F.floor(F.log("n") / step)
    sizes = F.sequence(F.floor(F.log(F.col("n") * percent / 100) / step), F.floor(F.log(F.col("n") * 100 / percent) / step))
    each = prefix.withColumn("own", own).withColumn("other", F.explode(sizes))
    least = F.greatest(F.floor(F.pow(F.lit(STEP), F.col("other"))) - 1, F.floor(F.col("n") * percent / 100), F.lit(1))
    early = each.where((100 + percent) * F.col("rest") >= percent * (F.col("n") + least))
    return early.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def across(prefix: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) for each prefix shingle that two nodes of different components and fitting sizes share.

    Components meet first and only those that differ bring their nodes, so
    members of one class never meet each other here.
    """
    placed = common.cut(placed_by_size(prefix, percent), "by-size")
    key = ["token", "lo", "hi"]
    owner = placed.groupBy(*key, "own", "component").agg(F.max("rest").alias("most"), F.min("n").alias("small"))
    enough = lambda resta, restb, na, nb: (100 + percent) * F.least(resta, restb) >= percent * (F.col(na) + F.col(nb))
    side = lambda k, own: owner.where(F.col("own") == F.col(own)).select(*key, F.col("component").alias(f"c{k}"), F.col("most").alias(f"most{k}"), F.col("small").alias(f"small{k}"))
    differ = F.when(F.col("lo") == F.col("hi"), F.col("ca") < F.col("cb")).otherwise(F.col("ca") != F.col("cb"))
    meet = side("a", "lo").join(side("b", "hi"), key).where(differ & enough("mosta", "mostb", "smalla", "smallb")).select(*key, "ca", "cb")
    node = lambda k, own: placed.where(F.col("own") == F.col(own)).select(*key, F.col("component").alias(f"c{k}"), F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"rest{k}"))
    met = meet.join(node("a", "lo"), [*key, "ca"]).join(node("b", "hi"), [*key, "cb"]).where(enough("resta", "restb", "na", "nb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node: alternating large-star and small-star steps.

    Both stars are minima by key (combined before the shuffle) and an equi-join,
    so a hub's neighbours never meet in one task.
    """
    edges = common.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = common.cut(small.where("u <> v").distinct(), "edges")
        # Done when every node has one edge, and that edge leads to a node without one: stars.
        state = after.groupBy("u").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("most")).first()
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        common.drop(edges)
        edges = after
        if state["most"] == 1 and not chained:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    common.extra(docs, ("doc_id", "text"))
    common.ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    signed = common.cut(texts.mapInArrow(_sign(Banding(percent)), SIGNED), "signed")
    # One node for each distinct set: its smallest id.
    identified = signed.where("doc_id is not null and set_key is not null")
    named = identified.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = identified.join(named.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"])
    nodes = common.cut(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "bytes"), "nodes")

    members = nodes.select(F.struct("node", "n").alias("one"), F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("one").alias("low"), F.max("one").alias("high"), F.min_by("one", F.xxhash64("one.node", "bucket")).alias("drawn")).where("low.node < high.node")
    met = common.cut(members.join(buckets.select("bucket", "low", "drawn"), "bucket"), "buckets")
    stars = met.select("one", F.explode(F.array("low", "drawn")).alias("two")).where(100 * F.least("one.n", "two.n") >= percent * F.greatest("one.n", "two.n"))
    stars = stars.select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b"))
    pairs = common.cut(stars.where("a <> b").distinct(), "pairs")
    links = confirm(pairs, nodes, texts, percent)
    final = components(links)

    placed = met.select("bucket", "one.node").join(final, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    placed = common.cut(placed, "placed")
    common.drop(met)
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_ = placed.join(several, "bucket", "left_semi").select("node", "component").distinct()
    held = texts.withColumnRenamed("doc_id", "node").join(open_, "node").select("node", "component", "text", F.xxhash64("text").alias("text_key"))
    tokens = common.cut(held.dropDuplicates(["node", "text_key"]).mapInArrow(_tokens, "node long, component long, n long, token long"), "tokens")
    common.drop(placed)
    prefix = prefixes(tokens, percent)
    common.drop(tokens)
    second = common.cut(across(prefix, percent).distinct().join(pairs, ["a", "b"], "left_anti"), "across")
    common.drop(prefix)
    common.drop(pairs)
    more = confirm(second, nodes, texts, percent)
    if not more.isEmpty():
        final = components(links.unionByName(more))
    common.drop(second)
    common.drop(nodes)

    of_set = named.join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), OP2_PERCENT)


OP2_SQL = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, md5(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) as s
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from docs where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)
), edges as (
  select a, b from links union all select b, a from links
), reached(doc_id, other) as (
  select doc_id, doc_id from docs union select r.doc_id, e.b from reached r join edges e on r.other = e.a
), components as (
  select doc_id, min(other) as component_id from reached group by doc_id
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from docs d left join sizes using (doc_id) join components using (doc_id)
"""
