"""Benchmark decontamination with a positional inverted index.

Training documents are indexed in segments: for each segment of the corpus and
each term in it, the sorted positions of that term. The index holds every term,
is written once to the shared folder and serves every block of test items. A
test window (ten consecutive words of an item) is looked up from its rarest
term (by its frequency in the whole corpus): the lists, shifted by each term's
offset, are intersected from the rarest to the most frequent. That gives exact
phrase matches; the same lists with a slop give proximity matches. Postings
stay with their segment, so no term's list is ever gathered in one task,
however frequent the term, and a segment looks only at windows one of whose
rarest terms it holds.

The benchmark is taken in blocks of at most about ``BLOCK_WORDS`` words (a
single longer item is its own bound); each block's windows, never the whole
benchmark, go to the executors. Blocks are put together by a document's place
in the index, so the number of blocks changes no result. Terms are told apart
by 64-bit hashes.

Defined results: null or empty texts have no words and no hits; an item with
fewer than ten words is one window, one without words is none; all items
without id count as one, named null; rows that repeat an id are reported
each; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

WINDOW = 10
BLOCK_WORDS = 500_000
SEGMENT_BYTES = 1_000_000
SLOP = 2
NEAR_TERMS = 8
_GAP = WINDOW + 2 * SLOP + 1  # between two documents of a segment: nothing matches across

#: Lower-case letters, digits and every byte above ASCII stay; capitals become small; the rest separates.
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))

SEGMENT = "segment long, ids array<long>, lengths array<int>, terms binary, ends binary, positions binary"
MATCH = "segment long, place int, doc_id long, n_words long, starts array<int>, stops array<int>, items array<string>, near_items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class Windows:
    """The distinct windows of some items, by length, as term hashes, with the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.names: list[str | None] = []
        hashes = common.WordHashes()
        found: dict[tuple[int, ...], set[int]] = {}
        number: dict[str | None, int] = {}
        for name, text in items:
            ids = list(map(hashes.__getitem__, words_of((text or "").encode())))
            if not ids:
                continue
            if name not in number:
                number[name] = len(self.names)
                self.names.append(name)
            width = min(WINDOW, len(ids))
            for k in range(len(ids) - width + 1):
                found.setdefault(tuple(ids[k : k + width]), set()).add(number[name])
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows; their items, as offsets and a list
        for width in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == width]
            held = [sorted(found[w]) for w in own]
            self.groups.append((np.array(own, np.uint64), np.concatenate([[0], np.cumsum(list(map(len, held)))]), np.array([x for h in held for x in h], np.int64)))
        self.terms = np.unique(np.concatenate([w.reshape(-1) for w, _, _ in self.groups])) if found else np.empty(0, np.uint64)

    def order(self, frequency: np.ndarray) -> list[np.ndarray]:
        """For each group, each window's offsets from the rarest term on; ``frequency`` follows ``terms``."""
        return [np.argsort(frequency[np.searchsorted(self.terms, w)], axis=1, kind="stable") for w, _, _ in self.groups]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    hashes = common.WordHashes()
    for whole in batches:
        for batch in common.chunks(whole, "text", SEGMENT_BYTES):
            docs = [hashes.of(words_of(t)) for t in common.as_bytes(batch.column(1))]
            lengths = np.fromiter(map(len, docs), np.int64, len(docs))
            begins = np.cumsum(lengths + _GAP) - lengths
            term = np.concatenate(docs)
            place = (np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(term))).astype(np.int32)
            by = np.argsort(term, kind="stable")
            terms, counts = np.unique(term[by], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 33) + made], pa.int64()),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([terms.tobytes()], pa.binary()),
                    pa.array([np.cumsum(counts).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([place[by].tobytes()], pa.binary()),
                ],
                ["segment", "ids", "lengths", "terms", "ends", "positions"],
            )
            made += 1
    common.tidy(hashes)


def _frequencies(terms: np.ndarray):
    """How often each of some terms occurs, by its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, known = _find(np.frombuffer(own, np.uint64), terms)
                total[known] += np.diff(np.frombuffer(ends, np.int32), prepend=0)[at[known]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], ["term", "n"])

    return run


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class Postings:
    """One segment's lists; a term is its place among the segment's terms (-1: not here), positions ascend."""

    def __init__(self, terms: bytes, ends: bytes, positions: bytes):
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.frombuffer(ends, np.int32).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.positions = np.frombuffer(positions, np.int32).astype(np.int64)
        self.span = int(self.positions.max(initial=0)) + 4 * _GAP
        self.keys = np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.span + self.positions

    def local(self, windows: np.ndarray, order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows that may have ``least`` terms here, and their terms as places."""
        rows = np.arange(len(windows))
        some = np.zeros(len(windows), bool)
        for k in range(windows.shape[1] - least + 1):  # one of so many of the rarest terms is here, or too few are
            some |= _find(self.terms, windows[rows, order[:, k]])[1]
        rows = np.flatnonzero(some)
        at, here = _find(self.terms, windows[rows])
        enough = here.sum(1) >= least
        return rows[enough], np.where(here, at, -1)[enough]

    def starts(self, terms: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries (term, offset): which query, and each position of its term less the offset."""
        counts = np.where(terms >= 0, self.ends[terms] - self.begins[terms], 0)
        query = np.repeat(np.arange(len(terms)), counts)
        inner = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
        return query, self.positions[np.repeat(self.begins[terms], counts) + inner] - np.repeat(offsets, counts)

    def holds(self, terms: np.ndarray, positions: np.ndarray, slop: int = 0) -> np.ndarray:
        """Does the term's list have a position within ``slop`` of the one asked for?"""
        asked = terms * self.span + positions
        at = np.minimum(np.searchsorted(self.keys, asked - slop), len(self.keys) - 1)
        return (terms >= 0) & (self.keys[at] >= asked - slop) & (self.keys[at] <= asked + slop)


def phrase(postings: Postings, windows: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact matches: (window, start), intersecting lists from the rarest term on."""
    rows = np.arange(len(windows))
    window, start = postings.starts(windows[rows, order[:, 0]], order[:, 0])
    for k in range(1, windows.shape[1]):
        if not len(window):
            break
        offset = order[window, k]
        keep = postings.holds(windows[window, offset], start + offset)
        window, start = window[keep], start[keep]
    return window, start


def proximity(postings: Postings, windows: np.ndarray, order: np.ndarray, terms: int = NEAR_TERMS, slop: int = SLOP) -> tuple[np.ndarray, np.ndarray]:
    """Windows of which at least ``terms`` terms stand within ``slop`` of their place, seen from one of the rarest terms."""
    rows, width = np.arange(len(windows)), windows.shape[1]
    found = []
    for k in range(width - terms + 1):  # a match misses at most width - terms terms, so one of these is there
        window, start = postings.starts(windows[rows, order[:, k]], order[:, k])
        matched = np.zeros(len(window), np.int64)
        for j in range(width):
            able = matched + (width - j) >= terms
            window, start, matched = window[able], start[able], matched[able]
            if len(window):
                offset = order[window, j]
                matched += postings.holds(windows[window, offset], start + offset, slop)
        found.append(np.stack([window, start])[:, matched >= terms])
    both = np.concatenate(found, axis=1)
    return both[0], both[1]


def _search(windows: Windows, order: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _search_segment(windows, order, row)

    return run


def _search_segment(windows: Windows, order: list[np.ndarray], row: dict) -> pa.RecordBatch:
    postings = Postings(row["terms"], row["ends"], row["positions"])
    lengths = np.array(row["lengths"], np.int64)
    begins = np.cumsum(lengths + _GAP) - lengths
    held: list[set[int]] = [set() for _ in lengths]
    near: list[set[int]] = [set() for _ in lengths]
    edges = np.zeros(int(begins[-1] + lengths[-1]) + _GAP + 1, np.int64)
    for (own, offsets, items), by in zip(windows.groups, order, strict=True):
        for search, into in ((phrase, held), (proximity, near)):
            if search is proximity and own.shape[1] < WINDOW or not len(postings.keys):
                continue
            number, terms = postings.local(own, by, own.shape[1] if into is held else NEAR_TERMS)
            if not len(number):
                continue
            window, start = search(postings, terms, by[number])
            window = number[window]
            if into is held:
                np.add.at(edges, start, 1)
                np.add.at(edges, start + own.shape[1], -1)
            # A proximity match can begin a little before its document: it belongs where its middle is.
            doc = np.searchsorted(begins, start + (own.shape[1] // 2 if into is near else 0), side="right") - 1
            for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                if d >= 0:
                    into[d].update(items[offsets[w] : offsets[w + 1]].tolist())
    covered = np.concatenate([[0], (np.cumsum(edges)[:-1] > 0).astype(np.int8), [0]])
    turn = np.diff(covered)
    up, down = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    doc = np.searchsorted(begins, up, side="right") - 1
    starts: list[list[int]] = [[] for _ in lengths]
    stops: list[list[int]] = [[] for _ in lengths]
    for d, a, b in zip(doc.tolist(), up.tolist(), down.tolist(), strict=True):
        starts[d].append(a - int(begins[d]))
        stops[d].append(b - int(begins[d]))
    name = lambda found: sorted((windows.names[i] for i in found), key=lambda x: (x is not None, x or ""))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["segment"]] * len(lengths), pa.int64()),
            pa.array(np.arange(len(lengths), dtype=np.int32)),
            pa.array(row["ids"], pa.int64()),
            pa.array(lengths),
            pa.array(starts, pa.list_(pa.int32())),
            pa.array(stops, pa.list_(pa.int32())),
            pa.array([name(x) for x in held], pa.list_(pa.string())),
            pa.array([name(y - x) for x, y in zip(held, near, strict=True)], pa.list_(pa.string())),
        ],
        ["segment", "place", "doc_id", "n_words", "starts", "stops", "items", "near_items"],
    )


def _search_block(index: DataFrame, items: list[tuple[str | None, str | None]]) -> DataFrame:
    windows = Windows(items)
    frequency = np.zeros(len(windows.terms), np.int64)
    if len(frequency):
        counted = index.select("terms", "ends").mapInArrow(_frequencies(windows.terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for row in counted.toLocalIterator():  # at most one row for each term of the block
            frequency[row["term"]] = row["n"]
    return index.mapInArrow(_search(windows, windows.order(frequency)), MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, hit ranges of words (starts, stops), items, near_items.

    ``near_items`` have a proximity match and no exact one.
    """
    common.extra(docs, ("doc_id", "text"))
    common.extra(benchmark, ("item_id", "text"))
    common.ship(docs.sparkSession)
    index = common.cut(docs.select("doc_id", "text").mapInArrow(_index, SEGMENT), "postings")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()  # a repeated item is one
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // (4 * block_words)))
    block = F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks))
    parts = []
    for k in range(blocks):
        rows = items.where(block == k).collect()  # one block of the stated queries, of bounded size
        parts.append(_search_block(index, [(r["item_id"], r["text"]) for r in rows]))
        if blocks > 1:
            parts[-1] = common.cut(parts[-1], "matches")
    return (parts[0] if blocks == 1 else _merged(parts)).drop("segment", "place")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The blocks' results as one row for each place in the index: ranges are joined where they touch, items united."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    span = "transform(starts, (s, i) -> struct(s as a, stops[i] as b))"
    grouped = union.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.expr(span))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near"),
    )
    joined = F.expr(
        "aggregate(array_sort(spans), cast(array() as array<struct<a:int,b:int>>), (done, s) -> "
        "if(size(done) = 0 or element_at(done, -1).b < s.a, concat(done, array(s)), "
        "concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).a as a, greatest(element_at(done, -1).b, s.b) as b)))))"
    )
    return grouped.withColumn("spans", joined).select(
        "segment", "place", "doc_id", "n_words", F.expr("transform(spans, s -> s.a)").alias("starts"), F.expr("transform(spans, s -> s.b)").alias("stops"),
        "items", F.sort_array(F.array_except("near", "items")).alias("near_items"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(zip_with(starts, stops, (a, b) -> b - a), 0L, (n, x) -> n + x)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP3_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)
), places as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows))
), matches as (
  select p.doc_id, w.item_id, p.i, p.n from places p join windows w using (n, s)
), hit as (
  select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from matches) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, item_id from matches) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(m.n_items, 0) as bigint) as n_items, sha256(coalesce(m.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h using (doc_id) left join named m using (doc_id)
"""
