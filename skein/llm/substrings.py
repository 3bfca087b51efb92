"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is all text of documents with a smaller id, cut into blocks: each
50-word window is filed under its anchor, the least of its 16-word runs by
hash, so equal windows always meet under one anchor wherever they stand;
consecutive windows with one anchor form a block, which travels as one row with
a hash for each of its windows. Where an anchor meets, every window learns the
earliest document that holds it and its place there: its reference.

A document is then parsed greedily into factors and literals: from the first
word on, the factor that begins there and reaches farthest is taken, a factor
being a stretch whose windows have consecutive references in one document; a
word that begins none is a literal. The duplicate spans are the factors, and
what the check at each factor's end adds: windows across that end which have a
reference of their own. A window with a reference begins in a factor, so nothing
else need be looked at; without factors there are no spans. The spans hold
exactly the words of windows that an earlier document holds, and each factor
says where its words come from.

A reference is the earliest holder of a window, so a factor is the longest in
these references. A later document may hold a longer stretch in one piece; to
know it, every window would have to learn all its holders, which is the square
of a group of copies. The spans do not depend on it.

Windows repeated inside one batch of input are settled before the shuffle. An
anchor that is frequent in a sample of the documents (one in ``SAMPLED``, taken
by hash) is hot: its windows are filed one by one under their own hash, so a
passage with a million different endings meets in many tasks. The sample
decides that routing only; every window of every document is filed. No
document is compared with all others, and none is skipped.

Defined results: a null or empty text has no words; a row without id is neither
parsed nor a reference; equal ids are no smaller than each other, so copies
under one id all stay; windows are judged on the input alone. Hashes take the
place of words: 64 bits for an anchor, 56 more for a window under it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

WINDOW = 50
GRAM = 16
SPREAD = WINDOW - GRAM + 1  # runs of GRAM words in a window; a block has at most so many windows
BATCH_BYTES = 6_000_000
_PLACE_BITS = 28

HASH_BYTES = 7  # of a window's hash that travel
SAMPLED = 64  # one document in so many is looked at for hot anchors
HOT = 64  # blocks of the sample from which an anchor is hot
MOST_HOT = 50_000  # the list of hot anchors goes to every task, so it is bounded; the others travel as blocks

BLOCKS = "anchor long, doc_id long, text_key int, first int, shift int, hashes binary, count int, source long, source_first int"
RUNS = "doc_id long, text_key int, first int, count int, source long, source_first int"


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of the least one (the leftmost of equal ones)."""
    place = np.uint64((1 << _PLACE_BITS) - 1)
    low = (values & ~place) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    rest = width - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & place).astype(np.int64)


def _runs(row: np.ndarray, place: np.ndarray, source: np.ndarray, source_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each stretch of consecutive windows of a row with consecutive references."""
    if not len(row):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1) & (source[1:] == source[:-1]) & (source_place[1:] == source_place[:-1] + 1)
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    return begin, np.diff(np.append(begin, len(row)))


class Windows:
    """All windows of some documents (id, text key, text), in order of id: their hashes, anchors and places."""

    def __init__(self, docs: list[tuple[int, int, bytes | None]], hashes: common.WordHashes):
        docs = sorted((d for d in docs if d[2]), key=lambda d: d[0])
        words = [hashes.of(t.split()) for _, _, t in docs]
        docs = [d for d, w in zip(docs, words, strict=True) if len(w) >= WINDOW]
        words = [w for w in words if len(w) >= WINDOW]
        self.some = bool(docs)
        if not docs:
            return
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.concatenate(words)
        self.gram, window = common.window_hashes(flat, GRAM), common.window_hashes(flat, WINDOW)
        owner = np.repeat(np.arange(len(docs)), lengths)
        self.valid = np.flatnonzero(owner[: len(window)] == owner[WINDOW - 1 :])  # windows inside one document
        self.at = sliding_argmin(self.gram, SPREAD)[self.valid]
        self.window, self.owner = window[self.valid], owner[self.valid]
        self.place = self.valid - (np.cumsum(lengths) - lengths)[self.owner]
        self.ids, self.keys = np.array([d[0] for d in docs], np.int64), np.array([d[1] for d in docs], np.int32)
        # Consecutive windows of a document with one anchor are a block.
        self.head = np.concatenate([[True], (self.at[1:] != self.at[:-1]) | (self.owner[1:] != self.owner[:-1])])


def blocks_of(docs: list[tuple[int, int, bytes | None]], hashes: common.WordHashes, hot: np.ndarray) -> pa.RecordBatch | None:
    """Blocks of some documents, and references of the windows that these documents settle among themselves.

    ``hot`` holds the hot anchors in ascending order; their windows travel one by one.
    """
    w = Windows(docs, hashes)
    if not w.some:
        return None
    # Documents stand in order of id, so the first of equal windows has the smallest.
    order = np.argsort(w.window, kind="stable")
    new = np.concatenate([[True], w.window[order][1:] != w.window[order][:-1]])
    earliest = np.empty(len(w.window), np.int64)
    earliest[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    settled = w.ids[w.owner[earliest]] < w.ids[w.owner]

    anchor = w.gram[w.at]
    is_hot = np.zeros(len(anchor), bool)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
    head = w.head | is_hot
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(head)))
    block = np.cumsum(head) - 1
    open_ = np.flatnonzero(np.bincount(block, ~settled, len(begin)) > 0)  # blocks with an unsettled window travel
    lead = begin[open_]
    inside = np.repeat(lead - np.concatenate([[0], np.cumsum(size[open_])[:-1]]), size[open_]) + np.arange(int(size[open_].sum()))
    ends = np.concatenate([[0], np.cumsum(size[open_] * HASH_BYTES)]).astype(np.int32)
    short = w.window[inside].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    travelling = pa.Array.from_buffers(pa.binary(), len(open_), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(short).tobytes())])
    shift = w.valid - w.at
    with np.errstate(over="ignore"):
        alone = common.mix(anchor ^ w.window ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    key = np.where(is_hot, alone, anchor)[lead]

    known = np.flatnonzero(settled)
    source, source_place = w.ids[w.owner[earliest[known]]], w.place[earliest[known]]
    first, count = _runs(w.owner[known], w.place[known], source, source_place)
    home = known[first]
    with np.errstate(over="ignore"):
        spread = common.mix(w.owner[home].astype(np.uint64) * np.uint64(1_000_003) + w.place[home].astype(np.uint64))  # settled runs go anywhere
    both = np.concatenate([lead, home])
    blank = np.zeros(len(lead), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key, spread]).view(np.int64)),
            pa.array(w.ids[w.owner[both]]),
            pa.array(w.keys[w.owner[both]]),
            pa.array(w.place[both].astype(np.int32)),
            pa.array(np.concatenate([shift[lead], np.zeros(len(home), np.int64)]).astype(np.int32)),
            pa.concat_arrays([travelling, pa.nulls(len(home), pa.binary())]),
            pa.array(np.concatenate([blank, count]).astype(np.int32)),
            pa.array(np.concatenate([blank, source[first]])),
            pa.array(np.concatenate([blank, source_place[first]]).astype(np.int32)),
        ],
        ["anchor", "doc_id", "text_key", "first", "shift", "hashes", "count", "source", "source_first"],
    )


def _file(hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for whole in batches:
            for batch in common.chunks(whole, "text", BATCH_BYTES):
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.as_bytes(batch.column(2)), strict=True))
                out = blocks_of(rows, hashes, hot)
                if out is not None:
                    yield out
        common.tidy(hashes)

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = common.WordHashes()
    for whole in batches:
        for batch in common.chunks(whole, "text", BATCH_BYTES):
            w = Windows(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.as_bytes(batch.column(2)), strict=True)), hashes)
            if w.some:
                found, counts = np.unique(w.gram[w.at[w.head]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["anchor", "n"])
    common.tidy(hashes)


def hot_anchors(keyed: DataFrame, sampled: int = SAMPLED, least: int = HOT) -> np.ndarray:
    """Anchors of many blocks in a sample of the documents, in ascending order."""
    sample = keyed.where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(sampled)) == 0)
    counts = sample.mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["anchor"] for r in counts.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).select("anchor").collect()], np.int64).view(np.uint64))


def settle(table: pa.Table) -> pa.RecordBatch:
    """References of the windows that an earlier document holds; all rows of an anchor are here, ordered by id."""
    names = ["doc_id", "text_key", "first", "count", "source", "source_first"]
    anchor = table.column("anchor").to_numpy()
    passed = table.column("hashes").is_null().to_numpy()
    out = table.filter(pa.array(passed)).select(names)
    change = anchor[1:] != anchor[:-1]
    group = np.concatenate([[0], np.cumsum(change)]) if len(anchor) else np.empty(0, np.int64)
    shared = np.flatnonzero((np.bincount(group)[group] > 1) & ~passed) if len(anchor) else np.empty(0, np.int64)
    if len(shared):
        picked = table.take(pa.array(shared))
        raw = picked.column("hashes").to_pylist()
        size = np.fromiter((len(x) // HASH_BYTES for x in raw), np.int64, len(raw))
        wide = np.zeros((int(size.sum()), 8), np.uint8)
        wide[:, :HASH_BYTES] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, HASH_BYTES)
        flat = wide.reshape(-1).view(np.uint64)
        row = np.repeat(np.arange(len(raw)), size)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        ids = picked.column("doc_id").to_numpy()[row]
        place = picked.column("first").to_numpy()[row] + offset
        shift = picked.column("shift").to_numpy()[row] + offset
        # Equal windows share anchor, place against it and hash; rows stand in order of id.
        where = (group[shared][row].astype(np.uint64) << np.uint64(8)) | (shift + 128).astype(np.uint64)
        order = np.lexsort((np.arange(len(flat)), flat, where))
        new = np.append(True, (flat[order][1:] != flat[order][:-1]) | (where[order][1:] != where[order][:-1]))
        earliest = np.empty(len(flat), np.int64)
        earliest[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.flatnonzero(ids[earliest] < ids)
        source, source_place = ids[earliest[late]], place[earliest[late]]
        first, count = _runs(row[late], place[late], source, source_place)
        own = picked.take(pa.array(row[late[first]])).select(names[:2])
        for name, values in zip(names[2:], (place[late[first]].astype(np.int32), count.astype(np.int32), source[first], source_place[first].astype(np.int32)), strict=True):
            own = own.append_column(name, pa.array(values))
        out = pa.concat_tables([own, out])
    return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_pydict({n: pa.array([], out.schema.field(n).type) for n in names})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by anchor and id; an anchor that a batch cuts waits for its rest."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(anchor == anchor[-1])[0])
        if cut or (waiting and waiting[-1].column(0)[-1].as_py() != anchor[0]):
            yield settle(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield settle(pa.Table.from_batches(waiting))
    common.tidy()


def parse(n_words: int, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Greedy parse of a document: factors (start, stop, source document, start there); words between them are literals.

    ``runs`` are (first window, windows, source, first window there).
    """
    joined: list[list[int]] = []
    for first, count, source, there in sorted(runs, key=lambda r: (r[2], r[0] - r[3], r[0])):
        last = joined[-1] if joined else None
        if last and last[2] == source and last[0] - last[3] == first - there and first <= last[0] + last[1]:
            last[1] = max(last[1], first + count - last[0])
        else:
            joined.append([first, count, source, there])
    joined.sort()
    out, at, k, best = [], 0, 0, None
    while at < n_words:
        while k < len(joined) and joined[k][0] <= at:
            if best is None or joined[k][0] + joined[k][1] > best[0] + best[1]:
                best = joined[k]
            k += 1
        if best is not None and at < best[0] + best[1]:  # the window here has a reference: the farthest-reaching factor
            stop = best[0] + best[1] - 1 + WINDOW
            out.append((at, stop, best[2], best[3] + at - best[0]))
            at = stop
        elif k < len(joined):
            at = joined[k][0]
        else:
            break
    return out


def referenced(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Stretches (first, last) of windows that have a reference, apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((r[0], r[0] + r[1] - 1) for r in runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def duplicate_spans(factors: list[tuple[int, int, int, int]], runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Stretches of words that the factors cover, and those that the check at each factor's end adds.

    A window with a reference begins in a factor, as a word that begins one is no literal. So it lies in the factor, or
    across its end: only windows across ends are looked up, and no others.
    """
    known, spans, k = referenced(runs), [], 0
    for start, stop, _, _ in factors:
        found = stop
        low, high = max(start, stop - WINDOW + 1), stop - 1  # beginnings of windows across this end
        while k < len(known) and known[k][1] < low:
            k += 1
        at = k
        while at < len(known) and known[at][0] <= high:
            found = max(found, min(known[at][1], high) + WINDOW)
            at += 1
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], found)
        else:
            spans.append([start, found])
    return [(a, b) for a, b in spans]


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))
REWRITTEN = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, factors array<struct<start:int,stop:int,source:long,source_start:int>>, kept_text string"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.chunks(whole, "text"):
            counts, spans, every, kept = [], [], [], []
            for text, found in zip(common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                runs = [(f["first"], f["count"], f["source"], f["source_first"]) for f in found or ()]
                own = parse(len(words), runs)
                gone = duplicate_spans(own, runs)
                pieces, end = [], 0
                for a, b in gone:
                    pieces += words[end:a]
                    end = b
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                every.append([{"start": a, "stop": b, "source": c, "source_start": d} for a, b, c, d in own])
                kept.append(b" ".join(pieces + words[end:] if gone else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(every, _FACTORS), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "spans", "factors", "kept_text"],
            )
    common.tidy()


def dedupe_substrings(docs: DataFrame, sampled: int = SAMPLED, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, spans (removed words: start, stop), factors (with their sources), kept_text."""
    common.extra(docs, ("doc_id", "text"))
    common.ship(docs.sparkSession)
    keyed = docs.select("doc_id", F.hash("text").alias("text_key"), "text")
    named = keyed.where("doc_id is not null")
    filed = named.mapInArrow(_file(hot_anchors(named, sampled, hot)), BLOCKS)
    met = filed.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_meet, RUNS)
    found = met.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "count", "source", "source_first")).alias("found"))
    return keyed.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "found").mapInArrow(_rewrite, REWRITTEN)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    found = dedupe_substrings(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from docs)
), late as (
  select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as least_id from windows) where least_id < doc_id
), gone as (
  select distinct doc_id, x from (select doc_id, unnest(range(i, i + 50)) as x from late)
), words as (
  select doc_id, unnest(range(1, len(w) + 1)) as x, unnest(w) as word from docs
), kept as (
  select doc_id, string_agg(word, ' ' order by x) as t from words anti join gone using (doc_id, x) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from docs d left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id) left join kept k using (doc_id)
"""
