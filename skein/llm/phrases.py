"""Collocations of two to four words by hash-pruned counting passes (PCY, DHP).

Pass k reads the texts once, counts phrases of k words exactly and, in the same
reading, counts the phrases of k+1 words into hash buckets. What pass k+1 may
count exactly is pruned three ways before it: the bucket must have reached the
threshold, and both phrases of k words inside must have reached it (Apriori).
Buckets and frequent phrases travel as bitmaps of ``2 ** BITS`` bits, 8 MB each
whatever the corpus holds: a bit that is set without cause costs a count that
the threshold removes later, a bit is never missing. Counts themselves are sums
per phrase, taken of integers that name words (not of hashes) inside a batch and
of the phrases' strings between batches.

Cuts and longer phrases are looked up by equi-joins among the frequent phrases:
every part of a frequent phrase is frequent. The best of each language are
ranked with a limit that each task applies before the shuffle.

Defined results: a null text is empty, a null language is ``und`` and counts
together with rows that say so; repeated rows count each; a text of any length
is read in segments that overlap by the words of a window; ties are ordered by
phrase in UTF-8 byte order. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

#: A candidate occurs so often at least, has so many words at most; so many of a language are reported.
LEAST, WIDEST, TOP = 30, 4, 2000
#: A longer phrase with so many percent of a candidate's occurrences stands for it.
COVERED = 80
#: Buckets of a level are 2 ** BITS; they travel in blocks of 2 ** BLOCK.
BITS, BLOCK = 26, 16
#: Bytes of text in one vectorised step, words that a worker remembers, tasks whose bucket counts meet first.
STEP_BYTES, WORDS, MERGED = 4_000_000, 400_000, 64

#: Small letters for A-Z; ends of pieces become full stops, a tab a blank.
_TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else common.LOWER[c] for c in range(256))
_END = b"."
RAW = "lang string, phrase string, n long, block int, part int, cells binary"


def _counter(least: int) -> type:
    """The smallest kind that holds counts up to ``least``, where they may stop."""
    return np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32


def _buckets(words: np.ndarray, width: int, lang: bytes) -> np.ndarray:
    """Of each window of ``width`` word hashes its bucket."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang, seed=width))
    with np.errstate(over="ignore"):
        return common.mix(common.window_hashes(words, width) ^ seed) >> np.uint64(64 - BITS)


class Words(dict):
    """Numbers of words, 0 for the end of a piece, and their hashes by number."""

    def __init__(self):
        super().__init__({_END: 0})
        self.hashes = [0]
        self.ready = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.ready) < len(self.hashes):
            self.ready = np.concatenate([self.ready, np.array(self.hashes[len(self.ready) :], np.uint64)])
        return numbers, self.ready[numbers]


def segments(texts: list[bytes], overlap: int, step: int = STEP_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """Words and ends of pieces of all texts, in lists of about ``step`` bytes; of each the words that an earlier one had."""
    data = b"\n".join(texts).translate(_TABLE).replace(b".", b" . ")
    at, carried = 0, []
    while at < len(data):
        stop = data.find(b" ", at + step)
        stop = len(data) if stop < 0 else stop
        words = carried + data[at:stop].split()
        yield words, len(carried)
        carried = words[len(words) - min(overlap, len(words)) :]
        at = stop


def _phrases(words: list[bytes], numbers: np.ndarray, at: np.ndarray, width: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct phrases at the given places and how often each occurs; exact, as numbers of words are."""
    key = numbers[at]
    if width > 1:
        pair = (numbers[:-1] << 32) | numbers[1:]
        if width == 2:
            key = pair[at]
        elif width % 2:
            key = (np.unique(pair[at], return_inverse=True)[1] << 32) | numbers[at + 2]
        else:
            rank = np.unique(np.concatenate([pair[at], pair[at + 2]]), return_inverse=True)[1]
            key = (rank[: len(at)] << 32) | rank[len(at) :]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return [b" ".join(words[p : p + width]) for p in at[first].tolist()], times


def _raw(lang: str | None, phrases: list[bytes], times: np.ndarray | list[int]) -> pa.RecordBatch:
    n = len(phrases)
    none = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.string()), pa.array(times, pa.int64()), none, none, pa.nulls(n, pa.binary())],
        ["lang", "phrase", "n", "block", "part", "cells"],
    )


def _packed(counts: np.ndarray, block: int) -> bytes:
    """Counts of a block that are not zero: places, then counts."""
    own = counts[block << BLOCK : (block + 1) << BLOCK]
    place = np.flatnonzero(own).astype(np.uint16)
    return place.tobytes() + own[place].tobytes()


def _unpacked(cells: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    n = len(cells) // (2 + np.dtype(kind).itemsize)
    return np.frombuffer(cells, np.uint16, n), np.frombuffer(cells, kind, n, 2 * n)


class Buckets:
    """Counts per bucket that stop at the threshold."""

    def __init__(self, least: int):
        self.least, self.counts = least, np.zeros(1 << BITS, _counter(least))

    def add(self, buckets: np.ndarray) -> None:
        if len(buckets):
            found, times = np.unique(buckets, return_counts=True)
            self.counts[found] = np.minimum(self.counts[found].astype(np.int64) + times, self.least)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        filled = [b for b in range(1 << (BITS - BLOCK)) if self.counts[b << BLOCK : (b + 1) << BLOCK].any()]
        for at in range(0, len(filled), 64):
            some = filled[at : at + 64]
            n = len(some)
            cells = [_packed(self.counts, b) for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(some, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(cells, pa.binary())],
                ["lang", "phrase", "n", "block", "part", "cells"],
            )


def _set(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Is the bit of each bucket set?"""
    return (bits[buckets >> np.uint64(3)] >> (np.uint8(7) - (buckets & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def _pass(width: int, least: int, known, ahead: bool, step: int = STEP_BYTES):
    """Count phrases of ``width`` words; ``known`` are the bitmaps of (width - 1)-word phrases and of buckets of this width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buckets = Words(), Buckets(least) if ahead else None
        frequent, filled = known.value if known is not None else (None, None)
        for whole in batches:
            for batch in common.chunks(whole, "text", step):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                    if text:
                        by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    for listed, old in segments(texts, width, step):
                        if len(words) > WORDS:
                            words = Words()
                        yield from _step(lang, listed, old, words, buckets, frequent, filled)
        if buckets is not None:
            yield from buckets.rows(TaskContext.get().partitionId() // MERGED)
        common.tidy(words)

    def _step(lang, listed, old, words, buckets, frequent, filled):
        numbers, hashes = words.read(listed)
        n = len(numbers) - width + 1
        if n <= 0:
            return
        name = lang.encode()
        ok = numbers[:n] != 0
        for k in range(1, width):
            ok &= numbers[k : k + n] != 0
        if frequent is not None:
            inner = _set(frequent, _buckets(hashes, width - 1, name))
            ok &= inner[:n] & inner[1:]
            ok &= _set(filled, _buckets(hashes, width, name))
        if buckets is not None and n > 1:
            wider = ok[:-1] & ok[1:]
            buckets.add(_buckets(hashes, width + 1, name)[wider])
        ok[: max(0, old - width + 1)] = False  # an earlier segment counted them
        at = np.flatnonzero(ok)
        if len(at):
            yield _raw(lang, *_phrases(listed, numbers, at, width))

    return run


def _marked(width: int, least: int):
    """Buckets of frequent phrases, as full counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buckets = common.WordHashes(), Buckets(least)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                by_lang.setdefault(lang, []).extend(phrase.split(b" "))
            for lang, flat in by_lang.items():
                buckets.counts[_buckets(words.of(flat), width, lang.encode())[::width]] = least
        yield from buckets.rows(TaskContext.get().partitionId() // MERGED)
        common.tidy(words)

    return run


def _merged(least: int, last: bool):
    """Sums of cells by (block, part); at last by block, as bits of those that reached ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _counter(least)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, cells in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                place, counts = _unpacked(cells, kind)
                own = sums.setdefault((block, 0 if last else part), np.zeros(1 << BLOCK, kind))
                own[place] = np.minimum(own[place].astype(np.int64) + counts, least)
        for (block, part), own in sums.items():
            cells = np.packbits(own >= least).tobytes() if last else _packed(own, 0)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([cells], pa.binary())], ["block", "part", "cells"])
        common.tidy()

    return run


def _bitmap(raw: DataFrame, least: int) -> np.ndarray:
    """One bit for each bucket, on the driver: ``2 ** BITS / 8`` bytes at any size of the corpus."""
    schema = "block int, part int, cells binary"
    cells = raw.where("block is not null").select("block", "part", "cells")
    first = cells.repartition("block", "part").mapInArrow(_merged(least, False), schema)
    done = first.repartition("block").mapInArrow(_merged(least, True), schema)
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    size = (1 << BLOCK) // 8
    for r in done.collect():
        bits[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, least: int = LEAST, widest: int = WIDEST, step: int = STEP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, a) of every phrase of up to ``widest`` (1 to 4) words that occurs ``least`` times, and (lang, n)."""
    common.extra(docs, ("text", "lang"))
    if not 1 <= widest <= 4:
        raise ValueError("phrases have one to four words")
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].alias("text"))
    tables, totals, known = [], None, None
    for width in range(1, widest + 1):
        raw = common.cut(texts.mapInArrow(_pass(width, least, known, width < widest, step), RAW), f"phrases{width}", "zstd")
        counted = raw.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if width == 1:
            totals = common.cut(raw.where("block is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        found = common.cut(counted.where(F.col("a") >= least).select("lang", "phrase", F.lit(width).alias("k"), "a"), f"frequent{width}")
        tables.append(found)
        if known is not None:
            known.unpersist()
        if width < widest:
            inner = found.select("lang", "phrase").mapInArrow(_marked(width, least), RAW)
            known = spark.sparkContext.broadcast((_bitmap(inner, least), _bitmap(raw, least)))
        common.drop(raw)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, totals


def collocations(docs: DataFrame, least: int = LEAST, widest: int = WIDEST, top: int = TOP, covered: int = COVERED, step: int = STEP_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of two words or more of each language."""
    known, totals = frequent_phrases(docs, least, widest, step)
    candidates = known.where("k > 1")
    # Of each cut two rows, one for either part: all parts are found by one join.
    cut = candidates.select("lang", "phrase", "k", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("at"))
    sides = F.array(
        F.struct(F.lit(False).alias("rest"), F.expr("substring_index(phrase, ' ', at)").alias("part")),
        F.struct(F.lit(True).alias("rest"), F.expr("substring_index(phrase, ' ', at - k)").alias("part")),
    )
    parts = cut.select("lang", "phrase", "at", F.explode(sides).alias("s")).select("lang", "phrase", "at", "s.rest", F.col("s.part").alias("part"))
    met = parts.join(known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    # What a longer candidate holds is a candidate too, so its rows meet the phrase's own.
    words = F.split("phrase", " ")
    inside = F.expr("flatten(transform(sequence(2, k - 1), w -> transform(sequence(1, k - w + 1), s -> array_join(slice(words, s, w), ' '))))")
    longer = candidates.where("k > 2").select("lang", "k", "a", words.alias("words")).select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer"))
    none = F.lit(None)
    rows = candidates.select("lang", "phrase", "a", none.cast("int").alias("at"), none.cast("boolean").alias("rest"), none.cast("long").alias("f"), none.cast("long").alias("longer"))
    rows = rows.unionByName(met.select("lang", "phrase", "at", "rest", "f"), allowMissingColumns=True).unionByName(longer, allowMissingColumns=True)
    side = [F.max(F.when((F.col("at") == k) & (F.col("rest") == rest), F.col("f"))).alias(f"{'r' if rest else 'l'}{k}") for k in range(1, widest) for rest in (False, True)]
    whole = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *side)
    # One decimal division, rounded down: the product may pass 64 bits.
    cuts = [F.expr(f"case when l{k} is not null then struct((cast(a as decimal(19, 0)) * 2000000) div (l{k} + r{k}) as score, {k} as at, l{k} as l, r{k} as r) end") for k in range(1, widest)]
    free = whole.where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    scored = free.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    ranked = scored.selectExpr("*", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank").where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best collocations of each language."""
    return collocations(common.table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), split as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), totals as (
  select lang, cast(sum(len(words)) as bigint) as n from split group by lang
), windows as (
  select lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda s: array_to_string(list_slice(words, s, s + k - 1), ' '))) as phrase
  from split, (select unnest(range(1, 5)) as k) where len(words) >= k
), frequent as (
  select lang, k, phrase, cast(count(*) as bigint) as a from windows group by all having count(*) >= 30
), cuts as (
  select c.lang, c.phrase, c.k, c.a, t.mark, array_to_string(list_slice(string_split(c.phrase, ' '), 1, t.mark), ' ') as one,
    array_to_string(list_slice(string_split(c.phrase, ' '), t.mark + 1, c.k), ' ') as two
  from frequent c, (select unnest(range(1, 4)) as mark) t where t.mark < c.k
), scored as (
  select c.lang, c.phrase, c.a, x.a as l, y.a as r, cast((cast(c.a as hugeint) * 2000000) // (x.a + y.a) as bigint) as score, c.mark
  from cuts c join frequent x on x.lang = c.lang and x.phrase = c.one join frequent y on y.lang = c.lang and y.phrase = c.two
), lowest as (
  select *, row_number() over (partition by lang, phrase order by score, mark) as place from scored
), inside as (
  select lang, a, unnest(list_transform(range(1, k - w + 2), lambda s: array_to_string(list_slice(string_split(phrase, ' '), s, s + w - 1), ' '))) as phrase
  from frequent, (select unnest(range(2, 4)) as w) where w < k
), longest as (
  select lang, phrase, max(a) as longer from inside group by all
), free as (
  select s.* from lowest s left join longest g on g.lang = s.lang and g.phrase = s.phrase where s.place = 1 and (g.longer is null or 100 * g.longer < 80 * s.a)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free
)
select r.lang, cast(r.rank as bigint) as rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join totals t on t.lang = r.lang where r.rank <= 2000
"""
