"""Language identification with segmentation-marginalised unigrams.

A word's probability in a language is the sum, over all ways to cut it into
pieces of a fixed public vocabulary, of the product of the pieces'
probabilities in that language: a forward algorithm, scaled so that a word may
have any length. Texts are scored word by word over their whole length. The piece probabilities come from expected counts
(forward-backward over all segmentations) in all learning documents; only
tables of vocabulary x languages reach the driver.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text when nothing can be learned. A row without id is predicted,
never learned from, and not held out. Repeated rows are predicted and learned
from each; of languages with equal scores the first in code point order wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

UNDEFINED = "und"
SMOOTHING = 0.05
CACHE = 300_000
CELLS = 8_000_000  # numbers of one array of places, words and languages
RESCALE, SHORT = 4, 16  # places after which sums of words longer than SHORT are scaled again
#: The setting that names the vocabulary file, and where op6 looks without it.
PIECES_SETTING, PIECES = "spark.skein.pieces", "/opt/tokenizers/piece_bpe_32k.model"
_WORD = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces made of letters, in small letters; a leading mark begins a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if p.removeprefix(_MARK).isalpha() or p == _MARK})


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Vocabulary:
    """Pieces by hash of their characters; two tables, so that a lookup is two array reads at most."""

    BITS = 21

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        with np.errstate(over="ignore"):
            self.keys = np.array([self._hash(_codes(p)) for p in pieces], np.uint64)
        if len(set(self.keys.tolist())) < self.size:
            raise ValueError("two pieces share a hash")
        self.tables = []
        left = np.arange(self.size)
        while len(left):
            table = np.full(1 << self.BITS, -1, np.int32)
            place = self._place(self.keys[left], len(self.tables))
            table[place[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[place] != left]

    @staticmethod
    def _hash(codes: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        for c in codes:
            h = h * _BASE + c + np.uint64(1)
        return h

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0xD6E8FEB86659FD93 + 2 * 0x1234567 * k)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's piece, -1 if there is none."""
        out = np.full(len(keys), -1, np.int64)
        for k, table in enumerate(self.tables):
            at = table[self._place(keys, k)]
            hit = (at >= 0) & (self.keys[at] == keys)
            out[hit] = at[hit]
        return out


class Lattice:
    """All pieces that cover words of one length: (from, to, words, pieces), in order of ``to``."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(_MARK + w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(words), n)
        self.length, self.reach, self.words = n, vocabulary.longest, len(words)
        self.arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore"):
            prefix = np.zeros((n + 1, len(words)), np.uint64)
            for k in range(n):
                prefix[k + 1] = prefix[k] * _BASE + codes[:, k] + np.uint64(1)
            for to in range(1, n + 1):
                power = np.uint64(1)
                for size in range(1, min(self.reach, to) + 1):
                    power = power * _BASE
                    piece = vocabulary.find(prefix[to] - prefix[to - size] * power)
                    if size == 1:
                        piece = np.where(piece < 0, vocabulary.size, piece)  # any character stands for itself
                    on = np.flatnonzero(piece >= 0)
                    if len(on):
                        self.arcs.append((to - size, to, on, piece[on]))

    def sums(self, table: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Over all segmentations of what lies before each place (or behind it): the sum (places, words, languages), and the logarithm it is scaled by.

        Places that a piece still leads from are scaled together, so no word is too long for the arithmetic.
        """
        n = self.length
        total, scale = np.zeros((n + 1, self.words, table.shape[1])), np.zeros((n + 1, self.words, table.shape[1]))
        steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        for a, b, on, piece in self.arcs:
            steps[n - a if backward else b].append((n - b if backward else a, on, piece))
        total[0] = 1
        for k in range(1, n + 1):  # places from the side where the sums begin
            scale[k] = scale[k - 1]
            for source, on, piece in steps[k]:
                total[k][on] += total[source][on] * table[piece]
            if n > SHORT and k % RESCALE == 0:
                factor = total[k].copy()  # a single character is always a piece, so no place is out of reach
                live = slice(max(0, k - self.reach + 1), k + 1)
                total[live] /= factor
                scale[live] += np.log(factor)
        return (total[::-1], scale[::-1]) if backward else (total, scale)

    def log_forward(self, table: np.ndarray) -> np.ndarray:
        """Log-probability (words, languages)."""
        total, scale = self.sums(table)
        return np.log(total[self.length]) + scale[self.length]

    def posteriors(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, piece, expected uses) under one distribution."""
        (alpha, before), (beta, behind) = ((t[:, :, 0], s[:, :, 0]) for t, s in (self.sums(table), self.sums(table, True)))
        whole = np.log(alpha[self.length]) + before[self.length]
        uses = [alpha[a][on] * table[piece, 0] * beta[b][on] * np.exp((before[a] + behind[b] - whole)[on]) for a, b, on, piece in self.arcs]
        return np.concatenate([x[2] for x in self.arcs]), np.concatenate([x[3] for x in self.arcs]), np.concatenate(uses)


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _parts(words: list[str], languages: int) -> Iterator[list[int]]:
    """Places of words of one length, as many at once as ``CELLS`` allows."""
    for places in _by_length(words).values():
        step = max(1, CELLS // ((len(words[places[0]]) + 2) * languages))
        for k in range(0, len(places), step):
            yield places[k : k + step]


def letters(word: str) -> str:
    """The letters of a word alone."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _expect(vocabulary: Vocabulary, languages: list[str]):
    number = {lang: k for k, lang in enumerate(languages)}
    table = np.full((vocabulary.size + 1, 1), 1 / (vocabulary.size + 1))
    table[vocabulary.size] *= 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        total = np.zeros((len(languages), vocabulary.size + 1))

        def settle() -> None:
            words = list(counts)
            weight = np.array(list(counts.values()), float).reshape(len(words), len(languages))
            for part in _parts(words, 2):
                word, piece, uses = Lattice(vocabulary, [words[i] for i in part]).posteriors(table)
                own = weight[part]
                for lang in range(len(languages)):
                    total[lang] += np.bincount(piece, uses * own[word, lang], vocabulary.size + 1)
            counts.clear()

        zero = [0] * len(languages)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = number[lang]
                for word in _WORD.findall((text or "").lower()):
                    if word in counts:
                        counts[word][k] += 1
                    elif own := letters(word):
                        counts.setdefault(own, zero.copy())[k] += 1
                if len(counts) > CACHE:
                    settle()
        settle()
        lang, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[lang, piece])], ["lang", "piece", "uses"])
        common.tidy()

    return run


def _predict(vocabulary: Vocabulary, languages: list[str], table: np.ndarray, prior: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        room = np.empty((1 << 12, len(languages)))  # log-probabilities of known words; grows by doubling
        for whole in batches:
            for batch in common.chunks(whole, "text"):
                if len(known) > CACHE:
                    known.clear()
                texts = [_WORD.findall((t or "").lower()) for t in batch.column(1).to_pylist()]
                new = sorted({w for t in texts for w in t if w not in known})
                while len(known) + len(new) > len(room):
                    room = np.concatenate([room, np.empty_like(room)])
                room[len(known) : len(known) + len(new)] = word_logs(vocabulary, table, new)
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                names, scores = [], []
                for words in texts:
                    own = room[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                    if not own.any():  # a word with a letter never has probability one
                        names.append(UNDEFINED)
                        scores.append(0.0)
                        continue
                    z = own.sum(0) + prior
                    p = np.exp(z - z.max())
                    names.append(languages[int(z.argmax())])
                    scores.append(float(p.max() / p.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
        common.tidy(known)

    return run


def word_logs(vocabulary: Vocabulary, table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language (zero for one without letters)."""
    own = [letters(w) for w in words]
    out = np.zeros((len(words), table.shape[1]))
    for part in _parts(own, table.shape[1]):
        if own[part[0]]:
            out[part] = Lattice(vocabulary, [own[i] for i in part]).log_forward(table)
    return out


def identify(docs: DataFrame, learn: Column, pieces: str) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    ``learn`` says which rows' ``lang`` may be learned from, ``pieces`` is the vocabulary's file (read by the driver).
    """
    common.extra(docs, ("doc_id", "text", "lang"))
    common.ship(docs.sparkSession)
    lessons = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learn).select("text", "lang")
    sizes = {r["lang"]: r["count"] for r in lessons.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return docs.select("doc_id", F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    vocabulary = Vocabulary(letter_pieces(pieces))
    uses = np.zeros((len(languages), vocabulary.size + 1))
    for row in lessons.mapInArrow(_expect(vocabulary, languages), "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
        uses[row["lang"], row["piece"]] = row["uses"]
    table = ((uses + SMOOTHING) / (uses.sum(1, keepdims=True) + SMOOTHING * uses.shape[1])).T.copy()
    prior = np.log(np.array([sizes[k] for k in languages], float) / sum(sizes.values()))
    return docs.select("doc_id", "text").mapInArrow(_predict(vocabulary, languages, table, prior), "doc_id long, lang_pred string, score double")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    found = identify(common.table(spark, sf_dir, "documents"), remainder != 2, spark.conf.get(PIECES_SETTING, PIECES))
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
