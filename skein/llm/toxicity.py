"""Toxicity by weak supervision.

Sixteen voters (lexicons, patterns, and units induced from labelled rows) fire
or stay silent on each whole text, in one pass that is written. A generative
label model with one accuracy table per voter and a tree of pairwise
correlations is fitted by EM on the counts of vote patterns over *all*
documents; known labels take part as one more voter whose error rate is
estimated from how often the other voters contradict it. A linear classifier is
trained on the model's posterior labels of a bounded sample of all documents,
most of them without a label, and of labelled ones, and scores every text.

Bounds: the pattern table has at most 2**16 patterns x 3 label states; each
sample has at most ``SAMPLE`` rows. The induced lexicon holds every unit of the
labelled sample that passes the test of significance.

Defined results: a null or empty text has no words, fires only the "nothing
found" voter and gets a score; a row without id is scored, is not held out and
is never learned from; several labels of one id count as the largest; a null
label counts as none; without any labelled row the seed voters alone decide.
Repeated rows are scored each and alike, whatever their number, and one row of
a labelled id is learned from (the least text). A text of any length is scored
whole. Equal scores stay equal; a score at the threshold is predicted toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

SAMPLE = 20_000  # documents at most that the classifier is trained on, and labelled ones besides
VOTERS = 16
THRESHOLD = 0.7
SIGNIFICANT = 20.0
PREFIXES = (4, 5, 6, 7)

# Seed words of the lexicon voters, by kind; none is a common word of another of these languages.
SEEDS = {
    "intellect": "idiot idiots moron morons stupid dumb imbecile fool cretin dimwit halfwit brainless idiota estúpido tonto imbécil idiote stupide crétin débile abruti dumm trottel depp blödmann",
    "worth": "worthless loser losers pathetic useless failure nobody inútil perdedor patético minable nul raté wertlos versager erbärmlich",
    "filth": "scum trash filth garbage vermin disgusting pig sewage escoria basura asqueroso ordure racaille dégoûtant abschaum müll ekelhaft dreck",
    "ridicule": "clown freak creep weirdo coward joke buffoon payaso cobarde bouffon lâche witzfigur feigling",
    "profanity": "fuck fucking shit bullshit damn crap bitch bastard asshole mierda joder puta merde putain connard scheiße arschloch",
    "threat": "kill murder destroy strangle hurt matar muere tuer crever töten sterben",
    "hate": "hate despise loathe detest odio desprecio haine déteste hasse verachte",
}
_SEED_SETS = {k: frozenset(v.split()) for k, v in SEEDS.items()}
_SEED_ALL = frozenset().union(*_SEED_SETS.values())

_WORD = re.compile(r"[^\W\d_]+")
_CENSORED = re.compile(r"[^\W\d_][*]{2,}[^\W\d_]")
_ADDRESSED = re.compile(r"\b(?:you|your|u|they|he|she|tu|vous|du|ihr|sie|usted|eres)\b(?:\W+\w+){0,3}?\W+(" + "|".join(map(re.escape, sorted(_SEED_ALL))) + r")\b")

LOOKED = "doc_id long, pattern int, features array<int>"


def capitals(text: str, low: str) -> int:
    """Letters of the whole text that have another, small form."""
    if len(text) != len(low):  # some letter's small form is longer
        return sum(c != c.lower() for c in text)
    return int((np.frombuffer(text.encode("utf-32-le"), np.uint32) != np.frombuffer(low.encode("utf-32-le"), np.uint32)).sum())


def units(words: set[str]) -> set[str]:
    """Words of a text, the beginnings of its longer words (marked ``~``), and those that several of its words share (``~~``)."""
    stems = Counter(w[:k] for k in PREFIXES for w in words if len(w) > k)
    return words | {s + "~" for s in stems} | {s + "~~" for s, n in stems.items() if n > 1}


class Voters:
    """What fires on a text: a bit for each voter, and the features of the classifier."""

    def __init__(self, induced: list[str]):
        self.index = {u: i for i, u in enumerate(induced)}
        self.keys = frozenset(u for u in induced if u[-1] != "~")
        marked = [u for u in induced if u[-1] == "~"]
        self.stems = {k: frozenset(u.rstrip("~") for u in marked if len(u.rstrip("~")) == k) for k in PREFIXES}
        self.width = len(induced) + VOTERS + 1  # the last is the constant

    def look(self, text: str | None) -> tuple[int, list[int]]:
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        own = set(words)
        seeds = own & _SEED_ALL
        telling = self.keys & own  # the words that some induced unit tells of
        found = set(telling)
        for k, stems in self.stems.items():
            if stems:
                begun = [w for w in own if len(w) > k and w[:k] in stems]
                telling = telling.union(begun)
                for stem, n in Counter(w[:k] for w in begun).items():
                    found |= {u for u in (stem + "~", stem + "~~")[: 1 + (n > 1)] if u in self.index}
        bits = 0
        for k, name in enumerate(_SEED_SETS):
            bits |= bool(seeds & _SEED_SETS[name]) << k
        if seeds:
            hits = sum(w in seeds for w in words)
            bits |= bool(_ADDRESSED.search(low)) << 7
            bits |= (hits * 200 > len(words)) << 9
            bits |= (len(seeds) > 1) << 10
        bits |= bool(_CENSORED.search(low)) << 8
        bits |= (len(text) > 20 and capitals(text, low) * 2 > len(text)) << 11
        bits |= (len(telling) > 0) << 12
        bits |= (len(telling) > 1) << 13
        bits |= (len(telling) * 100 > len(own)) << 14
        bits |= (not seeds and not found) << 15
        base = len(self.index)
        features = [self.index[u] for u in found] + [base + k for k in range(VOTERS) if bits >> k & 1]
        return bits, features


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a unit, combined in bounded pieces."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts)), pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64())],
            ["unit", "n_toxic", "n_clean"],
        )
        counts.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for unit in units(set(_WORD.findall((text or "").lower()))):
                counts.setdefault(unit, [0, 0])[label] += 1
            if len(counts) > 300_000:
                yield flush()
    yield flush()


def induced_lexicon(sample: DataFrame) -> list[str]:
    """Units that labelled toxic texts hold far more often than clean ones."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    share = toxic / (toxic + clean)
    n = F.col("n_toxic") + F.col("n_clean")
    # Twice the log-likelihood ratio against "no matter which label": chance alone stays below it for some 1e5 units.
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    gain = 2 * (part("n_toxic", share) + part("n_clean", 1 - share))
    odds = F.log((F.col("n_toxic") + 0.5) / (toxic + 1)) - F.log((F.col("n_clean") + 0.5) / (clean + 1))
    rows = (
        sample.select("text", "label")
        .mapInArrow(_units_of, "unit string, n_toxic long, n_clean long")
        .groupBy("unit")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .where((odds > math.log(8)) & (gain >= SIGNIFICANT))
        .select("unit")
        .collect()
    )
    return sorted(r["unit"] for r in rows)


class LabelModel:
    """P(votes, label) as a class prior and, per class, a tree over the voters.

    Each voter has a table P(fires | its parent's vote, class): the accuracies,
    and along the tree's edges the correlations. Known labels enter as one
    more voter; its error rates on either class are how often the others' posterior contradicts it.
    """

    def __init__(self, patterns: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 25):
        self.votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
        self.labels, self.counts = labels, counts.astype(float)
        strong = self.votes[:, :8].sum(1) + self.votes[:, 12:15].sum(1)
        self.posterior = np.where(labels >= 0, np.where(labels == 1, 0.98, 0.02), np.where(strong >= 2, 0.8, np.where(strong == 1, 0.3, 0.02)))
        self.error = np.array([0.05, 0.05])  # of labels on clean and on toxic documents
        for _ in range(rounds):
            self._fit()
            self.posterior = self.predict(patterns, labels)

    def _fit(self) -> None:
        weight = np.stack([(1 - self.posterior) * self.counts, self.posterior * self.counts])
        total = weight.sum(1)
        self.prior = (total[1] + 1) / (total.sum() + 2)
        v = self.votes.astype(float)
        single = (weight @ v + 0.5) / (total[:, None] + 1)
        joint = np.stack([(v * w[:, None]).T @ v for w in weight])
        info = np.zeros((VOTERS, VOTERS))
        for c in range(2):
            n = total[c] + 1
            both = (joint[c] + 0.25) / n
            one, two = single[c][:, None], single[c][None, :]
            for p, q in ((both, one * two), (one - both, one * (1 - two)), (two - both, (1 - one) * two), (1 - one - two + both, (1 - one) * (1 - two))):
                p = np.clip(p, 1e-9, 1)
                info += total[c] / total.sum() * p * np.log(p / np.clip(q, 1e-9, 1))
        np.fill_diagonal(info, -1)
        self.parent = _tree(info)
        self.table = np.empty((2, VOTERS, 2))
        for c in range(2):
            for j, i in enumerate(self.parent):
                if i < 0:
                    self.table[c, j] = single[c, j]
                    continue
                fired = weight[c] @ v[:, i]
                self.table[c, j, 1] = (joint[c, i, j] + 0.5 * single[c, j]) / (fired + 0.5)
                self.table[c, j, 0] = (weight[c] @ v[:, j] - joint[c, i, j] + 0.5 * single[c, j]) / (total[c] - fired + 0.5)
        self.table = np.clip(self.table, 1e-6, 1 - 1e-6)
        known = self.labels >= 0
        if known.any():
            alone = self._posterior(self.votes[known], np.full(int(known.sum()), -1))
            of = np.stack([1 - alone, alone]) * self.counts[known]
            wrong = (of * (self.labels[known] != np.array([[0], [1]]))).sum(1)
            self.error = np.clip((wrong + 1) / (of.sum(1) + 20), 0.001, 0.45)

    def predict(self, patterns: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return self._posterior((patterns[:, None] >> np.arange(VOTERS)) & 1, labels)

    def _posterior(self, v: np.ndarray, labels: np.ndarray) -> np.ndarray:
        log = np.log(np.array([1 - self.prior, self.prior]))[:, None] + np.zeros((2, len(v)))
        for j, i in enumerate(self.parent):
            above = v[:, i] if i >= 0 else np.zeros(len(v), int)
            for c in range(2):
                p = self.table[c, j][above]
                log[c] += np.log(np.where(v[:, j] == 1, p, 1 - p))
        for c in range(2):
            log[c] += np.where(labels < 0, 0, np.where(labels == c, np.log(1 - self.error[c]), np.log(self.error[c])))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def _tree(info: np.ndarray) -> list[int]:
    """Parents of the maximum spanning tree of pairwise information, rooted at voter 0."""
    parent, best = [-1] * len(info), info[0].copy()
    source, inside = np.zeros(len(info), int), {0}
    while len(inside) < len(info):
        rest = [j for j in range(len(info)) if j not in inside]
        j = max(rest, key=lambda x: best[x])
        parent[j] = int(source[j])
        inside.add(j)
        better = info[j] > best
        best, source = np.where(better, info[j], best), np.where(better, j, source)
    return parent


def fit_linear(rows: list[list[int]], target: np.ndarray, width: int, l2: float = 0.03, steps: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps."""
    weights = np.zeros(width)
    if not rows:
        weights[-1] = -4.0
        return weights
    sizes = np.fromiter(map(len, rows), int, len(rows))
    row = np.repeat(np.arange(len(rows)), sizes + 1)
    col = np.fromiter((x for r in rows for x in (*r, width - 1)), int, int(sizes.sum()) + len(rows))
    ahead, last = weights.copy(), weights.copy()
    # A step for each weight: the curvature is at most a quarter of each feature's rows, each times its length.
    step = 1 / (l2 + 0.25 * np.bincount(col, (sizes + 1.0)[row], width))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[col], len(rows)), -40, 40)))
        slope = np.bincount(col, (p - target)[row], width) + l2 * np.where(np.arange(width) == width - 1, 0, ahead)
        last, weights = weights, ahead - step * slope
        ahead = weights + k / (k + 3) * (weights - last)
    return weights


def _look(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.chunks(whole, "text"):
                looked = [voters.look(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in looked], pa.int32()), pa.array([f for _, f in looked], pa.list_(pa.int32()))], ["doc_id", "pattern", "features"])
        common.tidy()

    return run


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            sizes = np.diff(found.offsets.to_numpy())
            z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[found.flatten().to_numpy()], len(sizes)) + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "pattern", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE) -> DataFrame:
    """Score of every document: doc_id, pattern (the votes that fired), score.

    ``learn`` says, as a condition on ``doc_id``, whose labels may be learned from.
    """
    common.extra(docs, ("doc_id", "text"))
    common.extra(labels, ("doc_id", "toxic"))
    common.ship(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = common.sampled(known, "doc_id", sample_rows, known.count())  # at most sample_rows small rows, so they are broadcast
    # One row of each labelled id is learned from, however often the id occurs.
    drawn = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("row"))
    sample = common.cut(drawn.select("row.text", "row.label"), "toxic-sample")
    voters = Voters(induced_lexicon(sample))
    common.drop(sample)

    looked = common.cut(texts.mapInArrow(_look(voters), LOOKED), "looked")
    joined = looked.join(known, "doc_id", "left").select("doc_id", "pattern", "features", F.coalesce("label", F.lit(-1)).alias("label"))
    table = joined.groupBy("pattern", "label").count().toPandas()
    if len(table):
        model = LabelModel(table["pattern"].to_numpy(), table["label"].to_numpy(), table["count"].to_numpy())
        every = common.sampled(joined, "doc_id", sample_rows, int(table["count"].sum()))
        marked = looked.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("pattern", "features", "label")).alias("row"))
        rows = every.unionByName(marked.select("doc_id", "row.*").select(every.columns)).toPandas()
        target = model.predict(rows["pattern"].to_numpy(dtype=int), rows["label"].to_numpy(dtype=int))
        weights = fit_linear([list(map(int, f)) for f in rows["features"]], target, voters.width)
    else:
        weights = fit_linear([], np.empty(0), voters.width)
    return looked.mapInArrow(_score(weights), "doc_id long, pattern int, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    scored = toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), remainder != 1)
    return scored.select(
        "doc_id",
        F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
