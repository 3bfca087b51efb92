"""Quality rules: an isolation forest over rule statistics.

Each whole text is reduced to rule statistics in one pass. A forest of random
splits is filled with every second row labelled good, all of them; a document's
score comes from the lengths of its paths. Where the forest of the literature
draws ``LEAF_SAMPLE`` rows for each tree, a node here has the rows that such a
draw is expected to put there: its exact share of all good rows. The threshold
is calibrated on all labelled rows that the trees did not see: it catches most of the rows labelled bad, and
a lost good row weighs ``WEIGHT`` times as much as a missed bad one. Two base
rules reject before the forest.

Split values are drawn over the range of each statistic in *all* documents
(narrowed on the way down), so a statistic that is constant in the good rows
can still isolate a document that differs there. That range leaves out the
outermost ``TAIL`` on either side: a few extreme documents, fewer than that
share, move no split. Only a statistic that is constant between these
quantiles takes its full range.

Defined results: a null or empty text has zero words and fails the base rule;
an id may repeat or be missing, each row gets its own verdict, and one row of a
labelled id is learned from; without labelled rows the trees are filled with all
rows and the threshold is ``FALLBACK``. A text of any length is measured whole;
a score at the threshold is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

TREES, LEAF_SAMPLE = 200, 256
DEPTH = 10
WEIGHT = 20.0
FALLBACK = 0.6
TAIL = 0.0005
SEED = 97
#: Steps of the score by which running sums are taken in two levels.
STEPS = 65_536

FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims", "digits", "bars", "variety", "line_words", "stutter")
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
_CAPITALS, _DIGITS = bytes(range(65, 91)), b"0123456789"

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STATS = BASE + ", features array<double>"


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def statistics(text: str | None, hashes: common.WordHashes) -> tuple[list[int], list[float]]:
    """The base counts of a text (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and its features."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - _count(raw, _SPACE)
    symbols = _count(raw, _SYMBOLS)
    lines, seen, dups = 0, set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip(_SPACE):
            seen.add(line)
        else:
            continue
        lines += 1
    repeats, own = 0, hashes.of(words)
    if n > 8:
        windows = common.window_hashes(own, 8)
        _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[where] > 1)
        if len(again):
            edges = np.zeros(n + 1, np.int32)
            np.add.at(edges, again, 1)
            np.add.at(edges, again + 8, -1)
            repeats = int((np.cumsum(edges)[:-1] > 0).sum())
    w, c = max(n, 1), max(chars, 1)
    features = [
        math.log1p(n), chars / w, symbols / c, dups / max(lines, 1), repeats / w, _count(raw, _CAPITALS) / c, raw.count(b"!") / w,
        _count(raw, _DIGITS) / c, raw.count(b"|") / w, math.log1p(len(set(words))) / math.log1p(w), math.log1p(n / max(lines, 1)),
        float((own[1:] == own[:-1]).sum()) / w if n > 1 else 0.0,
    ]
    return [n, chars, symbols, dups, repeats], features


class Forest:
    """Trees of random splits, as flat arrays. Splits depend on the ranges alone; ``settle`` ends paths by what all rows count."""

    def __init__(self, rows: np.ndarray | None, low: np.ndarray, high: np.ndarray, trees: int = TREES):
        rng = np.random.default_rng(SEED)
        nodes = 2 ** (DEPTH + 1) - 1
        self.feature = np.full((trees, nodes), -1, np.int8)
        self.split = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        usable = np.flatnonzero(high > low)
        below, above = (np.tile(np.asarray(x, float), (trees, 1, 1)) for x in (high, low))
        for depth in range(DEPTH if len(usable) else 0):
            width = 2**depth
            f = rng.choice(usable, (trees, width))
            least, most = (np.take_along_axis(x, f[..., None], 2)[..., 0] for x in (above, below))
            x = rng.uniform(least, most)
            level = slice(width - 1, 2 * width - 1)
            self.feature[:, level], self.split[:, level] = f, x
            below, above = below.repeat(2, 1), above.repeat(2, 1)
            np.put_along_axis(below[:, ::2], f[..., None], x[..., None], 2)
            np.put_along_axis(above[:, 1::2], f[..., None], x[..., None], 2)
        if rows is not None:
            self.settle(self.tally(rows))

    def _ends(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the node where each row's path ends."""
        each = np.arange(len(rows))
        for feature, split in zip(self.feature, self.split, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[each, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            yield node

    def tally(self, rows: np.ndarray) -> np.ndarray:
        """Rows at each node where paths end, by tree; those of parts of the rows add up."""
        return np.array([np.bincount(node, minlength=self.feature.shape[1]) for node in self._ends(rows)])

    def settle(self, counts: np.ndarray) -> None:
        """End each path where at most one of ``size`` rows is expected, from the rows at the ends of full paths."""
        held = counts.astype(float)
        for depth in reversed(range(DEPTH)):
            width = 2**depth
            held[:, width - 1 : 2 * width - 1] += held[:, 2 * width - 1 : 4 * width - 1].reshape(-1, width, 2).sum(2)
        total = int(held[0, 0])
        self.size = max(2, min(LEAF_SAMPLE, total))
        held *= min(1.0, self.size / max(total, 1))
        lengths = [_average_path(n) for n in range(LEAF_SAMPLE + 1)]
        depths = np.floor(np.log2(np.arange(held.shape[1]) + 1))
        self.feature[held <= 1] = -1
        self.path = np.where(self.feature < 0, depths + np.interp(held, np.arange(LEAF_SAMPLE + 1), lengths), 0.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 ** -(mean path / average path)."""
        total = np.zeros(len(rows))
        for path, node in zip(self.path, self._ends(rows), strict=True):
            total += path[node]
        return 2.0 ** (-total / len(self.path) / max(_average_path(self.size), 1e-9))


def _average_path(n: int) -> float:
    """Average path of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def calibrate(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold that catches most of the bad rows, a lost good row weighing ``WEIGHT`` times as much.

    The middle of the best interval is taken. Without bad rows the highest good score is the limit. The rule on arrays;
    ``calibrated`` is the same over a table of any size.
    """
    if not good.any():
        return FALLBACK
    own, other = np.sort(scores[good]), np.sort(scores[bad])
    if not len(other):
        return float(own[-1]) + 1e-9
    cuts = np.unique(scores)
    lost = 1 - np.searchsorted(own, cuts, side="right") / len(own)  # rows above the cut are rejected
    caught = 1 - np.searchsorted(other, cuts, side="right") / len(other)
    best = int(np.argmax(caught - WEIGHT * lost))
    return float(cuts[best] + (cuts[best + 1] if best + 1 < len(cuts) else cuts[best] + 1e-9)) / 2


def calibrated(scored: DataFrame) -> float:
    """``calibrate`` over rows (quality 0 or 1, anomaly): exact running sums, those of steps of the score before those inside a step."""
    marks = [F.count_if(F.col("quality") == k).alias(n) for k, n in ((1, "good"), (0, "bad"))]
    cuts = common.cut(scored.groupBy("anomaly").agg(*marks).withColumn("step", F.floor(F.col("anomaly") * STEPS)), "rule-cuts")
    all_rows = cuts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max(F.when(F.col("good") > 0, F.col("anomaly"))).alias("last")).first()
    if not all_rows["good"]:
        return FALLBACK
    if not all_rows["bad"]:
        return all_rows["last"] + 1e-9
    above = lambda window, c: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = cuts.groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    over = Window.orderBy(F.desc("step"))  # STEPS + 1 rows at most
    inside = Window.partitionBy("step").orderBy(F.desc("anomaly"))
    met = cuts.join(steps.select("step", above(over, "good").alias("over_good"), above(over, "bad").alias("over_bad")), "step")
    lost = (F.col("over_good") + above(inside, "good")) / all_rows["good"]  # rows above the cut are rejected
    caught = (F.col("over_bad") + above(inside, "bad")) / all_rows["bad"]
    best = met.select("anomaly", (caught - WEIGHT * lost).alias("worth")).agg(F.max_by("anomaly", F.struct("worth", -F.col("anomaly")))).first()[0]
    after = cuts.where(F.col("anomaly") > best).agg(F.min("anomaly")).first()[0]
    return (best + (best + 1e-9 if after is None else after)) / 2


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = common.WordHashes()
    for whole in batches:
        for batch in common.chunks(whole, "text"):
            found = [statistics(t, hashes) for t in batch.column(1).to_pylist()]
            counts = [pa.array([b[k] for b, _ in found], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([f for _, f in found], pa.list_(pa.float64()))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])
    common.tidy(hashes)


def _judge(forest: Forest, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(batch.schema.get_field_index("features")).to_pylist(), float).reshape(-1, len(FEATURES))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(forest.score(rows))], [*names, "anomaly"])

    return run


def _fill(forest: Forest):
    """Rows at the ends of the paths of each tree, counted by each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(forest.feature.shape, np.int64)
        for batch in batches:
            counts += forest.tally(np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES)))
        trees, nodes = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (trees, nodes, counts[trees, nodes])], ["tree", "node", "rows"])

    return run


def filled(forest: Forest, rows: DataFrame) -> Forest:
    """The forest settled by all ``rows`` (features); a tree's counts reach the driver as one row."""
    sums = rows.select("features").mapInArrow(_fill(forest), "tree long, node long, rows long").groupBy("tree", "node").agg(F.sum("rows").alias("rows"))
    counts = np.zeros(forest.feature.shape, np.int64)
    for tree, nodes, found in sums.groupBy("tree").agg(F.collect_list("node"), F.collect_list("rows")).collect():
        counts[tree, nodes] = found
    forest.settle(counts)
    return forest


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ranges(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest split value of each statistic, over all rows."""
    each = [F.get("features", F.lit(k)) for k in range(len(FEATURES))]
    found = stats.select(
        *[F.percentile_approx(x, [TAIL, 1 - TAIL], 20_000).alias(f"q{k}") for k, x in enumerate(each)],
        *[f(x).alias(f"{n}{k}") for k, x in enumerate(each) for n, f in (("low", F.min), ("high", F.max))],
    ).first()
    out = []
    for k in range(len(FEATURES)):
        low, high = found[f"q{k}"] or (0.0, 0.0)
        out.append((low, high) if low < high else (found[f"low{k}"] or 0.0, found[f"high{k}"] or 0.0))
    return np.array([x[0] for x in out]), np.array([x[1] for x in out])


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """One row per document: the base counts, anomaly (0 to 1), base_failed, kept.

    ``sample_rows`` is without effect: it bounded a sample once, now every labelled row counts.
    """
    common.extra(docs, ("doc_id", "text"))
    common.extra(labels, ("doc_id", "quality"))
    common.ship(docs.sparkSession)
    stats = common.cut(docs.select("doc_id", "text").mapInArrow(_measure, STATS), "rule-stats")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 1
    passed = stats.where(~base_failed())
    # One row of each labelled id, however often the id occurs.
    labelled = passed.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("row"))
    labelled = common.cut(labelled.select("row.features", "row.quality", unseen.alias("unseen")), "rule-labels")
    good = F.col("quality") == 1
    n = labelled.agg(F.count_if(good & F.col("unseen")).alias("held"), F.count_if(good & ~F.col("unseen")).alias("grown"), F.count(F.lit(1)).alias("rows")).first()
    parted = n["held"] > 0 and n["grown"] > 0  # else too few labels to part them
    if parted:
        grown = labelled.where(good & ~F.col("unseen"))
    elif n["held"] + n["grown"]:
        grown = labelled.where(good)
    else:
        grown = labelled if n["rows"] else passed
    forest = filled(Forest(None, *ranges(passed)), grown)
    # Trees grow on good rows alone, so bad ones are all unseen.
    held = labelled.where(~good | F.col("unseen")) if parted else labelled
    threshold = calibrated(held.select("features", "quality").mapInArrow(_judge(forest, ["quality"]), "quality int, anomaly double"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = stats.mapInArrow(_judge(forest, names), BASE + ", anomaly double")
    failed = base_failed()
    return judged.select(*names, "anomaly", failed.alias("base_failed"), (~failed & (F.col("anomaly") < threshold)).alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed and kept for every document."""
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("anomaly")
