"""The learned operators against plain versions of their arithmetic."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from skein.llm import langid, mixing, secrets, toxicity


def test_posteriors_equal_a_plain_product():
    rng = np.random.default_rng(5)
    votes = rng.integers(0, 1 << toxicity.VOTERS, 300)
    labels = rng.integers(-1, 2, 300)
    model = toxicity.LabelModel(votes, labels, rng.integers(1, 9, 300), rounds=4)
    found = model.predict(votes, labels)
    for pattern, label, got in zip(votes[:80].tolist(), labels[:80].tolist(), found, strict=False):
        joint = []
        for c in (0, 1):
            p = model.prior if c else 1 - model.prior
            for j, parent in enumerate(model.parent):
                fires = model.table[c, j, pattern >> parent & 1 if parent >= 0 else 0]
                p *= fires if pattern >> j & 1 else 1 - fires
            if label >= 0:
                p *= 1 - model.error[c] if label == c else model.error[c]
            joint.append(p)
        assert math.isclose(got, joint[1] / sum(joint), rel_tol=1e-6, abs_tol=1e-12)


def test_trees_carry_the_most_information():
    """Against every spanning tree of a small graph."""
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = 5
        info = rng.random((n, n))
        info = (info + info.T) / 2
        np.fill_diagonal(info, -1)
        best = 0.0
        for edges in itertools.combinations(itertools.combinations(range(n), 2), n - 1):
            root = list(range(n))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            joined = 0
            for a, b in edges:
                x, y = find(a), find(b)
                joined += x != y
                root[x] = y
            if joined == n - 1:
                best = max(best, sum(info[a, b] for a, b in edges))
        parents = toxicity._tree(info)
        assert math.isclose(sum(info[p, j] for j, p in enumerate(parents) if p >= 0), best)


def test_weights_are_where_the_slope_is_zero():
    rng = random.Random(7)
    rows = [sorted(rng.sample(range(12), rng.randint(0, 5))) for _ in range(400)]
    target = np.array([min(1.0, 0.1 + 0.4 * (3 in r) + 0.4 * (7 in r)) for r in rows])
    weights = toxicity.fit_linear(rows, target, 13, l2=0.5, steps=4000)
    slope = np.zeros(13)
    for r, t in zip(rows, target, strict=True):
        p = 1 / (1 + math.exp(-(sum(weights[k] for k in r) + weights[12])))
        for k in (*r, 12):
            slope[k] += p - t
    slope[:12] += 0.5 * weights[:12]
    assert np.abs(slope).max() < 0.02


def test_scores_equal_a_plain_sum(spark):
    texts = ["you idiot", "a fine day", "", None, "SCUM AND TRASH " * 3, "b***d word"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    look = toxicity.Voters([]).look
    assert all(r["pattern"] == look(texts[r["doc_id"]])[0] for r in found)
    by_pattern = {}
    for r in found:
        assert math.isclose(by_pattern.setdefault(r["pattern"], r["score"]), r["score"])
    assert by_pattern[look(texts[0])[0]] > by_pattern[look(texts[1])[0]]


def cuts(word):
    """All ways to cut a word."""
    for mask in range(1 << (len(word) - 1)):
        at = [0, *(k + 1 for k in range(len(word) - 1) if mask >> k & 1), len(word)]
        yield [word[a:b] for a, b in itertools.pairwise(at)]


def test_languages_equal_an_enumeration_of_all_cuts(spark):
    pieces = {p: k for k, p in enumerate(langid.letter_pieces(langid.PIECES))}
    size = len(pieces)
    texts = {"en": ["the cat sat", "the dog ran far"], "de": ["der hund lief", "die katze lag weit"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    asked = [(100, "the katze", None), (101, "hund", None), (102, "far zz", None)]
    spelt = lambda parts: [pieces.get(p, size if len(p) == 1 else None) for p in parts]
    uniform = np.full(size + 1, 1 / (size + 1))
    uniform[size] *= 1e-3
    uses = {lang: np.zeros(size + 1) for lang in texts}
    for _, text, lang in rows:
        for word in text.split():
            ways = [w for parts in cuts("▁" + word) if None not in (w := spelt(parts))]
            chance = [math.prod(uniform[x] for x in w) for w in ways]
            for w, p in zip(ways, chance, strict=True):
                for x in w:
                    uses[lang][x] += p / sum(chance)
    names = sorted(texts)
    table = {n: (uses[n] + langid.SMOOTHING) / (uses[n].sum() + langid.SMOOTHING * (size + 1)) for n in names}
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in langid.identify(docs, F.lit(True), langid.PIECES).collect()}
    for k, text, _ in rows + asked:
        logs = []
        for n in names:
            logs.append(math.log(0.5) + sum(math.log(sum(math.prod(table[n][x] for x in w) for parts in cuts("▁" + word) if None not in (w := spelt(parts)))) for word in text.split()))
        share = math.exp(max(logs)) / sum(map(math.exp, logs))
        assert found[k]["lang_pred"] == names[int(np.argmax(logs))] and math.isclose(found[k]["score"], share, rel_tol=1e-6)


def test_longest_stretches_equal_a_try_of_every_end():
    grammar = secrets.Grammar(("gitlab", "github"))
    rng = random.Random(3)
    alphabet = secrets._ALNUM + "+/_.=-"
    fresh = lambda kind: secrets.FORMATS[kind][0][0] + "".join(rng.choices(secrets.FORMATS[kind][1], k=secrets.FORMATS[kind][2][0]))
    for _ in range(60):
        run = "".join(rng.choices(alphabet, k=rng.randint(0, 12))) + fresh(rng.choice(["gitlab", "github"])) + "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        for kind, automaton in grammar.automata.items():
            ahead = {}
            for start in range(0, len(run) - secrets.SHORTEST, 3):
                wanted = None
                for end in range(start + secrets.SHORTEST, len(run) + 1):
                    token = run[start:end]
                    least = min(automaton.likelihood(token) - sum(p[c] + secrets.MARGIN for c in token) for p in grammar.plain)
                    if least >= 0 and token[-1] not in ".=":
                        wanted = end, least
                found = automaton.longest(run, start, grammar.plain, ahead)
                assert (found is None) == (wanted is None), (kind, run, start)
                assert found is None or found[0] == wanted[0] and math.isclose(found[1], wanted[1], abs_tol=1e-9)


def test_words_taken_equal_a_walk_through_the_slots(spark):
    rng = random.Random(4)
    rows = [(k if k % 9 else None, " ".join("w" * rng.randint(0, 150)), rng.choice(["a", "b", "c", None])) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.source_plan(sized)
    slots = [(r["sid"], r["block"], r["take"]) for r in mixing.mix_slots(spark, plan).collect()]
    sids = {r["source"]: r["sid"] for r in plan.collect()}
    # One run at this size: a source's words stand in order of id (missing ones first) and size.
    words = {}
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["source"]) for r in sized.collect()), key=lambda r: (*r[:3], str(r[3])))
    for n, (known, doc, size, source) in enumerate(order):
        words.setdefault(sids[source], []).extend([n] * size)
    taken = [0] * len(order)
    for sid, block, take in slots:
        for n in words[sid][block * mixing.BLOCK : block * mixing.BLOCK + take]:
            taken[n] += 1
    wanted = sorted((str(d if known else None), size, t) for (known, d, size, _), t in zip(order, taken, strict=True))
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix_sources(docs).collect()) == wanted
