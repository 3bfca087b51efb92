"""The parse decides what is removed; its factors and the check at their ends are enough."""

from __future__ import annotations

import random


from skein.llm import substrings
from tests.llm import brute


def covered(spans):
    return {x for a, b in spans for x in range(a, b)}


def random_runs(rng):
    runs, at = [], 0
    while at < 600:
        at += rng.choice([0, 0, 1, 3, 20, 49, 50, 51, 120])
        count = rng.choice([1, 1, 2, 10, 49, 50, 51, 90])
        source = rng.randrange(3)
        runs.append((at, count, source, rng.choice([at, rng.randrange(1000)])))
        at += count
    return runs


def test_factors_and_their_ends_cover_every_referenced_window():
    rng = random.Random(4)
    for _ in range(3000):
        runs = random_runs(rng)
        n = max(f + c for f, c, _, _ in runs) - 1 + substrings.WINDOW
        factors = substrings.parse(n, runs)
        assert all(a[1] <= b[0] for a, b in zip(factors, factors[1:], strict=False)) and all(b - a >= substrings.WINDOW for a, b, _, _ in factors)
        spans = substrings.duplicate_spans(factors, runs)
        assert covered(spans) == {x for f, c, _, _ in runs for x in range(f, f + c - 1 + substrings.WINDOW)}
        assert substrings.duplicate_spans([], runs) == []


def test_without_the_parse_nothing_is_removed(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(90)
    docs = [(k, " ".join(words(rng.randrange(40)) + passage[: 50 + k] + words(20))) for k in range(40)]
    found = {r["doc_id"]: r for r in substrings.dedupe_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    wanted = brute.removed_words(docs)
    assert all(len(covered((s["start"], s["stop"]) for s in found[i]["spans"])) == wanted[i][1] and found[i]["kept_text"] == wanted[i][2] for i, _ in docs)
    assert all(f["source"] < i and f["stop"] - f["start"] >= 50 for i, _ in docs for f in found[i]["factors"])
    text = {i: t.split() for i, t in docs}
    for i, _ in docs:
        for f in found[i]["factors"]:
            size = f["stop"] - f["start"]
            assert text[i][f["start"] : f["stop"]] == text[f["source"]][f["source_start"] : f["source_start"] + size]
    rows = [(0, 50, 1, 0), (70, 5, 2, 3)]
    assert covered(substrings.duplicate_spans(substrings.parse(200, rows), rows)) and not covered(substrings.duplicate_spans(substrings.parse(200, []), rows))
