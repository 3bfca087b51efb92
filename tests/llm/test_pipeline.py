"""The pipeline against plain versions of its stages, on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
from skein.llm import common
from skein.llm.neardup import near_duplicates
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    bench = [(str(r["item_id"]), r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = common.cut(stage(spark, docs, SF), "test")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert all(brute.text_statistics(r["text"])[0] >= 20 for r in after.values()) and len(after) > 0.7 * len(before)
        elif k == 1:
            classes = brute.near_classes([(i, r["text"]) for i, r in before.items()], corpus_pipeline.NEAR_PERCENT)
            assert set(after) == set(classes.values())
        elif k == 2:
            assert set(after) == {i for i, _, hit, _ in brute.item_hits([(i, r["text"]) for i, r in before.items()], bench) if not hit}
        elif k == 3:
            assert set(after) == set(before)
            for i, r in after.items():
                assert brute.base_secrets(r["text"]) == "" and r["n_chars"] == len(r["text"])
                if not brute.base_secrets(before[i]["text"]):
                    assert r["text"] == before[i]["text"]
        else:
            sizes = {}
            for r in before.values():
                sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.SPACE.findall(r["text"]))
            wanted = brute.targets(sizes)
            taken = {}
            for i, r in after.items():
                taken[before[i]["source"]] = taken.get(before[i]["source"], 0) + r["taken"]
            assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)


def test_near_duplicates_of_four_fifths_go(spark):
    """Pairs between 0.80 and 0.85 are one class in the stage, and only there."""
    rng = random.Random(11)
    rows = []
    for k in range(0, 400, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        # 100 windows; two changed words far apart change 10 of them: 90 / 110 = 0.818.
        other = [f"x{k}" if i in (30, 60) else w for i, w in enumerate(words)]
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute.near_classes(rows, 80)
    assert set(wanted.values()) == set(range(0, 400, 2))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == set(wanted.values())
    assert all(r["kept"] for r in near_duplicates(docs, 85).collect())


def test_run_equals_its_stages(spark):
    one = corpus_pipeline.run(spark, SF)
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, SF), "test")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, docs.collect()))
