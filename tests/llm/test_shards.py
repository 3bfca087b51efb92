"""Counts of sources by shard: a multinomial draw whose totals are exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skein.llm import mixing

PLAN = "sid int, slots long, blocks long, part_slots long, last_take long"


def counts(spark, slots, shards):
    plan = spark.createDataFrame([(k + 1, n, 1000, 0, 0) for k, n in enumerate(slots)], PLAN)
    dealt = mixing._dealt(spark, plan).cache()
    per = dealt.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    for r in per.collect():
        assert r["n"] == r["d"] == slots[r["sid"] - 1] and (r["low"], r["high"]) == (0, r["n"] - 1)
    assert dealt.select("id").distinct().count() == sum(slots)
    found = np.zeros((shards, len(slots)))
    for r in dealt.groupBy("shard", "sid").count().collect():
        found[r["shard"], r["sid"] - 1] = r["count"]
    dealt.unpersist()
    return found


def test_shards_are_a_multinomial_draw(spark):
    shards = 500
    total = shards * mixing.SHARD
    slots = [total // 6, total // 3, total - total // 6 - total // 3]
    found = counts(spark, slots, shards)
    assert (found.sum(axis=1) == mixing.SHARD).all()
    for k, n in enumerate(slots):
        share = n / total
        chance = (mixing.SHARD * share * (1 - share)) ** 0.5
        assert abs(found[:, k].mean() - mixing.SHARD * share) < 1
        assert 0.9 * chance < found[:, k].std() < 1.1 * chance
        assert np.abs(found[:, k] - mixing.SHARD * share).max() < 4.5 * chance
        neighbours = np.corrcoef(found[:-1, k], found[1:, k])[0, 1]
        assert abs(neighbours) < 0.15


def test_small_and_uneven_totals(spark):
    for slots in ([1], [1, 1], [5000, 1, 0, 3], [7, 4090, 2]):
        counts(spark, [n for n in slots], -(-sum(slots) // mixing.SHARD))
