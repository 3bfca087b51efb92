"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents, in a fixed order, form one stream of words, packed
into blocks of ``BLOCK`` words. The output is cut into shards of ``SHARD``
slots. Each slot draws its source by a hash, with the sources' shares of all
slots as probabilities, so the counts of a shard are a multinomial draw: they
deviate from their shares by some ``sqrt(SHARD * share * (1 - share))`` slots.
Over all shards a source is then a few slots off (the square root of all, at
most about): the slots that come last in the order of another hash, wherever they
stand, go over from sources that have too many to those that lack some, and each
source lands on its target to the word. A source's n-th slot takes block
``p(n mod blocks)`` of epoch ``n div blocks``, where ``p`` is the source's own
pseudorandom permutation of its block numbers (swap-or-not rounds). Blocks are
joined by number. The last slot of a source may take part of a block.

The plan has a row for each source and is made in one task: it serves some
millions of sources.

Targets: all words are shared by weights; a source stops at ``EPOCHS`` times
its size and the excess goes to the others by weight (water filling). So no
document is taken more than ``EPOCHS`` times.

Defined results: a null or empty text has size 0 and is never taken; null is a
source of its own, last in order; repeated rows are documents of their own; an
empty table gives an empty result. Reruns agree: every draw is a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import common

BLOCK = 64
SHARD = 4096
EPOCHS = 3
BINS = 4096
ROUNDS = 8
SEED = 1_234_567
#: Slots that one task makes, about.
SLOTS_A_TASK = 200_000
#: Rows of one window partition of a running sum, about: of documents, of slots.
RUN, SLOT_RUN = 1_000, 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], group: str, order: list[str], value: str) -> DataFrame:
    """Adds ``start``: the sum of ``value`` over the key's rows before this one, by (group, order).

    Two levels, so that one key's rows need not meet in one task.
    """
    totals = df.groupBy(*keys, group).agg(F.sum(value).alias("part"))
    before = F.sum("part").over(Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(*keys, group, F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.sum(value).over(Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(base, [*keys, group]).withColumn("start", F.col("base") + F.coalesce(inner, F.lit(0))).drop("base")


def permuted(x: Column, size: Column, sid: Column, inverse: bool = False) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 .. size - 1, one for each source."""
    rounds = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), sid, r), size) - at, size)
        swap = F.pmod(F.xxhash64(F.lit(SEED + 1), sid, r, F.greatest(at, partner)), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x, step)


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, target, and how many slots of which kind it gets."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    limit = EPOCHS * F.col("source_size")
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    filled = (
        ranked.withColumn("limit", limit)
        .withColumn("before", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("from_here", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("from_here"))
        .withColumn("full", F.col("limit") / F.col("weight") < F.col("level"))
        # The level at the first source that stays below its limit holds for all that do.
        .withColumn("shared", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(Window.partitionBy())["level"])
        .withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("shared")))
    )
    size, rest, blocks = F.col("source_size"), F.col("rest"), F.col("blocks")
    short = size - (blocks - 1) * BLOCK
    ceil_div = lambda a: F.floor((a + BLOCK - 1) / BLOCK)
    return (
        filled.withColumn("words", F.least(F.round("target").cast("long"), limit))
        .withColumn("blocks", ceil_div(size))
        .withColumn("epochs", F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("words") - F.col("epochs") * size)
        # Where the one short block stands in the permutation decides whether the last epoch needs one slot more.
        .withColumn("short_at", F.when(size > 0, permuted(blocks - 1, blocks, F.col("sid"), inverse=True)))
        .withColumn("early", F.coalesce(F.col("short_at") < ceil_div(rest), F.lit(False)))
        .withColumn("part_slots", F.when(F.col("early"), ceil_div(rest + BLOCK - short)).otherwise(ceil_div(rest)))
        .withColumn("slots", F.col("epochs") * blocks + F.col("part_slots"))
        .withColumn("last_take", rest - (F.col("part_slots") - 1) * BLOCK + F.when(F.col("short_at") < F.col("part_slots") - 1, BLOCK - short).otherwise(0))
        .select("source", "sid", "source_size", "target", "blocks", "slots", "last_take", "part_slots")
    )


def _binned(ranges: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Ranges (low, high) once for each bin of the axis that they touch, so that places meet them by an equi-join."""
    width = -(-total // BINS) or 1
    return ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))), width


def _dealt(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """(id, shard, sid, slot): every slot of the output with its source, and its number among that source's slots."""
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    up_to = lambda value: F.sum(value).over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    some = plan.where("slots > 0").select("sid", "slots")
    ranges, width = _binned(some.withColumn("high", up_to("slots")).withColumn("low", F.col("high") - F.col("slots")), total)
    parts = -(-total // SLOTS_A_TASK) or 1
    at = F.pmod(F.xxhash64(F.lit(SEED + 5), "id"), F.lit(max(total, 1)))
    slots = spark.range(0, total, 1, parts).select("id", F.floor(F.col("id") / SHARD).alias("shard"), at.alias("at"))
    drawn = slots.withColumn("bin", F.floor(F.col("at") / width)).join(ranges, "bin").where("at >= low and at < high")
    run = F.pmod(F.xxhash64(F.lit(SEED + 6), "id"), F.lit(max(1, -(-total // SLOT_RUN))))
    drawn = drawn.select("id", "shard", "sid", "slots", F.lit(1).alias("one"), run.alias("run"), F.xxhash64(F.lit(SEED + 7), "id").alias("turn"))
    numbered = common.cut(running(drawn, ["sid"], "run", ["turn", "id"], "one"), "drawn-slots")
    kept = numbered.where("start < slots").select("id", "shard", "sid", F.col("start").alias("slot"))

    # What a source has too many of goes to those that lack some.
    had = numbered.groupBy("sid").agg(F.count(F.lit(1)).alias("had"))
    lacking = some.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).withColumn("lack", F.col("slots") - F.col("had")).where("lack > 0")
    moved = lacking.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]
    gaps, gap_width = _binned(lacking.withColumn("high", up_to("lack")).withColumn("low", F.col("high") - F.col("lack")).select("sid", "had", "low", "high"), moved)
    over = numbered.where("start >= slots").select("id", "shard", "one", "run", "turn", F.lit(0).alias("all"))
    over = running(over, ["all"], "run", ["turn", "id"], "one").withColumn("bin", F.floor(F.col("start") / gap_width))
    filled = over.join(gaps, "bin").where("start >= low and start < high").select("id", "shard", "sid", (F.col("had") + F.col("start") - F.col("low")).alias("slot"))
    return kept.unionByName(filled)


def mix_slots(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """The mix itself: shard, sid, epoch, block, take (words of the block), one row per slot."""
    slots = _dealt(spark, plan).join(plan.select("sid", "slots", "blocks", "part_slots", "last_take"), "sid")
    is_last = (F.col("slot") == F.col("slots") - 1) & (F.col("part_slots") > 0)
    return slots.select(
        "shard", "sid", F.floor(F.col("slot") / F.col("blocks")).alias("epoch"),
        permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("sid")).alias("block"),
        F.when(is_last, F.col("last_take")).otherwise(BLOCK).cast("int").alias("take"),
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    common.extra(docs, ("doc_id", "text", "source"))
    spark = docs.sparkSession
    sized = common.cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    plan = common.cut(source_plan(sized), "source-plan")
    runs = max(1, -(-sized.count() // RUN))
    named = sized.join(plan.select("source", "sid", "source_size", "target"), sized["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "sid", "source_size", "target")
    full = named.where("size > 0").withColumn("run", F.pmod(F.xxhash64(F.lit(SEED + 3), "doc_id", "size"), F.lit(runs)))
    stream = running(full, ["sid"], "run", ["doc_id", "size"], "size")
    end = F.col("start") + F.col("size")
    blocks = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))))
    first = F.col("block") * BLOCK
    blocks = blocks.withColumn("a", F.greatest("start", first) - first).withColumn("b", F.least(end, first + BLOCK) - first)
    taken = mix_slots(spark, plan).groupBy("sid", "block").agg(F.count_if(F.col("take") == BLOCK).alias("whole"), F.max(F.when(F.col("take") < BLOCK, F.col("take"))).alias("part"))
    words = F.coalesce(F.col("whole") * (F.col("b") - F.col("a")), F.lit(0)) + F.greatest(F.lit(0), F.coalesce(F.least("b", "part") - F.col("a"), F.lit(0)) * F.when(F.col("part").isNotNull(), 1).otherwise(0))
    keys = ["sid", "start", "doc_id", "size", "source_size", "target"]
    counted = blocks.join(taken, ["sid", "block"], "left").groupBy(*keys).agg(F.sum(words).alias("taken"))
    out = counted.select("doc_id", "size", "source_size", "target", "taken")
    return out.unionByName(named.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mix_sources(common.table(spark, sf_dir, "documents"))
