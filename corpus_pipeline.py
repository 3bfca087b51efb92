"""The corpus pipeline: five stages over documents, each written and reread by the next.

Stages 1 to 4 return the columns of documents. A filtering stage drops by id:
rows that share an id (a missing one too) stay or go together. The last stage
returns the mix: one row per remaining document with its size and the words
taken of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common
from skein.llm.decontaminate import decontaminate
from skein.llm.mixing import mix_sources
from skein.llm.neardup import near_duplicates
from skein.llm.quality import quality
from skein.llm.secrets import MASK, mask_secrets

NEAR_PERCENT = 80  # similarity from which the stage takes documents for near-duplicates; op2_neardup has its own


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is rejected."""
    gone = rejected.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or look anomalous go."""
    return _without(docs, quality(docs, common.table(spark, sf_dir, "labels")).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    return _without(docs, near_duplicates(docs, NEAR_PERCENT).where("not kept"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _without(docs, decontaminate(docs, common.table(spark, sf_dir, "benchmark")).where("size(starts) > 0"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place; the count of characters follows."""
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = dict(docs.dtypes)["n_chars"]
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(MASK)), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document so that the sources meet their targets."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("source mixing", mix),
]

#: The forest, the masks and the hashed draws are not expressible in SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1], 1):
        docs = common.cut(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
