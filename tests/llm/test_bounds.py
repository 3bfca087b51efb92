"""What reaches the driver stays bounded when one id or item repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as Classic

from skein.llm import decontaminate, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture
def brought(monkeypatch):
    """Rows that each call brings to the driver."""
    seen = []
    monkeypatch.setattr(Classic, "toPandas", lambda f, p=Classic.toPandas: (lambda r: seen.append(len(r)) or r)(p(f)))
    monkeypatch.setattr(Classic, "collect", lambda f, c=Classic.collect: (lambda r: seen.append(len(r)) or r)(c(f)))
    return seen


def test_one_labelled_id_on_very_many_rows(spark, brought):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    row = labels.where("quality = 1 and toxic is not null").join(docs, "doc_id").orderBy(F.length("text")).where(F.length("text") > 200).select("doc_id", "text").first()
    many = spark.range(100_000).select(F.lit(row["doc_id"]).alias("doc_id"), F.lit(row["text"][:200] + " and so on with some more words to pass the base rules of the least number of words here").alias("text"))
    table = docs.unionByName(many)
    brought.clear()
    kept = quality.quality(table, labels, sample_rows=1000)
    assert max(brought) <= 2000
    assert kept.count() == 100_000 + docs.count()
    brought.clear()
    scored = toxicity.toxicity(table, labels, F.lit(True), sample_rows=1000)
    assert max(brought) <= 2000
    assert scored.where(F.col("doc_id") == row["doc_id"]).select("score").distinct().count() <= 2


def test_an_item_that_repeats_is_one(spark, brought):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "none of it")], "doc_id long, text string")
    items = spark.range(50_000).select(F.lit("x").alias("item_id"), F.lit("b c d e f g h i j k").alias("text"))
    brought.clear()
    found = {r["doc_id"]: r["items"] for r in decontaminate.decontaminate(docs, items).collect()}
    assert found[1] == ["x"] and found[2] == [] and max(brought) <= 10
