"""Quality rules learn from every labelled row."""

from __future__ import annotations

import numpy as np
import pytest

from skein.llm import quality

SF = "/root/testdata/sf0.01"


def test_every_labelled_row_counts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    whole = {r["doc_id"]: (r["anomaly"], r["kept"]) for r in quality.quality(docs, labels).collect()}
    assert {r["doc_id"]: (r["anomaly"], r["kept"]) for r in quality.quality(docs, labels, sample_rows=10).collect()} == whole


def test_counts_of_parts_fill_the_forest_like_the_whole(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (3000, len(quality.FEATURES)))
    table = spark.createDataFrame([(r.tolist(),) for r in rows], "features array<double>").repartition(5)
    one, two = quality.Forest(rows, rows.min(0), rows.max(0)), quality.filled(quality.Forest(None, rows.min(0), rows.max(0)), table)
    assert one.size == two.size == quality.LEAF_SAMPLE and np.array_equal(one.score(rows), two.score(rows))


@pytest.mark.parametrize("case", ["both", "no bad", "no good", "equal scores"])
def test_the_threshold_of_a_table_is_that_of_arrays(spark, case):
    rng = np.random.default_rng(6)
    scores = np.round(rng.random(400), 1 if case == "equal scores" else 9)
    good = rng.random(400) < {"both": 0.7, "no bad": 1, "no good": 0, "equal scores": 0.7}[case]
    scores[~good] += 0.2
    table = spark.createDataFrame([(int(g), float(s)) for g, s in zip(good, scores, strict=True)], "quality int, anomaly double")
    assert np.isclose(quality.calibrated(table), quality.calibrate(scores, good, ~good), rtol=0, atol=1e-12)
