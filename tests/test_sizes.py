"""Sides of joins whose size Spark cannot tell: rows made by generators or Python are many more than those they come from."""

from __future__ import annotations

import pytest

from skein.operators import search
from skein.plans import registry
from skein.plans.session import cut


@pytest.mark.parametrize("name", ["code_host_completions", "code_host_words", "code_host_signatures"])
def test_derived_tables_are_never_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_names_are_never_broadcast_for_a_search(spark, monkeypatch):
    """Also where the queries are too many to be broadcast; what is found stays."""
    rows = spark.range(300).selectExpr("concat('Name ', id, ' of ', id % 7) as name", "lpad(id, 4, '0') as key")
    asked = spark.range(40).selectExpr("id as qid", "substring(concat('Name ', id, ' of ', id % 7), 1 + id % 5, 2 + id % 4) as query")
    wanted = sorted(map(tuple, search.search(rows, asked, "name", "key", 5).collect()))
    monkeypatch.setattr(search, "FEW", 0)
    written = []
    monkeypatch.setattr(search, "cut", lambda df, label: written.append(df) or cut(df, label))
    found = search.search(rows, asked, "name", "key", 5)
    assert sorted(map(tuple, found.collect())) == wanted
    assert not any("Broadcast" in x._jdf.queryExecution().executedPlan().toString() for x in [*written, found.where("tier < 3")])
