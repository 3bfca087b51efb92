"""Every query with SQL says what its SQL says."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import registry

SF = "/root/testdata/sf0.001"


def _sorted(frame, columns):
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    wanted = con.sql(registry.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    assert _sorted(found, columns).equals(_sorted(wanted, columns))


def test_every_search_tier_is_hit(spark):
    tiers = {r["tier"] for r in registry.QUERIES["search_tiers"](spark, "/root/testdata/sf0.01").select("tier").distinct().collect()}
    assert tiers == {0, 1, 2, 3}


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_names_are_functions():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_data_package():
    root = Path(__file__).resolve().parents[1] / "skein"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "skein.llm" not in path.read_text(), path
