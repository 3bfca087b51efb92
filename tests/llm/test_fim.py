"""Fill-in-the-middle: against its SQL, a plain version, and round trips of awkward texts."""

from __future__ import annotations

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from skein.llm import fim

SF = "/root/testdata/sf0.001"


def plain_version(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    one, two = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm_rate:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


AWKWARD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb"), (7, "a\r\nb\r\n"), (8, "has <P> inside\nx"), (9, "<M>"), (10, "<p>small</p>\n<S\n>"),
    (11, "ends with <\nS>starts\n<"), (12, "äöü \U0001f600\n\u2028x\u0085y\x0bz\n"), (13, "l\n" * 40_000), (14, "x" * 300_000), (15, "a\nb"), (None, "a\nb\nc"), (6, "a\nb"), (-3, "$1 \\1 \\E\n\\Q"),
    *((k, "<\n" * (k % 7) + "S>\nP>\nM>" * (k % 5)) for k in range(100, 160)),
]


def test_awkward_texts_equal_the_plain_version(spark):
    for seed, rate, spm in ((7, 100, 50), (11, 60, 20), (7, 0, 50)):
        table = spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"n": F.lit("clash"), "Form": F.lit(1), "units": F.lit(2), "row": F.lit(3), "p": F.lit(4)})
        done = fim.arrange(table, seed, rate, spm).withColumn("back", fim.restore(F.col("output"), F.col("form")))
        assert done.columns == ["doc_id", "units", "row", "p", "n", "form", "output", "prefix_chars", "middle_chars", "back"]
        found = sorted(((r["doc_id"], r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"], r["back"]) for r in done.collect()), key=repr)
        assert found == sorted(((i, *plain_version(i, t, seed, rate, spm), t or "") for i, t in AWKWARD), key=repr)
        assert done.where("row = 3 and p = 4 and units = 2").count() == len(AWKWARD)


def test_empty_table(spark):
    assert fim.arrange(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    wanted = con.sql(fim.OP12_SQL).df()
    found = fim.op12_fim(spark, SF).toPandas()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    assert found[columns].astype(str).sort_values(columns).values.tolist() == wanted[columns].astype(str).sort_values(columns).values.tolist()


def test_no_python_in_the_plan(spark):
    plan = fim.op12_fim(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
