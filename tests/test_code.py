"""Extraction at depth, resolution, packed merges, ignore files and the archive cache."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.functions.facts import file_facts
from skein.operators import completion, host, intervals, merge, references, resolve, search
from skein.plans import modules, registry
from skein.sources import cache, code
from skein.streaming import documents, watch

SF = "/root/testdata/sf0.001"
COMPONENT = "(ns app (:require [integrant.core :as ig]))\n(def store 1)\n(defmethod ig/init-key ::store [_ c] c)\n(defrecord Item [a])\n(defn use-it [] [store (->Item 1) (map->Item {})])\n"


def packed_of(spark, rows):
    return code.extract(spark.createDataFrame(rows, "path string, text string, source_kind string"))


def test_deep_nesting_is_read(spark):
    deep = "(ns d)\n" + "(let [x " * 2000 + "1" + "] x)" * 2000
    rows = packed_of(spark, [("a.clj", deep, "project"), ("b.clj", "[" * 20000, "project"), ("c.clj", "#_" * 3000 + "x", "project"), ("d.clj", None, "project")]).collect()
    assert len(rows) == 4 and all(r["problem"] is None for r in rows)
    assert len(next(r for r in rows if r["path"] == "a.clj")["bindings"]) == 2000


def test_the_inner_binding_wins_whatever_the_order_of_the_text():
    facts = file_facts("a.clj", "(letfn [(f [g] (g 1)) (g [] 2)] (g))")
    inner = [b for b in facts.bindings if b["name"] == "g"]
    assert [b["name_range"] for b in inner] == [(0, 23, 0, 24), (0, 12, 0, 13)]  # the parameter comes last


def test_one_row_for_each_word_even_beside_a_component_key(spark):
    r = code.Relations(packed_of(spark, [("a.clj", COMPONENT, "project"), ("copy.clj", COMPONENT, "project")]))
    special = spark.createDataFrame([("if",)], "name string")
    words = spark.createDataFrame([(1, "store", "app"), (2, "->Item", "app"), (3, "map->Item", "app"), (4, "app/store", "x"), (5, "app/->Item", "x"), (6, None, "app"), (7, "", "app")], "qid int, word string, ns string")
    found = resolve.resolve(words, r.namespaces, r.symbols, r.core_names, special).collect()
    assert sorted((x["qid"], x["fqn"], x["origin"]) for x in found) == [(1, "app/store", "definition"), (2, "app/Item", "constructor"), (3, "app/Item", "constructor"), (4, "app/store", "definition"), (5, "app/Item", "constructor"), (6, None, None), (7, None, None)]


def test_core_names_come_from_the_core_files_or_a_table(spark):
    text = "(ns a)\n(frobnicate 1)\n(slurp 2)\n(own 3)\n(defn own [x] x)"
    packed = packed_of(spark, [("a.clj", text, "project"), ("core.clj", "(ns clojure.core)\n(defn slurp [f])", "jar")])
    names = lambda r: {x["fqn"] for x in r.occurrences.where("file = 'a.clj'").collect()}
    assert names(code.Relations(packed)) == {"a/frobnicate", "clojure.core/slurp", "a/own"}
    assert "clojure.core/frobnicate" in names(code.Relations(packed, spark.createDataFrame([("frobnicate",)], "name string")))


def test_an_alias_line_leads_to_the_namespace_even_under_a_core_name(spark):
    a = "(ns a (:require [b.text :as slurp]))\n(slurp/up 1)\n(slurp 2)"
    r = code.Relations(packed_of(spark, [("a.clj", a, "project"), ("b.clj", "(ns b.text)\n(defn up [x])", "project"), ("core.clj", "(ns clojure.core)\n(defn slurp [f])", "jar")]))
    line = a.split("\n")[0]
    cursors = spark.createDataFrame([(1, "a.clj", 0, 29, "slurp", False, line), (2, "a.clj", 2, 2, "slurp", False, "(slurp 2)"), (3, "a.clj", 1, 8, "slurp/up", False, "(slurp/up 1)")], "qid int, file string, line int, ch int, word string, is_keyword boolean, line_text string")
    found = references.definitions(cursors, r, r.core_names, spark.createDataFrame([("if",)], "name string")).collect()
    assert {(x["qid"], x["file"], x["via"]) for x in found} == {(1, "b.clj", "namespace"), (2, "core.clj", "definition"), (3, "b.clj", "definition")}


def test_the_corpus_is_extracted_once(spark):
    modules.relations(spark, SF)
    for name in modules.QUERIES:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan, name


def test_a_scan_replaces_and_a_removal_takes_all_relations(spark):
    old = packed_of(spark, [("a.clj", "(ns a)\n(def x 1)\n(def y 2)", "project"), ("open.clj", "(ns a)\n(def z 3)", "project"), ("gone.clj", "(ns g)\n(def q 1)", "project"), ("l.clj", "(ns l)\n(def m 1)", "jar")])
    fresh = packed_of(spark, [("a.clj", "(ns a)\n(def x 1)", "project")])
    kept = spark.createDataFrame([("open.clj",)], "file string")
    names = lambda p: {(s["file"], s["fqn"]) for s in code.Relations(p).symbols.collect()}
    after = merge.rescan_packed(old, fresh, kept)
    assert names(after) == {("a.clj", "a/x"), ("l.clj", "l/m")} and after.count() == 3
    assert names(merge.remove_packed(old, kept)) == {("a.clj", "a/x"), ("a.clj", "a/y"), ("gone.clj", "g/q"), ("l.clj", "l/m")}
    assert names(merge.clear_libraries(old)) == names(old) - {("l.clj", "l/m")}


def test_dialect_namespaces_go_by_both_names(spark):
    r = code.Relations(packed_of(spark, [("s.lg", "(ns string)\n(defn join [x])", "dir")]))
    assert {x["fqn"] for x in merge.dialect_copies(r.symbols).collect()} == {"string/join", "clojure.string/join"}


def test_ignore_files(spark, tmp_path):
    for name in ("src/a.clj", "src/gen/b.clj", "build/c.clj", "src/keep.tmp.clj", "src/x.tmp.clj", ".hidden/h.clj", "deep/build/d.clj", "only/e.clj", "src/only/f.clj"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("(ns x)")
    (tmp_path / ".gitignore").write_text("# made\nbuild/\n*.tmp.clj\n!keep.tmp.clj\n/only\n")
    (tmp_path / "src" / ".ignore").write_text("gen\n")
    own = {r["path"].removeprefix(f"{tmp_path}/") for r in code.read_files(spark, str(tmp_path), "*.clj").collect()}
    assert own == {"src/a.clj", "src/keep.tmp.clj", "src/only/f.clj"}
    assert code.read_files(spark, str(tmp_path), "*.clj", ignored=True).count() == 8


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = documents.FileTable(str(tmp_path / "t"))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "file string, x int")
    table.replace(one)
    held = lambda: {tuple(r) for r in table.read(one).collect()}
    parts = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = parts()
    for _ in range(2):
        table.replace(spark.createDataFrame([("a", 5)], one.schema))
        assert held() == {("a", 5), ("b", 2)}
    assert len(set(before) & set(parts())) == 1  # the partition of b was not written again
    table.replace(one.limit(0), spark.createDataFrame([("a",), ("none",)], "file string"))
    assert held() == {("b", 2)}


def test_a_new_stream_begins_on_an_old_table(spark, tmp_path):
    table = documents.FileTable(str(tmp_path / "t"))
    for k, text in enumerate(("old", "new")):
        source = tmp_path / f"in{k}"
        source.mkdir()
        for n in range(3):
            (source / f"{n}.json").write_text(json.dumps({"file": f"f{n}", "x": text}))
        query = table.sink(spark.readStream.schema("file string, x string").option("maxFilesPerTrigger", 1).json(str(source)), str(tmp_path / f"c{k}"))
        query.processAllAvailable()
        query.stop()
        assert {tuple(r) for r in table.read(spark.createDataFrame([], "file string, x string")).collect()} == {(f"f{n}", text) for n in range(3)}


def test_columns_that_clash(spark):
    rows = spark.createDataFrame([("a", 1, 9), ("a", 2, 8), (None, 3, 7), (None, 4, 6)], "k string, x int, _rank int")
    assert sorted((r["x"], r["_rank"]) for r in merge.first_of(rows, ["k"], [F.col("x")]).collect()) == [(1, 9), (3, 7)]
    assert sorted(r["x"] for r in merge.repeats(rows, ["k"], ["x"]).collect()) == [2, 4]
    with pytest.raises(ValueError, match="tier"):
        search.search(rows.withColumn("tier", F.lit(1)), rows.select(F.col("x").alias("qid"), F.col("k").alias("query")), "k", "k")


def test_empty_relations(spark):
    r = code.Relations(packed_of(spark, []))
    special = spark.createDataFrame([], "name string")
    assert r.symbols.count() == r.occurrences.count() == r.problems.count() == 0
    words = spark.createDataFrame([(1, "x", "a")], "qid int, word string, ns string")
    assert [x["fqn"] for x in resolve.resolve(words, r.namespaces, r.symbols, r.core_names, special).collect()] == [None]


def test_live_text_comes_before_indexed_rows(spark):
    packed = packed_of(spark, [("a.clj", "(ns a)\n(def old 1)", "project"), ("b.clj", "(ns b)\n(def kept 1)", "project")])
    live = packed_of(spark, [("a.clj", "(ns a)\n(def fresh 1)", "project")])
    outline = references.document_symbols(code.Relations(merge.with_live(packed, live)).symbols, spark.createDataFrame([("a.clj",), ("b.clj",)], "file string"))
    assert {r["name"] for r in outline.collect()} == {"fresh", "kept"}


def test_renames_start_in_project_files(spark):
    r = code.Relations(packed_of(spark, [("a.clj", "(ns a)\n(def x 1)\n(inc x)", "project"), ("l.clj", "(ns l)\n(def m 1)", "jar")]))
    asked = spark.createDataFrame([(1, "a/x", "y", "a.clj"), (2, "a/x", "y", "l.clj")], "qid int, fqn string, new_name string, origin string")
    edits, refused = references.rename(asked, r.symbols, r.occurrences, r.namespaces.where("source_kind = 'project'").select("file"))
    assert {(e["qid"], e["new_text"]) for e in edits.collect()} == {(1, "y")} and edits.count() == 2
    assert [(x["qid"], x["error"]) for x in refused.collect()] == [(2, "library file")]


def test_completion_offers_locals_statics_and_natives(spark):
    r = code.Relations(packed_of(spark, [("a.clj", "(ns a (:require [b :as Box]) (:import [java.util Map]))", "project"), ("b.clj", "(ns b)\n(def size 1)", "project")]))
    members = host.class_members(spark.createDataFrame([("z!/java/util/Map.java", "package java.util; public class Map { public static int of(int k) { return k; } }"), ("z!/java/util/Box.java", "package java.util; public class Box { public static int sum() { return 1; } }")], "path string, text string"))
    none = spark.createDataFrame([], "name string")
    asked = spark.createDataFrame([(1, "Map/o", "a"), (2, "Box/s", "a"), (3, "c", "a")], "qid int, prefix string, ns string")
    found = completion.complete(asked, r.namespaces, r.symbols, none, none, members=members, visible_locals=spark.createDataFrame([(3, "cell")], "qid int, name string"), natives=spark.createDataFrame([("count",)], "name string"))
    assert {tuple(x) for x in found.collect()} == {(1, "static", "Map/of"), (2, "alias member", "Box/size"), (3, "local", "cell"), (3, "native", "count")}


def test_a_folder_is_kept_current(spark, tmp_path):
    root, table = tmp_path / "p", documents.FileTable(str(tmp_path / "t"), "path")
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.clj").write_text("(ns a)\n(def x 1)")
    (root / "src" / "b.clj").write_text("(ns b)\n(def y 1)")
    (root / "deps.edn").write_text("{}")
    names = lambda: {s["fqn"] for s in code.Relations(watch.read(spark, table)).symbols.collect()}
    seen, routed = watch.refresh(spark, str(root), table)
    assert names() == {"a/x", "b/y"} and {r["action"] for r in routed.collect()} == {"extract", "libraries"}
    (root / "src" / "a.clj").write_text("(ns a)\n(def changed 1)")
    (root / "src" / "b.clj").unlink()
    seen, routed = watch.refresh(spark, str(root), table, seen)
    assert names() == {"a/changed"}
    assert {(r["path"].rpartition("/")[2], r["kind"], r["action"]) for r in routed.collect()} == {("a.clj", "changed", "extract"), ("b.clj", "deleted", "remove")}


def test_points_meet_the_spans_around_them(spark):
    spans = spark.createDataFrame([(k, "a", k * 7.0, k * 7.0 + (k % 5) * 40) for k in range(60)] + [(99, "a", None, 5.0)], "s int, key string, low double, high double")
    points = spark.createDataFrame([(k, "a" if k % 2 else "b", k * 3.5) for k in range(120)], "p int, key string, at double")
    met = intervals.meet(points, spans, ["key"], F.col("at"), F.col("low"), F.col("high"), 16.0).where("at between low and high")
    wanted = {(p, s) for p in range(1, 120, 2) for s in range(60) if s * 7.0 <= p * 3.5 <= s * 7.0 + (s % 5) * 40}
    assert sorted((r["p"], r["s"]) for r in met.collect()) == sorted(wanted)
