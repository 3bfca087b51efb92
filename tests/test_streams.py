"""Document streams, tables by file, archives and manifests on disk."""

from __future__ import annotations

import json
import zipfile

import pytest

from skein.sources import code, projects
from skein.streaming import documents as D


def _events(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


@pytest.fixture
def rocks(spark):
    spark.conf.set(*D.STORE)
    yield spark
    spark.conf.unset(D.STORE[0])


def _until(spark, query, table, rows):
    """Waits until the memory table has as many rows; timers fire in batches of their own."""
    for _ in range(150):
        query.awaitTermination(0.2)
        if spark.table(table).count() >= rows:
            break
    return [tuple(r) for r in spark.table(table).collect()]


def test_documents_follow_their_edits_and_settle(rocks, tmp_path):
    spark, source = rocks, tmp_path / "in"
    source.mkdir()
    edit = {"line": 0, "ch": 1, "to_line": 0, "to_ch": 1, "text": "!"}
    _events(source, "1.json", [{"uri": "a", "kind": "open", "version": 1, "text": "xy"}, {"uri": "a", "kind": "change", "version": 2, "edits": [edit]}, {"uri": "b", "kind": "open", "version": 1, "text": "q"}])
    opened = spark.createDataFrame([("c", 7, "kept")], "uri string, version int, text string")
    stream = spark.readStream.schema(D.EVENT).option("maxFilesPerTrigger", 1).json(str(source))
    made = D.documents(stream, 100, opened=opened).writeStream.queryName("docs").outputMode("append").trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / "state"))
    query = made.format("memory").start()
    rows = set(_until(spark, query, "docs", 4))
    assert rows == {("a", 2, "x!y", True, False), ("b", 1, "q", True, False), ("a", 2, "x!y", True, True), ("b", 1, "q", True, True)}
    _events(source, "2.json", [{"uri": "a", "kind": "change", "version": 1, "edits": [edit]}, {"uri": "b", "kind": "close", "version": 2}, {"uri": "c", "kind": "change", "version": 8, "edits": [edit]}])
    rows = set(_until(spark, query, "docs", 9)) - rows
    query.stop()
    assert rows == {("a", 2, "x!y", True, False), ("a", 2, "x!y", True, True), ("b", 2, None, False, False), ("c", 8, "k!ept", True, False), ("c", 8, "k!ept", True, True)} - {("a", 2, "x!y", True, False), ("a", 2, "x!y", True, True)}


def test_documents_go_on_after_a_restart(rocks, tmp_path):
    spark, source, out = rocks, tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    edit = lambda at, text: {"line": 0, "ch": at, "to_line": 0, "to_ch": at, "text": text}

    def run(name, n):
        stream = spark.readStream.schema(D.EVENT).json(str(source))
        made = D.documents(stream, 10**7).writeStream.trigger(processingTime="100 milliseconds")
        query = made.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        rows = set()
        for _ in range(100):  # a stream with timers never has all done
            query.awaitTermination(0.3)
            rows = {(r["uri"], r["version"], r["text"]) for r in spark.read.schema(D.DOCUMENT).parquet(out).collect()} if (tmp_path / "out" / "_spark_metadata").exists() else set()
            if len(rows) >= n:
                break
        query.stop()
        return rows

    _events(source, "1.json", [{"uri": "a", "kind": "open", "version": 1, "text": "one"}, {"uri": "a", "kind": "change", "version": 2, "edits": [edit(3, "!")]}])
    assert run("r1", 1) == {("a", 2, "one!")}
    _events(source, "2.json", [{"uri": "a", "kind": "change", "version": 3, "edits": [edit(4, "?"), edit(0, "<")]}])
    assert run("r2", 2) == {("a", 2, "one!"), ("a", 3, "<one!?")}


def test_debounced_keeps_the_last_version(rocks, tmp_path):
    spark, source = rocks, tmp_path / "in"
    source.mkdir()
    _events(source, "1.json", [{"uri": "a", "version": 1}, {"uri": "a", "version": 3}, {"uri": "b", "version": 5}])
    stream = spark.readStream.schema("uri string, version int").json(str(source))
    query = D.debounced(stream, 50).writeStream.format("memory").queryName("settled").outputMode("append").trigger(processingTime="200 milliseconds").start()
    rows = _until(spark, query, "settled", 2)
    query.stop()
    assert sorted(rows) == [("a", 3), ("b", 5)]


def test_another_state_store_is_an_error(spark, tmp_path):
    stream = spark.readStream.schema(D.EVENT).json(str(tmp_path))
    with pytest.raises(RuntimeError, match="RocksDB"):
        D.documents(stream)


def test_file_table_replaces_by_file(spark, tmp_path):
    table = D.FileTable(str(tmp_path / "t"))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "file string, x int")
    table.replace(one)
    table.replace(spark.createDataFrame([("a", 9)], one.schema), spark.createDataFrame([("b",)], "file string"))
    assert {tuple(r) for r in table.read(one).collect()} == {("a", 9)}


def test_files_and_archives_are_extracted(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.clj").write_text("(ns a) (def x 1)")
    (tmp_path / "bad.jar").write_text("no archive")
    with zipfile.ZipFile(tmp_path / "lib.jar", "w") as jar:
        jar.writestr("b/c.cljc", "(ns b.c) (defn- y [] 1)")
        jar.writestr("d.lg", "(ns d) (def z 1)")
    own = code.read_files(spark, str(tmp_path / "src"), "*.clj")
    libs = code.read_archives(spark, str(tmp_path))
    both = code.extract(own).unionByName(code.extract(libs))
    rows = {(r["fqn"], r["kind"], r["file"].rpartition("/")[2]) for r in code.Relations(both).symbols.collect()}
    assert rows == {("a/x", "Def", "a.clj"), ("b.c/y", "DefnPrivate", "c.cljc")}


def test_projects_on_disk(tmp_path):
    (tmp_path / "deps.edn").write_text('{:paths ["main" "none"]}')
    for name in ("main", "test", "main/deep"):
        (tmp_path / name).mkdir()
    assert projects.project_kind(tmp_path) == "deps" and projects.project_root(tmp_path / "main" / "deep") == tmp_path
    assert [p.name for p in projects.source_folders(tmp_path)] == ["main", "test"]
    (tmp_path / "1.cp").write_text("rel:/nowhere")
    assert projects.newest_classpath(tmp_path) is None
    (tmp_path / "2.cp").write_text(f"{tmp_path}/main:x\n")
    assert projects.newest_classpath(tmp_path) == f"{tmp_path}/main:x"


def test_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("a", 0, "b"), ("b", 0, "a"), ("b", 1, "c")], "parent string, ord int, lib string")
    assert {(r["lib"], r["depth"]) for r in projects.walk_dependencies(edges, "r").collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_walk_follows_long_chains(spark):
    edges = spark.createDataFrame([(str(k), 0, str(k + 1)) for k in range(70)], "parent string, ord int, lib string")
    assert {(r["lib"], r["depth"]) for r in projects.walk_dependencies(edges, "0").collect()} == {(str(k), k) for k in range(1, 71)}


def test_a_missing_checkout_ends_its_branch_and_hides_later_edges(spark):
    edges = [("r", 0, "a", "/a"), ("r", 1, "gone", "/gone1"), ("r", 2, "b", "/b"), ("a", 0, "gone", "/gone2"), ("gone", 0, "x", "/x"), ("b", 0, "c", "/c2"), ("a", 1, "c", "/c1"), ("c", 0, "r2", "/r2")]
    table = spark.createDataFrame(edges, "parent string, ord int, lib string, at string")
    there = spark.createDataFrame([("/a",), ("/b",), ("/gone2",), ("/x",), ("/c1",), ("/r2",)], "folder string")
    found = projects.walk_dependencies(table, "r", folder="at", present=there)
    # gone is met first where it is missing, so its other place is not tried; c is met first through a.
    assert sorted((r["lib"], r["depth"]) for r in found.collect()) == [("a", 1), ("b", 1), ("c", 2), ("r2", 3)]
    assert projects.walk_dependencies(table, "r", folder="at", present=there.limit(0)).collect() == []


def test_counts_are_observed_and_sketches_merge(spark):
    rows = lambda n, m: spark.createDataFrame([(f"{k}.clj", f"(ns n{k % m})\n(def x{k} 1)\n(def y{k} x{k})", "project") for k in range(n)], "path string, text string, source_kind string")
    sketches = []
    for at, (n, m) in enumerate(((300, 200), (300, 250))):
        packed, seen = code.counted(code.extract(rows(n, m)), f"scan{at}")
        packed.write.format("noop").mode("overwrite").save()
        got = seen.get
        assert (got["files"], got["symbols"], got["namespaces"], got["problems"]) == (n, 2 * n, n, 0)
        sketches.append(got["namespace_sketch"])
    assert abs(code.distinct_of(spark, sketches[:1]) - 200) <= 6 and abs(code.distinct_of(spark, sketches) - 250) <= 8
