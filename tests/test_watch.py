"""A watched folder as a stream: each change once, over restarts, and routed."""

from __future__ import annotations

import os

from skein.sources import code
from skein.streaming import watch
from skein.streaming.documents import FileTable


def write(path, text, time):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (time, time))


def run_once(made):
    query = made.trigger(availableNow=True).start()
    assert query.awaitTermination(100)


def test_each_change_arrives_once_over_restarts(spark, tmp_path):
    root, state, out = tmp_path / "p", str(tmp_path / "state"), str(tmp_path / "out")
    write(root / "src" / "a.clj", "(ns a)", 10)
    write(root / "src" / "b.clj", "(ns b)", 10)
    write(root / "src" / ".hidden.clj", "(ns h)", 10)

    def changes():
        stream = watch.folder_changes(spark, str(root), state)
        run_once(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")))
        return sorted((r["path"].rpartition("/")[2], r["kind"]) for r in spark.read.schema(watch.CHANGE).parquet(out).collect())

    first = [("a.clj", "created"), ("b.clj", "created")]
    assert changes() == first
    assert changes() == first  # nothing new
    write(root / "src" / "a.clj", "(ns a) (def x 1)", 20)
    (root / "src" / "b.clj").unlink()
    write(root / "c.clj", "(ns c)", 20)
    second = sorted([*first, ("a.clj", "changed"), ("b.clj", "deleted"), ("c.clj", "created")])
    assert changes() == second
    write(root / "src" / "b.clj", "(ns b)", 10)
    write(root / "src" / "a.clj", "(ns a)", 10)
    (root / "c.clj").unlink()  # the folder is as it was at first
    assert changes() == sorted([*second, ("b.clj", "created"), ("a.clj", "changed"), ("c.clj", "deleted")])


def test_changes_are_routed_and_applied(spark, tmp_path):
    root, table, libraries = tmp_path / "p", FileTable(str(tmp_path / "t"), "path"), []
    write(root / "src" / "a.clj", "(ns a)\n(def x 1)", 10)
    write(root / "src" / "b.clj", "(ns b)\n(def y 1)", 10)
    write(root / "deps.edn", "{}", 10)
    step = lambda: run_once(watch.watch(spark, str(root), table, str(tmp_path / "check"), lambda rows: libraries.extend(r["path"].rpartition("/")[2] for r in rows.collect())))
    names = lambda: {s["fqn"] for s in code.Relations(watch.read(spark, table)).symbols.collect()}
    step()
    assert names() == {"a/x", "b/y"} and libraries == ["deps.edn"]
    write(root / "src" / "a.clj", "(ns a)\n(def fresh 1)", 20)
    (root / "src" / "b.clj").unlink()
    step()
    assert names() == {"a/fresh"} and libraries == ["deps.edn"]
    write(root / "gen" / "g.clj", "(ns g)\n(def z 1)", 20)
    step()
    assert names() == {"a/fresh", "g/z"}
    write(root / ".gitignore", "gen/\n", 30)
    step()
    assert names() == {"a/fresh"}
    assert watch.apply_changes(spark, str(root), table, spark.createDataFrame([(str(root / "src" / "a.clj"), "changed")], "path string, kind string")).count() == 1
    assert names() == {"a/fresh"}


def test_a_large_difference_is_dealt_out(tmp_path, monkeypatch):
    for k in range(25):
        write(tmp_path / "p" / f"{k}.clj", "x", 10)
    monkeypatch.setattr(watch, "TASK_CHANGES", 10)
    reader = watch.FolderStream(str(tmp_path / "p"), str(tmp_path / "s"))
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for p in parts for b in reader.read(p) for r in b.column(0).to_pylist()]
    assert len(parts) == 3 and len(rows) == len(set(rows)) == 25
