"""Ignore rules, archives as a data source, the cache by partition."""

from __future__ import annotations

import random
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.operators import merge
from skein.sources import archives, cache, code, ignore


def files_of(spark, root, names):
    return spark.createDataFrame([(f"{root}/{n}",) for n in names], "path string")


def rules_of(spark, texts):
    rows = [r for folder, source, text in texts for r in ignore.parse_ignore(folder, text, source)]
    return spark.createDataFrame(rows, ignore.RULES)


def left(spark, names, texts, root="/r"):
    found = ignore.kept(files_of(spark, root, names), rules_of(spark, texts), root)
    return sorted(r["path"].removeprefix(f"{root}/") for r in found.collect())


def test_what_lies_in_an_excluded_folder_stays_out(spark):
    assert left(spark, ["build/x.clj", "build/deep/y.clj", "a.clj", "src/build/z.clj"], [("", 0, "build/\n!build/x.clj\n!build/deep/\n")]) == ["a.clj"]
    assert left(spark, ["build/x.clj", "build/y.clj"], [("", 0, "build/*\n!build/x.clj\n")]) == ["build/x.clj"]
    assert left(spark, ["build", "lib/build/x"], [("", 0, "build/\n")]) == ["build"]  # a file is no folder


def test_later_and_deeper_rules_win(spark):
    names = ["a.log", "keep.log", "s/a.log", "s/keep.log", "s/t/a.log", "s/b.txt"]
    texts = [("", 0, "*.log\n!keep.log"), ("s", 0, "!a.log\n/b.txt"), ("s/t", 1, "a.*"), ("s/t", 0, "!a.log")]
    assert left(spark, names, texts) == ["keep.log", "s/a.log", "s/keep.log"]


def test_ten_thousand_rules_equal_git(spark, tmp_path):
    rng = random.Random(3)
    stems, kinds, folders = [f"n{k}" for k in range(60)], ["clj", "edn", "tmp.clj", "log"], ["src", "lib", "gen", "out", "deep"]
    names = {"/".join([*rng.choices(folders, k=rng.randint(0, 3)), f"{rng.choice(stems)}.{rng.choice(kinds)}"]) for _ in range(400)}
    for name in names:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")

    def rule():
        body = rng.choice([f"{rng.choice(stems)}.{rng.choice(kinds)}", f"*{rng.randrange(10)}.log", f"/{rng.choice(folders)}/{rng.choice(stems)}.clj", f"n?{rng.randrange(10)}.edn", f"**/{rng.choice(folders)}/{rng.choice(stems)}.*", f"{rng.choice(folders)}/{rng.choice(folders)}/", f"[!n]*.clj"])
        return ("!" if rng.random() < 0.4 else "") + body

    rules = [f"none{k}/x{k}.clj" if k % 2 else f"nothing{k}" for k in range(10_000)] + [rule() for _ in range(200)]
    (tmp_path / ".gitignore").write_text("\n".join(rules))
    (tmp_path / "src").mkdir(exist_ok=True)
    (tmp_path / "src" / ".gitignore").write_text("\n".join(rule() for _ in range(30)))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    wanted = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.excludesFile=/dev/null", "ls-files", "--others", "--exclude-standard"], check=True, capture_output=True, text=True).stdout.split()
    found = {r["path"].removeprefix(f"{tmp_path}/") for r in code.read_files(spark, str(tmp_path)).collect()}
    assert found == {n for n in wanted if not n.rpartition("/")[2].startswith(".")}
    assert 0 < len(found) < len(names)


def jar(path, entries, damage=None):
    data = bytearray(archives.archive_bytes(entries))
    if damage is not None:
        data[damage] ^= 0xFF
    path.write_bytes(bytes(data))


def test_every_kind_of_damage_is_a_row(spark, tmp_path, monkeypatch):
    text = "(ns a)\n" + "(def x 1)\n" * 500
    jar(tmp_path / "good.jar", {"a/b.clj": text, "a/other.txt": "no source", "a/c.cljc": text})
    jar(tmp_path / "deflated.jar", {"bad.clj": text, "fine.clj": text}, damage=60)
    summed = bytearray(archives.archive_bytes({"crc.clj": text}))
    summed[summed.index(b"PK\x01\x02") + 16] ^= 0xFF  # the directory's checksum
    (tmp_path / "crc.jar").write_bytes(bytes(summed))
    (tmp_path / "none.jar").write_text("no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    whole = archives.archive_bytes({"cut.clj": text})
    (tmp_path / "cut.jar").write_bytes(whole[: len(whole) // 2])
    with zipfile.ZipFile(tmp_path / "odd.jar", "w") as out:
        out.writestr("latin.clj", b"(def \xe9 1)")
    method = bytearray(archives.archive_bytes({"m.clj": text}))
    method[8] = method[method.index(b"PK\x01\x02") + 10] = 99  # a compression that nobody knows
    (tmp_path / "method.jar").write_bytes(bytes(method))
    rows = {r["path"].rpartition("/")[2] if "!/" in r["path"] else r["path"].rpartition("/")[2]: r for r in code.read_archives(spark, str(tmp_path)).collect()}
    bad = {"bad.clj", "crc.clj", "none.jar", "empty.zip", "cut.jar", "m.clj"}
    assert {n for n, r in rows.items() if r["problem"]} == bad and all(rows[n]["text"] is None for n in bad)
    assert {n for n, r in rows.items() if r["text"] is not None} == {"b.clj", "c.cljc", "fine.clj", "latin.clj"}
    assert rows["b.clj"]["text"] == text and rows["latin.clj"]["text"] == "(def � 1)"
    listed = cache.archives(spark, str(tmp_path))
    assert {tuple(r) for r in code.read_archives(spark, str(tmp_path), only=listed).collect()} == {tuple(r) for n, r in rows.items() if n != "empty.zip"}  # Spark lists no empty file


def test_one_entry_is_read_for_one_lookup(spark, tmp_path):
    text = "(def x 1)\n" * 400
    # The other entries are damaged, so reading them would show.
    data = bytearray(archives.archive_bytes({"one.clj": text, "two.clj": text, "three.clj": text}))
    first = data.index(b"one.clj") + len(b"one.clj")
    data[first + 5] ^= 0xFF
    (tmp_path / "a.jar").write_bytes(bytes(data))
    jar(tmp_path / "b.jar", {"two.clj": "(def b 2)"})
    assert [r["text"] for r in archives.entry_text(spark, f"{tmp_path}/a.jar!/two.clj").collect()] == [text]
    assert archives.entry_text(spark, f"{tmp_path}/a.jar!/none.clj").collect() == []
    assert [bool(r["problem"]) for r in archives.entry_text(spark, f"{tmp_path}/a.jar!/one.clj").collect()] == [True]
    reader = archives.PushedReader(str(tmp_path), "", None)
    wanted = archives.EqualTo(("path",), f"{tmp_path}/b.jar!/two.clj")
    assert list(reader.pushFilters([wanted])) == [wanted]
    (part,) = reader.partitions()
    assert [p for p, _ in part.archives] == [f"{tmp_path}/b.jar"] and reader.entry == "two.clj"
    with pytest.MonkeyPatch.context() as patch:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        found = archives.read_entries(spark, str(tmp_path), "").where(F.col("path") == f"{tmp_path}/b.jar!/two.clj")
        assert [r["text"] for r in found.collect()] == ["(def b 2)"]
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        patch.setattr(archives, "TASK_BYTES", 10)
        patch.setattr(archives, "TASK_ENTRIES", 2)
        parts = archives.EntryReader(str(tmp_path / "a.jar"), "", None).partitions()
        assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 4)]


def test_a_changed_archive_writes_its_partition_alone(spark, tmp_path):
    libs, kept = tmp_path / "libs", tmp_path / "cache"
    libs.mkdir()
    for k in range(40):
        jar(libs / f"l{k}.jar", {f"n{k}.clj": f"(ns n{k}) (def x{k} 1)"})
    (libs / "bad.jar").write_text("no archive")
    jar(libs / "plain.jar", {"readme.txt": "none"})
    names = lambda p: {s["fqn"] for s in code.Relations(p).symbols.collect()}
    written = lambda: {p: p.stat().st_mtime_ns for p in kept.rglob("*.parquet")}
    assert names(cache.packed_archives(spark, str(libs), str(kept))) == {f"n{k}/x{k}" for k in range(40)}
    before = written()
    assert len(before) == 42 and cache.stale_archives(spark, str(libs), str(kept)).count() == 0
    cache.packed_archives(spark, str(libs), str(kept)).count()
    assert written() == before
    jar(libs / "l7.jar", {"n7.clj": "(ns n7) (def fresh 1)", "more.clj": "(ns more) (def m 1)"})
    import os

    os.utime(libs / "l7.jar", (10**9, 10**9))
    (libs / "l8.jar").unlink()
    assert names(cache.packed_archives(spark, str(libs), str(kept))) == {f"n{k}/x{k}" for k in range(40) if k not in (7, 8)} | {"n7/fresh", "more/m"}
    after = written()
    assert len(set(after) - set(before)) == 1 and len(set(before) - set(after)) == 1
    assert cache.vacuum(spark, str(libs), str(kept)) == 1 and len(written()) == 41
    # Rows of another version of the engine are read anew.
    assert cache.stale_archives(spark, str(libs), str(kept), cache.VERSION + 1).count() == 41
    listed = cache.archives(spark, str(libs))
    assert merge.cache_plan(listed, cache.load(spark, str(kept)).select(F.col("archive").alias("path"), "mtime", "version"), cache.VERSION)[0].count() == 0
