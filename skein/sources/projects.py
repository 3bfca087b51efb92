"""Project manifests: source folders, class paths and dependencies.

Listing folders and reading manifests is the driver's work (a few small files
of one project); what they declare becomes tables.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.columns import artifact_path
from skein.functions.edn import Name, parse, values_after
from skein.operators.merge import first_of
from skein.plans.session import scratch, ship

DEPS = "parent string, ord int, lib string, kind string, location string, ref string, deps_root string"
COORDS = "ord int, group string, artifact string, version string"


def project_kind(folder: Path) -> str | None:
    for name, kind in (("deps.edn", "deps"), ("project.clj", "lein"), ("lgx.edn", "lgx"), ("shadow-cljs.edn", "shadow"), ("bb.edn", "bb")):
        if (folder / name).is_file():
            return kind
    return None


def project_root(path: Path) -> Path | None:
    """The nearest folder above that has a manifest."""
    return next((p for p in [path, *path.parents] if project_kind(p)), None)


def _unique(items: list[str]) -> list[str]:
    return list(dict.fromkeys(items))


def deps_paths(text: str) -> list[str]:
    """``:paths`` and every alias's ``:extra-paths``."""
    top = parse(text)
    if not isinstance(top, dict):
        return []
    found = top.get(":paths") or []
    for alias in (top.get(":aliases") or {}).values():
        if isinstance(alias, dict):
            found = found + (alias.get(":extra-paths") or [])
    return _unique([p for p in found if isinstance(p, str) and not isinstance(p, Name)])


def lein_paths(text: str) -> list[str]:
    return _unique([p for key in (":source-paths", ":test-paths") for group in values_after(text, key) for p in group if isinstance(p, str) and not isinstance(p, Name)])


def source_folders(root: Path) -> list[Path]:
    """Declared source folders and the usual two, in order, those that exist."""
    declared = []
    for name, rule in (("deps.edn", deps_paths), ("lgx.edn", deps_paths), ("project.clj", lein_paths)):
        if (root / name).is_file():
            declared += rule((root / name).read_text())
    return [root / p for p in _unique([*declared, "src", "test"]) if (root / p).is_dir()]


def _coordinates(text: str) -> list[tuple[str, str, str]]:
    """Direct dependencies (group, artifact, version) of a build file, each once, in order."""
    found: dict[tuple[str, str, str], None] = {}
    for group in values_after(text, ":dependencies"):
        for item in group:
            if isinstance(item, list) and len(item) > 1 and isinstance(item[0], Name) and isinstance(item[1], str) and not isinstance(item[1], Name):
                ns, _, name = item[0].rpartition("/")
                found.setdefault((ns or name, name, item[1]))
    return list(found)


def coordinates(manifests: DataFrame) -> DataFrame:
    """Build files (path, text) to their direct dependencies: (path, ord, group, artifact, version), each once, in order."""
    ship(manifests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, k, *c) for path, text in zip(batch["path"], batch["text"], strict=True) for k, c in enumerate(_coordinates(text or ""))]
            yield pd.DataFrame(rows, columns=["path", "ord", "group", "artifact", "version"])

    return manifests.select("path", "text").mapInPandas(run, f"path string, {COORDS}")


def present_artifacts(coords: DataFrame, repo: Column, archives: DataFrame) -> DataFrame:
    """Coordinates (path, ord, ..) whose archive is there, as (path, ord, archive); each archive of a build file once.

    ``archives`` (path) is a listing of the local repository.
    """
    placed = coords.select("path", "ord", artifact_path(repo, F.col("group"), F.col("artifact"), F.col("version")).alias("archive"))
    there = placed.join(archives.select(F.col("path").alias("archive")).distinct(), "archive", "left_semi")
    return there.groupBy("path", "archive").agg(F.min("ord").alias("ord")).select("path", "ord", "archive")


def dependency_rows(parent: str, text: str) -> list[tuple]:
    """Rows of one manifest's ``:deps``: checkouts by revision or tag, and local folders; others are passed over."""
    top = parse(text)
    deps = top.get(":deps") if isinstance(top, dict) else None
    rows = []
    for lib, spec in (deps or {}).items():
        if not isinstance(lib, Name) or not isinstance(spec, dict):
            continue
        root = spec.get(":deps/root")
        if isinstance(spec.get(":local/root"), str):
            rows.append((parent, len(rows), str(lib), "local", spec[":local/root"], None, root))
        elif isinstance(spec.get(":git/url"), str):
            ref = spec.get(":git/sha") or (spec.get(":git/tag") or "").replace("/", "_")
            if ref:
                rows.append((parent, len(rows), str(lib), "git", spec[":git/url"], ref, root))
    return rows


def walk_dependencies(edges: DataFrame, root: str, parent: str = "parent", lib: str = "lib", order: str = "ord", folder: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """(lib, depth, place): all libraries reached, each as first met in breadth-first order.

    With ``present``, a listing of folders (column ``folder``), an edge counts only where the checkout that its column
    ``folder`` names is there. A library is decided where it is met first: if its checkout is missing there it is left
    out, and nothing below it is followed, whatever later edges say.

    A level is one join with the edges and, where asked for, one with the listing, written once; libraries met before
    are left out at once, so cycles end.
    """
    spark = edges.sparkSession
    path = scratch(spark, "walk")
    where = F.lit(None).cast("string") if folder is None else F.col(folder)
    steps = edges.select(F.col(parent).alias("_from"), F.col(lib).alias("_to"), F.col(order).cast("long").alias("_ord"), where.alias("_folder"))
    listed = None if present is None else present.select(F.col("folder").alias("_folder")).distinct().withColumn("here", F.lit(True))
    level = steps.where(F.col("_from") == root).select(F.col("_to").alias("lib"), F.lit(1).alias("depth"), F.array("_ord").alias("place"), "_folder")
    depth, schema = 1, None
    while True:
        first = first_of(level, ["lib"], [F.col("place")])
        judged = first.withColumn("here", F.lit(True)) if listed is None else first.join(listed, "_folder", "left").withColumn("here", F.coalesce("here", F.lit(False)))
        judged = judged.select("lib", "depth", "place", "here")
        schema = schema or judged.schema
        judged.write.mode("append").parquet(path)
        found = spark.read.schema(schema).parquet(path)
        last = found.where((F.col("depth") == depth) & F.col("here"))
        if last.isEmpty():
            return found.where("here").select("lib", "depth", "place")
        depth += 1
        after = last.select(F.col("lib").alias("_from"), "place").join(steps, "_from")
        level = after.select(F.col("_to").alias("lib"), F.lit(depth).alias("depth"), F.concat("place", F.array("_ord")).alias("place"), "_folder").join(found.select("lib"), "lib", "left_anti")


def newest_classpath(folder: Path) -> str | None:
    """The newest cached class path that has at least one existing absolute entry."""
    for path in sorted(folder.glob("*.cp"), key=lambda p: p.stat().st_mtime, reverse=True):
        text = path.read_text()
        if any(os.path.isabs(e) and os.path.exists(e) for e in text.strip().split(os.pathsep)):
            return text.strip()
    return None


def classpath_entries(lines: DataFrame, text: str, root: Column) -> DataFrame:
    """Entries of class paths: archives, and folders outside the project."""
    each = lines.select("*", F.posexplode(F.split(F.trim(F.col(text)), ":")).alias("place", "entry")).where("entry <> ''")
    archive = F.rlike("entry", F.lit(r"[.]jar$"))
    return each.withColumn("kind", F.when(archive, "archive").otherwise("folder")).where(archive | ~F.startswith("entry", F.concat(root, F.lit("/"))))


def native_definitions(lines: DataFrame, text: str) -> DataFrame:
    """Names defined as ``ns.Def("name"``, one per line, comments left out."""
    name = F.regexp_extract(F.col(text), r'^(?:(?!//).)*\bns\.Def\("([^"]+)"', 1)
    return lines.select(name.alias("name")).where("name <> ''").distinct()
