"""Upserts and precedence: whose rows win, and which rows go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused_name(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def _ranked(rows: DataFrame, keys: list[str], order: list, chosen: Callable[[Column], Column]) -> DataFrame:
    rank = unused_name(rows, "_rank")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(chosen(F.col(rank))).drop(rank)


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return _ranked(rows, keys, order, lambda rank: rank == 1)


def best_of(rows: DataFrame, keys: list[str], order: list[str], kept: list[str]) -> DataFrame:
    """The ``kept`` columns of each key's least row by ``order``: an aggregate, combined before rows are dealt out."""
    best = unused_name(rows, "_best")
    chosen = rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias(best))
    return chosen.select(*keys, f"{best}.*")


def repeats(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its key."""
    return _ranked(rows, keys, order, lambda rank: rank > 1)


def last_write(symbols: DataFrame) -> DataFrame:
    """One definition per name: the last scan's last; a multimethod's own definition before its methods."""
    is_method = F.when(F.col("kind") == "Defmethod", 1).otherwise(0)
    return first_of(symbols, ["fqn"], [is_method.asc(), F.col("scan_seq").desc(), F.col("ordinal").desc(), F.col("file").desc()])


def merge_libraries(project: DataFrame, library: DataFrame) -> DataFrame:
    """Project rows, and those library rows whose namespace the project does not own (first file wins)."""
    owned = project.select("ns").distinct()
    foreign = library.join(owned, "ns", "left_anti")
    return project.unionByName(first_of(foreign, ["fqn"], [F.col("file"), F.col("ordinal")]))


def rescan(current: DataFrame, fresh: DataFrame, kept_files: DataFrame, file: str = "file") -> DataFrame:
    """A new scan replaces the old: files it holds are replaced, files it lacks go, save the kept ones."""
    scanned = fresh.select(file).distinct()
    stay = current.join(scanned, file, "left_anti").join(kept_files.select(file).distinct(), file, "left_semi")
    return stay.unionByName(fresh)


def remove_files(rows: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """All rows but those of the given files."""
    return rows.join(files.select(file).distinct(), file, "left_anti")


def clear_libraries(rows: DataFrame) -> DataFrame:
    """The project's rows alone. On packed files this takes every relation of a library along."""
    return rows.where(F.col("source_kind") == "project")


def remove_packed(packed: DataFrame, files: DataFrame) -> DataFrame:
    """Packed files without those given: all relations of a file are in its row, so they go together."""
    return remove_files(packed, files.select(F.col("file").alias("path")), "path")


def with_live(packed: DataFrame, live: DataFrame) -> DataFrame:
    """Packed files where those of open documents come from their live text: every relation then follows the edits."""
    return packed.join(live.select("path"), "path", "left_anti").select(live.columns).unionByName(live)


def rescan_packed(current: DataFrame, fresh: DataFrame, kept_files: DataFrame) -> DataFrame:
    """Packed files after a new scan of the project: scanned files are replaced, project files it lacks go, save the kept ones.

    A kept file whose namespace was scanned anew loses its definitions there: names that are gone do not linger.
    Library rows stay.
    """
    library = current.where(F.col("source_kind") != "project")
    stay = rescan(clear_libraries(current), fresh, kept_files.select(F.col("file").alias("path")), "path").join(fresh.select("path"), "path", "left_anti")
    again = fresh.where("ns <> ''").select("ns").distinct().withColumn("again", F.lit(True))
    nothing = F.filter("symbols", lambda _: F.lit(False))
    stay = stay.join(again, "ns", "left").withColumn("symbols", F.when(F.col("again"), nothing).otherwise(F.col("symbols"))).drop("again")
    return library.unionByName(stay.select(library.columns)).unionByName(fresh)


def cache_plan(archives: DataFrame, cached: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Archives to read anew, and cached rows that still hold (same path, time and format)."""
    valid = cached.where(F.col("version") == version)
    stale = archives.join(valid.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")
    return stale, valid.join(archives.select("path", "mtime"), ["path", "mtime"], "left_semi")


#: Namespaces and the names that the second dialect's library gives them.
DIALECT_NAMES = {"clojure.core": "core", "clojure.string": "string", "clojure.set": "set", "clojure.walk": "walk", "clojure.edn": "edn", "clojure.zip": "zip", "clojure.data": "data", "clojure.pprint": "pprint", "clojure.test": "test"}


def dialect_copies(symbols: DataFrame) -> DataFrame:
    """Rows of the second dialect's library under both of their names."""
    spark = symbols.sparkSession
    return with_alias_copies(symbols, spark.createDataFrame([(own, other) for other, own in DIALECT_NAMES.items()], "ns string, other string"))


def with_alias_copies(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Also the rows of each namespace under its other names. ``names`` has ns, other."""
    copies = symbols.join(names, "ns").withColumn("ns", F.col("other")).withColumn("fqn", F.concat_ws("/", "other", "name")).drop("other")
    return symbols.unionByName(copies.select(symbols.columns))


def overlay_settings(base: DataFrame, overlay: DataFrame, kinds: DataFrame) -> DataFrame:
    """(macro, target): the overlay's entry wins, then targets that are no definer drop. ``kinds`` has target, kind."""
    merged = base.withColumnRenamed("target", "base").join(overlay.withColumnRenamed("target", "top"), "macro", "full_outer")
    return merged.select("macro", F.coalesce("top", "base").alias("target")).join(kinds, "target").select("macro", "target", "kind")
