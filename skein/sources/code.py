"""Source files as tables: listing, archives, and one extraction pass into relations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.facts import CORE_NAMES, CORE_NS, Facts, file_facts
from skein.plans.session import ship
from skein.sources.archives import entries_in, read_entries
from skein.sources.ignore import ignore_rules, kept

#: Extensions of source files, and files that only declare a build.
SOURCE_PATTERN = r"[.](?:clj|cljs|cljc|lg)$"
ARCHIVE_PATTERN = r"[.](?:clj|cljs|cljc)$"
MANIFESTS = ("deps.edn", "bb.edn", "shadow-cljs.edn", "lgx.edn")

_POINTS = ("start_line", "start_char", "end_line", "end_char")
RANGE = T.StructType([T.StructField(n, T.IntegerType()) for n in _POINTS])
_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_STRINGS, _MAP = T.ArrayType(_S), T.MapType(_S, _S)


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


#: One row per file; each relation is an array, so one pass of Python feeds all of them.
PACKED = T.StructType(
    [
        T.StructField("path", _S), T.StructField("source_kind", _S), T.StructField("source_path", _S), T.StructField("scan_seq", T.LongType()),
        T.StructField("ns", _S), T.StructField("aliases", _MAP), T.StructField("refers", _MAP), T.StructField("requires", _STRINGS), T.StructField("imports", _MAP),
        T.StructField("symbols", _rows(fqn=_S, ns=_S, name=_S, kind=_S, params=_STRINGS, doc=_S, range=RANGE, name_range=RANGE, ordinal=_I)),
        T.StructField("occurrences", _rows(fqn=_S, name_range=RANGE, discarded=_B, open=_S, ordinal=_I)),
        T.StructField("qualified", _rows(prefix=_S, name=_S, range=RANGE)),
        T.StructField("libspecs", _rows(clause=_I, pos=_I, spec_kind=_S, text=_S, lead=_S, range=RANGE, ns_name=_S, ns_range=RANGE, alias=_S, refers=_STRINGS, has_refers=_B, refer_all=_B, unknown_opt=_B, refer_from=T.ArrayType(_I), refer_to=_I, clause_from=T.ArrayType(_I), clause_range=RANGE)),
        T.StructField("bindings", _rows(name=_S, name_range=RANGE, scope=RANGE, holes=T.ArrayType(RANGE), local=_B, ordinal=_I)),
        T.StructField("bare", _STRINGS), T.StructField("key_prefixes", _STRINGS), T.StructField("ignored", T.ArrayType(RANGE)),
        T.StructField("tokens", _rows(name=_S, name_range=RANGE)), T.StructField("ns_end", RANGE), T.StructField("problem", _S),
    ]
)


def is_source(path: Column) -> Column:
    """Source files by extension; the project file of the build tool is none."""
    return F.rlike(path, F.lit(SOURCE_PATTERN)) & ~F.rlike(path, F.lit(r"(^|[/\\])project[.]clj$"))


def is_manifest(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1).isin(*MANIFESTS)


def _plain_path(column: str = "path") -> Column:
    return F.regexp_replace(column, "^file:/+", "/")


def read_files(spark: SparkSession, root: str, glob: str = "*", ignored: bool = False) -> DataFrame:
    """Files under a root: path, text, mtime.

    Hidden files and folders are left out (Spark's listing passes over names that begin with a dot or an underscore),
    and what the ignore files of the tree exclude, unless ``ignored``. Contents are read of the files that stay.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    read = raw.select(_plain_path().alias("path"), F.decode("content", "UTF-8").alias("text"), F.unix_timestamp("modificationTime").alias("mtime"))
    if ignored:
        return read
    listed = raw.select(_plain_path().alias("path"))
    return read.join(kept(listed, ignore_rules(listed, root), root), "path", "left_semi")


def read_archives(spark: SparkSession, root: str, pattern: str = ARCHIVE_PATTERN, only: DataFrame | None = None) -> DataFrame:
    """Entries of archives under a root as files: path ``archive!/entry``, text, mtime, source_path, problem.

    An archive or entry that cannot be read is a row without text whose ``problem`` says why. Entries come out one by one.
    ``only`` (path, mtime) names the archives to read.
    """
    return read_entries(spark, root, pattern) if only is None else entries_in(only, pattern)


def extract(files: DataFrame, lint_as: dict[str, str] | None = None, core: frozenset[str] = CORE_NAMES) -> DataFrame:
    """One packed row per file. ``files`` has path and text, and may have source_kind, source_path, scan_seq.

    A file whose facts cannot be read keeps its row, empty, with the reason in ``problem``.
    """
    ship(files.sparkSession)
    wanted = {"source_kind": F.lit("project"), "source_path": F.lit(None).cast("string"), "scan_seq": F.lit(0).cast("long")}
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c) if c in files.columns else v.alias(c) for c, v in wanted.items()])
    point = lambda span: dict(zip(_POINTS, span, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                problem = None
                try:
                    facts = file_facts(row.path, row.text, lint_as, core)
                except (ValueError, IndexError, KeyError, RecursionError, MemoryError) as fault:
                    facts, problem = Facts(), f"{type(fault).__name__}: {fault}"
                out.append(
                    {
                        "path": row.path, "source_kind": row.source_kind, "source_path": row.source_path, "scan_seq": row.scan_seq,
                        "ns": facts.ns, "aliases": facts.aliases, "refers": facts.refers, "requires": facts.requires, "imports": facts.imports,
                        "symbols": [s | {"range": point(s["range"]), "name_range": point(s["name_range"])} for s in facts.symbols],
                        "occurrences": [o | {"name_range": point(o["name_range"])} for o in facts.occurrences],
                        "qualified": [{"prefix": q["prefix"], "name": q["name"], "range": point(q["span"])} for q in facts.qualified],
                        "libspecs": [x | {"range": point(x["span"]), "ns_range": point(x["ns_span"]), "clause_range": point(x["clause_span"])} for x in facts.libspecs],
                        "bindings": [b | {"name_range": point(b["name_range"]), "scope": point(b["scope"]), "holes": [point(h) for h in b["holes"]]} for b in facts.bindings],
                        "bare": list(dict.fromkeys(n for n, _ in facts.tokens)), "key_prefixes": facts.key_prefixes, "ignored": [point(i) for i in facts.ignored],
                        "tokens": [{"name": n, "name_range": point(t)} for n, t in facts.tokens], "ns_end": point(facts.ns_end) if facts.ns_end else None, "problem": problem,
                    }
                )
            yield pd.DataFrame(out, columns=PACKED.fieldNames())

    return files.mapInPandas(run, PACKED)


def counted(packed: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Packed rows that are counted as they pass: files, problems, symbols, usages, bindings, files with a namespace.

    The pass that writes the rows fills the observation, so no second one is needed. ``namespace_sketch`` estimates
    the distinct namespaces, and can be merged with the sketches of other scans (``distinct_of``).
    """
    seen = Observation(name)
    return packed.observe(
        seen, F.count(F.lit(1)).alias("files"), F.count("problem").alias("problems"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("occurrences")).alias("usages"),
        F.sum(F.size("bindings")).alias("bindings"), F.count_if(F.col("ns") != "").alias("namespaces"),
        F.hll_sketch_agg(F.when(F.col("ns") != "", F.col("ns"))).alias("namespace_sketch"),
    ), seen


def distinct_of(spark: SparkSession, sketches: list[bytes]) -> int:
    """The number of distinct namespaces of several scans, by their sketches (a few kilobytes each)."""
    rows = spark.createDataFrame([(bytearray(x),) for x in sketches], "s binary")
    return rows.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()[0] or 0


class Relations:
    """The relations of packed files, each a projection of the one extraction.

    Write ``packed`` once (``plans.session.cut``); every relation then reads only its own array. ``core`` may name
    further names of the core namespace, beside those that the files define in it.
    """

    def __init__(self, packed: DataFrame, core: DataFrame | None = None):
        self.packed, self.core = packed, core

    def _exploded(self, name: str) -> DataFrame:
        return self.packed.select("path", "source_kind", "source_path", "scan_seq", F.explode(name).alias("x")).select(F.col("path").alias("file"), "source_kind", "source_path", "scan_seq", "x.*")

    @property
    def symbols(self) -> DataFrame:
        return self._exploded("symbols")

    @property
    def core_names(self) -> DataFrame:
        """(name): names of the core namespace that the files define, and those given."""
        own = self.symbols.where(F.col("ns") == CORE_NS).select("name")
        return (own if self.core is None else own.unionByName(self.core.select("name"))).distinct()

    @property
    def usages(self) -> DataFrame:
        """Usages as their file alone explains them; ``open`` is a bare name that nothing there explains."""
        return self._exploded("occurrences").drop("source_path", "scan_seq")

    @property
    def occurrences(self) -> DataFrame:
        """Usages; a bare name that nothing in its file explains is the core namespace's if that has it."""
        core = self.core_names.select(F.col("name").alias("open"), F.lit(True).alias("is_core"))
        found = self.usages.join(core, "open", "left")
        return found.withColumn("fqn", F.when(F.col("is_core"), F.concat(F.lit(f"{CORE_NS}/"), "open")).otherwise(F.col("fqn"))).drop("open", "is_core")

    @property
    def tokens(self) -> DataFrame:
        """Unqualified symbols outside the namespace form, with their places."""
        return self._exploded("tokens").select("file", "name", "name_range")

    @property
    def ns_forms(self) -> DataFrame:
        """(file, end_line, end_char): where the last part of each file's namespace form ends."""
        return self.packed.where("ns_end is not null").select(F.col("path").alias("file"), F.col("ns_end.end_line").alias("end_line"), F.col("ns_end.end_char").alias("end_char"))

    @property
    def problems(self) -> DataFrame:
        """Files that could not be read, and why."""
        return self.packed.where("problem is not null").select(F.col("path").alias("file"), "problem")

    @property
    def namespaces(self) -> DataFrame:
        return self.packed.select(F.col("path").alias("file"), F.col("ns").alias("name"), "aliases", "refers", "requires", "imports", "source_kind", "scan_seq")

    @property
    def qualified(self) -> DataFrame:
        return self._exploded("qualified").select("file", "prefix", "name", "range")

    @property
    def libspecs(self) -> DataFrame:
        return self._exploded("libspecs").drop("source_kind", "source_path", "scan_seq")

    @property
    def bindings(self) -> DataFrame:
        return self._exploded("bindings").drop("source_kind", "source_path", "scan_seq")

    @property
    def bare(self) -> DataFrame:
        return self.packed.select(F.col("path").alias("file"), F.explode("bare").alias("name"))

    @property
    def used_prefixes(self) -> DataFrame:
        """Distinct prefixes of symbols and keywords of each file."""
        both = F.array_union(F.transform("qualified", lambda q: q["prefix"]), F.col("key_prefixes"))
        return self.packed.select(F.col("path").alias("file"), F.explode(both).alias("prefix"))

    @property
    def ignored(self) -> DataFrame:
        return self.packed.select(F.col("path").alias("file"), F.explode("ignored").alias("range"))
