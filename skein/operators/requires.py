"""Requires: what is missing, unused or doubled, and the edits that mend it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import columns as C
from skein.operators.merge import best_of, first_of, repeats

# Short names under which these namespaces are usually required.
ALIASES = {"str": "clojure.string", "set": "clojure.set", "io": "clojure.java.io", "edn": "clojure.edn", "walk": "clojure.walk", "pp": "clojure.pprint", "async": "clojure.core.async", "sh": "clojure.java.shell"}


def available(namespaces: DataFrame) -> DataFrame:
    """(file, prefix): what a file's qualified names may begin with: its own namespace, aliases and requires."""
    every = F.array_union(F.array_union(F.array("name"), F.map_keys("aliases")), F.col("requires"))
    return namespaces.select("file", F.explode(every).alias("prefix")).distinct()


def unresolved(qualified: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Qualified usages whose prefix nothing provides; core and host names are no fault."""
    own = qualified.where((F.col("prefix") != "clojure.core") & ~C.is_interop(F.col("prefix")))
    return own.join(available(namespaces), ["file", "prefix"], "left_anti")


def _plain(spec: Column | None = None) -> Column:
    return F.col("alias").isNull() & ~F.col("has_refers") & ~F.col("refer_all")


def judged_libspecs(libspecs: DataFrame, namespaces: DataFrame, used_prefixes: DataFrame, bare: DataFrame) -> DataFrame:
    """Libspecs with ``unused`` (nothing of it is used) and ``kept_refers`` (the referred names that are)."""
    specs = libspecs.join(namespaces.select("file", F.col("name").alias("own_ns")), "file", "left")
    key = ["file", "clause", "pos"]
    by_prefix = specs.select(*key, F.explode(F.array_compact(F.array("ns_name", "alias"))).alias("prefix")).join(used_prefixes, ["file", "prefix"], "left_semi").select(*key).distinct().withColumn("used", F.lit(True))
    names = specs.select(*key, F.posexplode("refers").alias("at", "name")).join(bare, ["file", "name"], "left_semi")
    kept = names.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("kept_refers"))
    out = specs.join(by_prefix, key, "left").join(kept, key, "left").withColumn("kept_refers", F.coalesce("kept_refers", F.array().cast("array<string>")))
    exempt = (F.col("spec_kind") != "vector") | F.col("ns_name").isNull() | F.col("unknown_opt") | _plain() | (F.col("ns_name") == F.col("own_ns"))
    used = F.coalesce("used", F.lit(False)) | F.col("refer_all") | (F.size("kept_refers") > 0)
    return out.withColumn("exempt", exempt).withColumn("unused", ~exempt & ~used).drop("used", "own_ns")


def unused(libspecs: DataFrame, namespaces: DataFrame, used_prefixes: DataFrame, bare: DataFrame) -> DataFrame:
    return judged_libspecs(libspecs, namespaces, used_prefixes, bare).where("unused").select("file", F.col("ns_name").alias("namespace"), F.col("ns_range").alias("range"))


def duplicates(libspecs: DataFrame) -> DataFrame:
    """Every require of a namespace after its first in the file, across clauses."""
    named = libspecs.where("ns_name is not null and spec_kind in ('vector', 'symbol')")
    return repeats(named, ["file", "ns_name"], ["clause", "pos"]).select("file", F.col("ns_name").alias("namespace"), F.col("ns_range").alias("range"))


def diagnostics(qualified: DataFrame, namespaces: DataFrame, libspecs: DataFrame, used_prefixes: DataFrame, bare: DataFrame) -> DataFrame:
    """(file, code, severity, message, range): the three checks as one relation."""
    quote = lambda what, column: F.concat(F.lit(what + " `"), F.col(column), F.lit("`"))
    parts = [
        (unresolved(qualified, namespaces), "unresolved-namespace", "warning", quote("Unresolved namespace", "prefix")),
        (unused(libspecs, namespaces, used_prefixes, bare), "unused-namespace", "hint", quote("Unused require", "namespace")),
        (duplicates(libspecs), "duplicate-require", "warning", quote("Duplicate require", "namespace")),
    ]
    rows = [df.select("file", F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"), "range") for df, code, severity, text in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALIASES.items()), "prefix string, namespace string")


def candidates(usages: DataFrame, namespaces: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, file, prefix, name) to namespaces to require: (qid, namespace, alias, rank, position).

    Conventional aliases, then the namespace so named, then those whose last segment it is; the best rank
    of each counts. It must define the name and not be the file's own.
    """
    asked = usages.where("prefix <> '' and name <> '' and prefix <> 'clojure.core'").join(available(namespaces), ["file", "prefix"], "left_anti")
    known = namespaces.where("name <> ''").select(F.col("name").alias("namespace")).distinct()
    last = known.withColumn("prefix", F.substring_index("namespace", ".", -1))
    curated = asked.join(F.broadcast(aliases), "prefix").select("qid", "file", "name", "namespace", F.col("prefix").alias("alias"), F.lit(0).alias("rank"))
    named = asked.join(known, F.col("prefix") == F.col("namespace")).select("qid", "file", "name", "namespace", F.lit(None).cast("string").alias("alias"), F.lit(1).alias("rank"))
    segment = asked.join(last, "prefix").where("prefix <> namespace").select("qid", "file", "name", "namespace", F.col("prefix").alias("alias"), F.lit(2).alias("rank"))
    best = best_of(curated.unionByName(named).unionByName(segment), ["qid", "file", "name", "namespace"], ["rank"], ["alias", "rank"])
    own = namespaces.select("file", F.col("name").alias("own_ns"))
    defined = symbols.select(F.col("ns").alias("namespace"), "name").distinct()
    valid = best.join(own, "file", "left").where(~F.col("own_ns").eqNullSafe(F.col("namespace"))).join(defined, ["namespace", "name"], "left_semi")
    order = Window.partitionBy("qid").orderBy("rank", "namespace")
    return valid.select("qid", "file", "namespace", "alias", "rank", F.row_number().over(order).alias("position"))


def require_edits(found: DataFrame, libspecs: DataFrame, ns_forms: DataFrame) -> DataFrame:
    """(qid, position, line, ch, new_text): where each candidate's spec goes.

    After the last spec of the first clause, in line with its first; without a clause, a new one ends the
    namespace form. ``ns_forms`` has file, end_line, end_char of that form's last part.
    """
    spec = F.when(F.col("alias").isNotNull(), F.format_string("[%s :as %s]", "namespace", "alias")).otherwise(F.format_string("[%s]", "namespace"))
    ends = libspecs.where("clause = 0").groupBy("file").agg(F.max_by("range", "pos").alias("last"), F.min_by("range", "pos").alias("first"))
    out = found.join(ends, "file", "left").join(ns_forms, "file", "left").withColumn("spec", spec)
    text = F.when(F.col("last").isNotNull(), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.col("first.start_char")), "spec")).otherwise(F.format_string("\n  (:require %s)", "spec"))
    place = out.select("qid", "file", "position", F.coalesce("last.end_line", "end_line").alias("line"), F.coalesce("last.end_char", "end_char").alias("ch"), text.alias("new_text"))
    return place.where("line is not null")


def clean_namespaces(libspecs: DataFrame, namespaces: DataFrame, used_prefixes: DataFrame, bare: DataFrame) -> DataFrame:
    """(file, clause, removes_clause, start, range_end, new_text): each clause that changes, rewritten.

    Unused specs go, unused referred names are pruned, and specs whose final text repeats an earlier one go.
    """
    specs = judged_libspecs(libspecs, namespaces, used_prefixes, bare)
    pruned = ~F.col("exempt") & F.col("has_refers") & (F.size("kept_refers") < F.size("refers"))
    head = lambda place: F.substring("text", F.lit(1), place)
    tail = F.expr("substring(text, refer_to + 1)")
    text = (
        F.when(F.col("unused"), F.lit(None).cast("string"))
        .when(pruned & (F.size("kept_refers") == 0), F.concat(F.rtrim(head(F.get("refer_from", F.lit(0)))), tail))
        .when(pruned, F.concat(head(F.get("refer_from", F.lit(1))), F.lit("["), F.array_join("kept_refers", " "), F.lit("]"), tail))
        .otherwise(F.col("text"))
    )
    planned = specs.withColumn("planned", text).withColumn("same", F.when(F.col("planned").isNotNull() & F.col("spec_kind").isin("vector", "symbol"), C.normalized(F.col("planned"))))
    kept_first = first_of(planned.where("same is not null"), ["file", "same"], [F.col("clause"), F.col("pos")]).select("file", "clause", "pos", F.lit(True).alias("first"))
    done = planned.join(kept_first, ["file", "clause", "pos"], "left").withColumn("final", F.when(F.col("same").isNull() | F.col("first"), F.col("planned")))
    per = done.groupBy("file", "clause").agg(
        F.bool_or(F.col("final").isNull() | (F.col("final") != F.col("text"))).alias("changed"), F.count("final").alias("left"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("final").isNotNull(), F.struct("pos", F.concat("lead", "final").alias("t"))))), lambda x: x["t"]), "").alias("new_text"),
        F.first("clause_from").alias("start"), F.max_by("range", "pos").alias("last"), F.first("clause_range").alias("clause_range"),
    )
    whole = F.col("left") == 0
    return per.where("changed").select(
        "file", "clause", whole.alias("removes_clause"), F.when(whole, F.array("clause_range.start_line", "clause_range.start_char")).otherwise(F.col("start")).alias("start"),
        F.when(whole, F.array("clause_range.end_line", "clause_range.end_char")).otherwise(F.array("last.end_line", "last.end_char")).alias("stop"),
        F.when(whole, "").otherwise(F.col("new_text")).alias("new_text"),
    )
