"""Operators over paths, build files, host classes and texts at the cursor, on rows made from the ``part`` table.

Templates with the columns of ``modules.parts`` give the texts for both sides; the SQL computes what must come out
from the same columns by string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import columns as C
from skein.functions.cursor import call_at_udf, indent_udf, split_params_udf, word_at_udf
from skein.operators import editing, host, merge, resolve
from skein.plans import modules
from skein.plans.corpus import flat
from skein.plans.modules import _CTE, _columns, _special, _sql, parts, relations
from skein.plans.session import large, ship
from skein.sources import code as source
from skein.sources import projects


def _rows(spark: SparkSession, sf_dir: str, columns: list[str], templates: list[tuple], where: str = "true") -> DataFrame:
    """For each part a row for each of ``templates``: qid (ten times the part's number, and the template's), and texts or numbers."""
    value = lambda x: _columns(x) if isinstance(x, str) else F.lit(x)
    each = F.array(*[F.struct(F.lit(at).alias("at"), *[value(x).alias(c) for c, x in zip(columns, t, strict=True)]) for at, t in enumerate(templates)])
    made = parts(spark, sf_dir).where(where).select("k", F.explode(each).alias("t"))
    return made.select((F.col("k") * 10 + F.col("t.at")).alias("qid"), *[F.col(f"t.{c}").alias(c) for c in columns])


def _union(columns: list[str], rows: list[tuple], where: str = "true") -> str:
    """SQL for rows (place, values); texts are templates."""
    value = lambda x: "null" if x is None else _sql(x) if isinstance(x, str) else str(x).lower()
    selects = [f"select k * 10 + {at} as qid, " + ", ".join(f"{value(x)} as {c}" for c, x in zip(columns, values, strict=True)) + f" from part_links where {where}" for at, *values in rows]
    return _CTE + " union all ".join(selects)


_PATHS = [
    ("a{k}/b.clj", True, False), ("a{k}/b.cljs", True, False), ("c{k}.cljc", True, False), ("d{k}.lg", True, False), ("x{k}/project.clj", False, False),
    ("y{k}/deps.edn", False, True), ("sys{k}.edn", False, False), ("e{k}.txt", False, False), ("{k}/myproject.clj", True, False),
]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are sources and which are manifests."""
    rows = _rows(spark, sf_dir, ["path"], [(p,) for p, _, _ in _PATHS])
    return rows.select("path", source.is_source(F.col("path")).alias("source"), source.is_manifest(F.col("path")).alias("manifest"))


FILES_SQL = f"select * exclude (qid) from ({_union(['path', 'source', 'manifest'], [(at, *x) for at, x in enumerate(_PATHS)])})"


_DIALECT = [("zn{k}", "zn{k}", "native"), ("h{k}", "p.n{k}/h{k}", "definition"), ("f{b}", "p.n{b}/f{b}", "definition"), ("if", "if", "special"), ("reduce", None, None), ("a/g{a}", "p.n{a}/g{a}", "definition")]


def code_resolve_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second dialect: bare names end at its own core, special forms and natives."""
    r = relations(spark, sf_dir)
    natives = parts(spark, sf_dir).select(_columns("zn{k}").alias("name"))
    asked = _rows(spark, sf_dir, ["word", "ns"], [(w, "p.n{k}") for w, _, _ in _DIALECT], "k % 20 = 0")
    return resolve.resolve(asked, r.namespaces, r.symbols, r.core_names, _special(spark), natives).select("qid", "word", "fqn", "origin")


DIALECT_SQL = _union(["word", "fqn", "origin"], [(at, *x) for at, x in enumerate(_DIALECT)], "k % 20 = 0")


# text, line, character, then: word, keyword?, head, argument, indentation
_AT = [
    ("(foo ::b{k}/c{a} 1)", 0, 8, "b{k}/c{a}", True, "", -1, 0),
    ("(let [x 1] (f{k} x ", 0, 13, "f{k}", False, "f{k}", 1, 13),
    ('(f{k} "a', 0, 1, "f{k}", False, "f{k}", 0, -1),
    ("[a{k}\n b", 1, 1, "b", False, "", -1, 1),
]


def code_cursor_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, calls, parameters and indentation at places of texts."""
    ship(spark)
    at = _rows(spark, sf_dir, ["text", "line", "ch", "arity"], [(*x[:3], "[a{k} ^String b & {:keys [c d]}]") for x in _AT])
    out = at.select("qid", word_at_udf("text", "line", "ch").alias("w"), call_at_udf("text").alias("c"), indent_udf("text").alias("indent"), split_params_udf("arity").alias("p"))
    return out.select("qid", "w.word", "w.is_keyword", F.coalesce("c.head", F.lit("")).alias("head"), F.coalesce("c.argument", F.lit(-1)).alias("argument"), F.coalesce("indent", F.lit(-1)).alias("indent"), F.array_join("p", "|").alias("params"))


CURSOR_SQL = _union(["word", "is_keyword", "head", "argument", "indent", "params"], [(at, *x[3:], "a{k}|^String b|& {:keys [c d]}") for at, x in enumerate(_AT)])


_HOST_WORDS = [("Box{k}.", "host.Box{k}", None, True), ("L{k}/abs", "java.lang.L{k}", "abs", False), ("host.Box{a}", "host.Box{a}", None, False), ("Nope{k}", None, None, None)]


def code_java_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to host classes: imports, full names, then the host's own package."""
    every = parts(spark, sf_dir)
    namespaces = every.select(_columns("p.n{k}").alias("name"), F.create_map(_columns("Box{k}"), _columns("host.Box{k}")).alias("imports"))
    classes = every.select(F.explode(F.array(_columns("host.Box{k}"), _columns("java.lang.L{k}"))).alias("fqn"))
    asked = _rows(spark, sf_dir, ["word", "ns"], [(w[0], "p.n{k}") for w in _HOST_WORDS])
    return resolve.resolve_class(asked, namespaces, classes)


JAVA_WORDS_SQL = _union(["word", "class", "member", "makes"], [(at, w, c, m, makes) for at, (w, c, m, makes) in enumerate(_HOST_WORDS) if c])

MANIFEST = '(defproject p{k} "1" ; x\n :dependencies ^:replace [[org.a/b{k} "1.{size}"] #_[no "2"] [solo{a} "3" :exclusions [x]]] :profiles {:dev {:dependencies [[org.a/b{k} "1.{size}"] [t/u "4"]]}})'
_ARCHIVE = "/m2/org/a/b{k}/1.{size}/b{k}-1.{size}.jar"


def code_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct dependencies of build files whose archives are in the local repository; every second one lacks its first."""
    every = parts(spark, sf_dir)
    found = projects.coordinates(every.select(_columns("w{k}/project.clj").alias("path"), _columns(MANIFEST).alias("text")))
    there = every.where("k % 2 = 0").select(_columns(_ARCHIVE).alias("path")).unionByName(every.select(F.explode(F.array(_columns("/m2/solo{k}/solo{k}/3/solo{k}-3.jar"), F.lit("/m2/t/u/4/u-4.jar"))).alias("path")))
    return projects.present_artifacts(found, F.lit("/m2"), there)


MANIFESTS_SQL = _CTE + f"""
select {_sql('w{k}/project.clj')} as path, 0 as ord, {_sql(_ARCHIVE)} as archive from part_links where k % 2 = 0
union all select {_sql('w{k}/project.clj')}, 1, {_sql('/m2/solo{a}/solo{a}/3/solo{a}-3.jar')} from part_links where a in (select k from part_links)
union all select {_sql('w{k}/project.clj')}, 2, '/m2/t/u/4/u-4.jar' from part_links
"""


def code_native_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that lines of the dialect's own sources define, comments left out."""
    lines = _rows(spark, sf_dir, ["line"], [('  ns.Def("count{k}", f)',), ('// ns.Def("old{k}", f)',), ("x := {k}",), ('ns.Def("first{size}", g) // c',)])
    return projects.native_definitions(lines, "line")


NATIVE_SQL = _CTE + "select 'count' || k as name from part_links union select 'first' || size from part_links"


def code_classpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives and foreign folders of class paths."""
    lines = _rows(spark, sf_dir, ["cp"], [("/p/src:/m2/a{k}.jar:/ext/lib{k}::/m2/b{size}.jar",)])
    return projects.classpath_entries(lines, "cp", F.lit("/p")).select("qid", "entry", "kind")


CLASSPATH_SQL = _CTE + " union all ".join(f"select k * 10 as qid, {_sql(e)} as entry, '{kind}' as kind from part_links" for e, kind in (("/m2/a{k}.jar", "archive"), ("/ext/lib{k}", "folder"), ("/m2/b{size}.jar", "archive")))

BOX = """package host.q;
/** A box {k}. */
public class Box{k}<T> extends Base implements Runnable {
  /** Size. */
  public static int size{k}(String s, int n) { return 1; }
  private final int left = 2;
  public Box{k}(int n) { }
  public static int size{k}(Map<K, V> m) { return 2; }
}
"""
# name, kind, static, params, returns, doc, above, line, text before it
_MEMBERS = [
    ("Box{k}", "class", False, "", "", "A box {k}.", "Base,Runnable", 2, "public class "), ("size{k}", "method", True, "(String s, int n)", "int", "Size.", "", 4, "  public static int "),
    ("left", "field", False, "", "int", "", "", 5, "  private final int "), ("Box{k}", "constructor", False, "(int n)", "", "", "", 6, "  public "), ("size{k}", "method", True, "(Map<K, V> m)", "int", "", "", 7, "  public static int "),
]


def _host(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members of a host source for each part (every fifth has a file without a type beside it), and namespaces that import them."""
    every = parts(spark, sf_dir)
    files = every.select(_columns("zip!/java.base/host/q/Box{k}.java").alias("path"), _columns(BOX).alias("text"))
    files = files.unionByName(every.where("k % 5 = 0").select(_columns("zip!/java.base/host/q{k}/package-info.java").alias("path"), _columns("package host.q{k};").alias("text")))
    return host.class_members(files), every.select(_columns("app{k}").alias("name"), F.create_map(_columns("Box{k}"), _columns("host.q.Box{k}")).alias("imports"))


def _place(line: int, before: str, token: str) -> str:
    return f"{line} as sl, {len(before)} as sc, {line} as el, cast({len(before)} + length({_sql(token)}) as int) as ec"


def code_host_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and members of host sources with the places of their names."""
    rows = _host(spark, sf_dir)[0].withColumn("doc", F.coalesce("doc", F.lit(""))).withColumn("above", F.concat_ws(",", "extends", "implements"))
    return flat(rows, "class", "name", "kind", "is_static", "params", "returns", "doc", "above")


HOST_SQL = _CTE + " union all ".join(
    f"select {_sql('host.q.Box{k}')} as class, {_sql(name)} as name, '{kind}' as kind, {str(static).lower()} as is_static, '{params}' as params, '{returns}' as returns, {_sql(doc)} as doc, '{above}' as above, {_place(line, before, name)} from part_links"
    for name, kind, static, params, returns, doc, above, line, before in _MEMBERS
)

_FENCE = "```java\n{}\n```\n"
_SHOWN = {
    "class": _FENCE.format("class host.q.Box{k} extends Base implements Runnable") + "*java class*\n\nA box {k}.", "constructor": _FENCE.format("Box{k}(int n)") + "*host.q.Box{k}*\n",
    "method": _FENCE.format("static int size{k}(String s, int n)") + "*host.q.Box{k}*\n\nSize.", "field": _FENCE.format("int left") + "*host.q.Box{k}*\n",
}
# word, namespace, the member that it means
_MEANT = [("Box{k}", "app{k}", 0), ("Box{k}.", "app{k}", 3), ("Box{k}/size{k}", "app{k}", 1), ("Box{k}/left", "app{k}", 2), ("Box{k}/none", "app{k}", 0), ("host.q.Box{k}", "x", 0), ("Box{k}", "x", None)]


def code_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of host calls: where they lead and what a reader sees."""
    members, namespaces = _host(spark, sf_dir)
    asked = _rows(spark, sf_dir, ["word", "ns"], [x[:2] for x in _MEANT])
    met = resolve.resolve_class(asked, namespaces, members.where("kind = 'class'").select(F.col("class").alias("fqn")))
    return flat(host.host_definition(met, members).join(large(host.host_hover(met, members)), "qid"), "qid", "kind", "text")


HOST_WORDS_SQL = _CTE + " union all ".join(
    f"select k * 10 + {at} as qid, '{_MEMBERS[m][1]}' as kind, {_sql(_SHOWN[_MEMBERS[m][1]])} as text, {_place(_MEMBERS[m][7], _MEMBERS[m][8], _MEMBERS[m][0])} from part_links" for at, (_, _, m) in enumerate(_MEANT) if m is not None
)


def code_host_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static members that ``Class/p`` grows into."""
    members, namespaces = _host(spark, sf_dir)
    asked = _rows(spark, sf_dir, ["prefix", "ns"], [("Box{k}/s", "app{k}"), ("Box{k}/l", "app{k}"), ("Box{k}/", "x"), ("host.q.Box{k}/", "x")])
    return host.static_completions(asked, namespaces, members)


HOST_COMPLETIONS_SQL = _union(["label", "kind", "detail"], [(0, "Box{k}/size{k}", "method", "size{k}(String s, int n)"), (3, "host.q.Box{k}/size{k}", "method", "size{k}(String s, int n)")])


def code_host_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overloads of host calls being typed."""
    members, namespaces = _host(spark, sf_dir)
    asked = _rows(spark, sf_dir, ["ns", "head", "argument"], [("app{k}", "Box{k}/size{k}", 1), ("app{k}", "Box{k}.", 0), ("app{k}", "Box{k}/size{k}", 5), ("app{k}", "Box{k}/left", 0)])
    return host.host_signatures(asked, namespaces, members)


_ONE, _TWO = "size{k}(String s, int n)", "size{k}(Map<K, V> m)"
HOST_SIGNATURES_SQL = _union(["label", "signature", "active", "parameter"], [(0, _ONE, 0, 0, 1), (0, _TWO, 1, 0, 1), (1, "Box{k}(int n)", 0, 0, 0), (2, _ONE, 0, 0, 1), (2, _TWO, 1, 0, 1)])


def code_format_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading space of lines just begun, where it is not right yet."""
    return editing.format_lines(_rows(spark, sf_dir, ["before", "text"], [("(defn f{k} [x]\n", "x)"), ("(defn f{k} [x]\n", "  x)"), ("[{k}\n", "    2]"), ('(f{k} "a\n', "b"), ("(f{k} a\n", "b)")]))


FORMAT_SQL = _union(["replaced", "new_text"], [(0, 0, "  "), (2, 4, " "), (4, 0, "  ")])


def code_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros declared alike, from two settings files of each part, the second on top."""
    every = parts(spark, sf_dir)
    rows = lambda text: editing.settings(every.select(_columns("s{k}/config.edn").alias("path"), _columns(text).alias("text"))).select("macro", "target")
    kinds = spark.createDataFrame(editing.definer_kinds(), "target string, kind string")
    base = rows("{:lint-as {a/x{k} clojure.core/defn b/y{k} clojure.core/def c/z{k} clojure.core/let d/w{k} clojure.core/defn}}")
    return merge.overlay_settings(base, rows("{:lint-as {b/y{k} clojure.core/let a/x{k} clojure.core/defrecord}}"), kinds)


SETTINGS_SQL = _CTE + f"select {_sql('a/x{k}')} as macro, 'clojure.core/defrecord' as target, 'Defrecord' as kind from part_links union all select {_sql('d/w{k}')}, 'clojure.core/defn', 'Defn' from part_links"

_CHANGES = [
    ("src/n{k}.clj", "changed", "extract"), ("src/m{k}.clj", "deleted", "remove"), ("d{k}/deps.edn", "changed", "libraries"), (".x/{k}.cp", "created", "libraries"),
    (".lint{k}/config.edn", "changed", "rebuild"), ("g{k}/.gitignore", "created", "rebuild"),
]


def code_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What watched changes ask for, and whether a line declares the alias under the cursor (J9)."""
    found = editing.route_changes(_rows(spark, sf_dir, ["path", "kind"], [x[:2] for x in _CHANGES]))
    number: Column = F.regexp_extract("path", r"(\d+)", 1)
    line = F.concat(F.lit("[a.b :as bee"), number, F.lit("]"))
    return found.withColumn("alias_line", editing.on_alias_declaration(line, F.concat(F.lit("bee"), number))).withColumn("other_line", editing.on_alias_declaration(line, F.lit("ax")))


CHANGES_SQL = f"select * exclude (qid) from ({_union(['path', 'action', 'alias_line', 'other_line'], [(at, p, a, True, False) for at, (p, _, a) in enumerate(_CHANGES)])})"


def code_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies from part 1 on, breadth first; a checkout that is missing ends its branch, and hides later edges to it."""
    every = parts(spark, sf_dir)
    steps = F.explode(F.array(*[F.struct(F.lit(at).alias("ord"), F.col(link).alias("to")) for at, link in enumerate("abcd")])).alias("e")
    edges = every.select(F.col("k").cast("string").alias("parent"), steps).select("parent", "e.ord", F.col("e.to").cast("string").alias("lib"), F.concat(F.lit("/git/"), "e.to").alias("at"))
    there = every.where("k % 3 <> 0").select(F.concat(F.lit("/git/"), "k").alias("at"))
    return projects.walk_dependencies(edges, "1", folder="at", present=there.withColumnRenamed("at", "folder")).select("lib", F.col("depth").cast("int").alias("depth"))


CODE_WALK_SQL = _CTE.replace("with part_links", "with recursive part_links") + """
, edges as (select k, unnest([a, b, c, d]) as lib from part_links),
walk(lib, depth) as (select lib, 1 from edges where k = 1 and lib % 3 <> 0 and lib in (select k from part_links)
  union select e.lib, depth + 1 from walk w join edges e on e.k = w.lib where e.lib % 3 <> 0 and e.lib in (select k from part_links) and depth < 40)
select cast(lib as varchar) as lib, min(depth) as depth from walk group by lib
"""


def code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, definitions, usages and namespaces of the corpus, observed while it was extracted."""
    seen = modules.counts(spark, sf_dir)
    return spark.createDataFrame([tuple(seen[c] for c in ("files", "problems", "symbols", "usages", "namespaces"))], "files long, problems long, symbols long, usages long, namespaces long")


COUNTS_SQL = f"""
with symbols as ({modules.SYMBOLS_SQL}), usages as ({modules.OCCURRENCES_SQL}), files as (select count(*) + 1 as n from part)
select n as files, cast(0 as bigint) as problems, (select count(*) from symbols) + 3 as symbols, (select count(*) from usages) as usages, n as namespaces from files
"""

_TWINS = {
    code_files: FILES_SQL, code_resolve_dialect: DIALECT_SQL, code_cursor_functions: CURSOR_SQL, code_java_words: JAVA_WORDS_SQL, code_manifests: MANIFESTS_SQL, code_native_definitions: NATIVE_SQL,
    code_classpath: CLASSPATH_SQL, code_host_members: HOST_SQL, code_host_words: HOST_WORDS_SQL, code_host_completions: HOST_COMPLETIONS_SQL, code_host_signatures: HOST_SIGNATURES_SQL,
    code_format_lines: FORMAT_SQL, code_settings: SETTINGS_SQL, code_changes: CHANGES_SQL, code_walk: CODE_WALK_SQL, code_counts: COUNTS_SQL,
}
QUERIES = {f.__name__: f for f in _TWINS}
ORACLE = {f.__name__: sql for f, sql in _TWINS.items()}
