"""A source corpus made from the ``part`` table by fixed rules, and the operators over it with SQL over the same table.

Part k becomes one file. Templates give its lines for both sides; the SQL twins compute names and places from the
table by string lengths and know nothing of the engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein.operators import completion, editing, merge, references, requires, resolve, search
from skein.plans.corpus import flat
from skein.plans.session import cut, table
from skein.sources.code import Relations, counted, extract

# Numbers of the other parts that part k's file refers to.
LINKS = {"a": 1, "b": 7, "c": 13, "d": 3}
LINES = [
    "(ns p.n{k}",
    "  (:require [p.n{a} :as a]",
    "            [p.n{b} :as b :refer [f{b}]]",
    "            [p.n{c} :as c]))",
    "",
    '(defn f{k} "Part {name}." [x y]',
    "  (a/g{a} x (f{b} y)))",
    "(def g{k} {size})",
    "(defn h{k} ([x] (h{k} x 1)) ([x z] (let [x (inc x) w (* x z)] (n{d}/g{d} w x g{k}))))",
    "#_(old/thing 1)",
    "(comment (f{k} 1 2))",
]
USES = "(def k{k} (c/g{c} ::t{k}))"  # the last line where k is no multiple of three
PROTOCOL = '(defprotocol P{k} (m{k} [this] "Doc {k}."))'  # the last line elsewhere
CORE_FILE = ("lib/clojure/core.clj", "(ns clojure.core)\n(defmacro comment [& body])\n(defn format [fmt & args])\n(defn slurp [f])\n")
FILES_A_TASK = 500

_packed: dict[tuple[str, str], tuple[DataFrame, Observation]] = {}


def _columns(template: str) -> Column:
    return F.concat(*[F.col(x[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x] or [F.lit("")])


def _sql(template: str) -> str:
    return " || ".join([f"cast({x[1:-1]} as varchar)" if re.fullmatch(r"\{\w+\}", x) else "'" + x.replace("'", "''") + "'" for x in re.split(r"(\{\w+\})", template) if x]) or "''"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, name, size and the numbers of the linked parts."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    n = rows.agg(F.max("k")).first()[0] or 1
    return rows.select("*", *[(F.pmod(F.col("k") * step, F.lit(n)) + 1).alias(link) for link, step in LINKS.items()])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, source_kind of the corpus."""
    rows = parts(spark, sf_dir)
    last = F.when(F.col("k") % 3 != 0, _columns(USES)).otherwise(_columns(PROTOCOL))
    text = F.concat_ws("\n", *[_columns(x) for x in LINES], last)
    made = rows.select(_columns("src/p/n{k}.clj").alias("path"), text.alias("text"), F.lit("project").alias("source_kind"))
    made = made.unionByName(spark.createDataFrame([(*CORE_FILE, "dir")], "path string, text string, source_kind string"))
    return made.repartition(max(spark.sparkContext.defaultParallelism, made.count() // FILES_A_TASK), "path")


def relations(spark: SparkSession, sf_dir: str) -> Relations:
    """The corpus's relations: read once per application and state of the input, written, and shared by all queries."""
    key = _state(spark, sf_dir)
    if key not in _packed:
        packed, seen = counted(extract(files(spark, sf_dir)), f"corpus{len(_packed)}")
        _packed[key] = cut(packed, "packed"), seen
    return Relations(_packed[key][0])


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """The application, and what the input is now: a table that is written anew under its path is another one."""
    files = table(spark, sf_dir, "part").select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    sums = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file_path", "file_modification_time"))).first()
    return (spark.sparkContext.applicationId, sf_dir, *sums)


def counts(spark: SparkSession, sf_dir: str) -> dict:
    """What the extraction of the corpus counted on its way."""
    relations(spark, sf_dir)
    return _packed[_state(spark, sf_dir)][1].get


def _special(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("if", "(if test then else)", "Chooses."), ("do", "(do exprs*)", "")], "name string, usage string, doc string")


_CTE = "with part_links as (select *, " + ", ".join(f"(k * {step}) % n + 1 as {link}" for link, step in LINKS.items()) + " from (select p_partkey as k, p_name as name, p_size as size, (select max(p_partkey) from part) as n from part))\n"


def _span(line: int, before: str, token: str, names: str = "sl, sc, el, ec") -> str:
    sl, sc, el, ec = names.split(", ")
    return f"{line} as {sl}, cast(length({_sql(before)}) as int) as {sc}, {line} as {el}, cast(length({_sql(before + token)}) as int) as {ec}"


FILE = "src/p/n{k}.clj"
H_LINE = LINES[8]


def _before(line: str, token: str, nth: int = 1) -> str:
    """What stands before the n-th place of a token in a template line."""
    at = -1
    for _ in range(nth):
        at = line.index(token, at + 1)
    return line[:at]


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the corpus."""
    rows = relations(spark, sf_dir).symbols.where("source_kind = 'project'")
    return flat(rows, "fqn", "kind", "file", F.array_join("params", " ").alias("params"), F.coalesce("doc", F.lit("")).alias("doc"), span="name_range")


# name, kind, line, text before it, params, doc, where
_DEFINED = [
    ("f{k}", "Defn", 5, "(defn ", "[x y]", "Part {name}.", "true"),
    ("g{k}", "Def", 7, "(def ", "", "", "true"),
    ("h{k}", "Defn", 8, "(defn ", "[x] [x z]", "", "true"),
    ("k{k}", "Def", 11, "(def ", "", "", "k % 3 <> 0"),
    ("P{k}", "Defprotocol", 11, "(defprotocol ", "", "", "k % 3 = 0"),
    ("m{k}", "Defn", 11, "(defprotocol P{k} (", "[this]", "Doc {k}.", "k % 3 = 0"),
]
SYMBOLS_SQL = _CTE + " union all ".join(
    f"select {_sql('p.n{k}/' + name)} as fqn, '{kind}' as kind, {_sql(FILE)} as file, '{params}' as params, {_sql(doc)} as doc, {_span(line, before, name)} from part_links where {where}"
    for name, kind, line, before, params, doc, where in _DEFINED
)


def code_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resolved usage of the corpus, those in discarded forms marked."""
    return flat(relations(spark, sf_dir).occurrences.where("source_kind = 'project'"), "fqn", "file", "discarded", span="name_range")


# full name, line, text before the token, token, where
_USED = [
    ("p.n{b}/f{b}", 2, _before(LINES[2], "f{b}"), "f{b}", "true"),
    ("p.n{a}/g{a}", 6, _before(LINES[6], "g{a}"), "g{a}", "true"),
    ("p.n{b}/f{b}", 6, _before(LINES[6], "f{b}"), "f{b}", "true"),
    ("p.n{k}/h{k}", 8, _before(H_LINE, "h{k}", 2), "h{k}", "true"),
    ("clojure.core/let", 8, _before(H_LINE, "let"), "let", "true"),
    ("clojure.core/inc", 8, _before(H_LINE, "inc"), "inc", "true"),
    ("clojure.core/*", 8, _before(H_LINE, "*"), "*", "true"),
    ("n{d}/g{d}", 8, _before(H_LINE, "g{d}"), "g{d}", "true"),
    ("p.n{k}/g{k}", 8, _before(H_LINE, "g{k}"), "g{k}", "true"),
    ("clojure.core/comment", 10, "(", "comment", "true"),
    ("p.n{k}/f{k}", 10, _before(LINES[10], "f{k}"), "f{k}", "true"),
    ("p.n{c}/g{c}", 11, _before(USES, "g{c}"), "g{c}", "k % 3 <> 0"),
    (":p.n{k}/t{k}", 11, _before(USES, "::t{k}"), "::t{k}", "k % 3 <> 0"),
]
_USES_SQL = " union all ".join(f"select k, {_sql(fqn)} as fqn, {_sql(FILE)} as file, false as discarded, {_span(line, before, token)} from part_links where {where}" for fqn, line, before, token, where in _USED)
OCCURRENCES_SQL = _CTE + f"select * exclude (k) from ({_USES_SQL} union all select k, 'old/thing', {_sql(FILE)}, true, 9, 7, 9, 12 from part_links)"


def code_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespace rows: aliases, refers and requires as text."""
    flat_map = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    rows = relations(spark, sf_dir).namespaces.where("source_kind = 'project'")
    return rows.select("file", "name", flat_map("aliases").alias("aliases"), flat_map("refers").alias("refers"), F.array_join("requires", ",").alias("requires"))


NAMESPACES_SQL = _CTE + f"select {_sql(FILE)} as file, {_sql('p.n{k}')} as name, {_sql('a=p.n{a},b=p.n{b},c=p.n{c}')} as aliases, {_sql('f{b}=p.n{b}/f{b}')} as refers, {_sql('p.n{a},p.n{b},p.n{c}')} as requires from part_links"


def code_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved, unused and doubled requires of the corpus."""
    r = relations(spark, sf_dir)
    return flat(requires.diagnostics(r.qualified, r.namespaces, r.libspecs, r.used_prefixes, r.bare), "file", "code", "message")


DIAGNOSTICS_SQL = _CTE + f"""
select {_sql(FILE)} as file, 'unresolved-namespace' as code, {_sql('Unresolved namespace `n{d}`')} as message, {_span(8, _before(H_LINE, 'n{d}/'), 'n{d}/g{d}')} from part_links
union all select {_sql(FILE)}, 'unused-namespace', {_sql('Unused require `p.n{c}`')}, {_span(3, _before(LINES[3], 'p.n{c}'), 'p.n{c}')} from part_links where k % 3 = 0 and c <> k
union all select {_sql(FILE)}, 'duplicate-require', {_sql('Duplicate require `p.n{b}`')}, {_span(2, _before(LINES[2], 'p.n{b}'), 'p.n{b}')} from part_links where b = a
union all select {_sql(FILE)}, 'duplicate-require', {_sql('Duplicate require `p.n{c}`')}, {_span(3, _before(LINES[3], 'p.n{c}'), 'p.n{c}')} from part_links where c in (a, b)
"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that queries ask about."""
    return parts(spark, sf_dir).where("k % 20 = 0")


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages and declarations of every twentieth part's value."""
    r = relations(spark, sf_dir)
    asked = _asked(spark, sf_dir).select(F.col("k").alias("qid"), _columns("p.n{k}/g{k}").alias("fqn"))
    return flat(references.references(asked, r.symbols, r.occurrences), "qid", "file", "is_declaration", span="name_range")


REFERENCES_SQL = _CTE + f"""
, uses as ({_USES_SQL}), asked as (select k as qid, {_sql('p.n{k}/g{k}')} as fqn from part_links where k % 20 = 0)
select qid, file, false as is_declaration, sl, sc, el, ec from asked join uses using (fqn)
union all select k, {_sql(FILE)}, true, {_span(7, '(def ', 'g{k}')} from part_links where k % 20 = 0
"""


def code_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of renames, and those refused: names that are taken, invalid or the core's."""
    r = relations(spark, sf_dir)
    base = _asked(spark, sf_dir)
    asked = base.select(F.col("k").alias("qid"), _columns("p.n{k}/g{k}").alias("fqn"), F.lit("fresh").alias("new_name"))
    for at, fqn, name in ((1, "p.n{k}/g{k}", "f{k}"), (2, "p.n{k}/g{k}", "1x"), (3, "clojure.core/comment", "c"), (4, "p.n{k}/none", "y"), (5, ":p.n{k}/t{k}", "z")):
        asked = asked.unionByName(base.select((F.col("k") + at * 10**9).alias("qid"), _columns(fqn).alias("fqn"), _columns(name).alias("new_name")))
    edits, refused = references.rename(asked, r.symbols, r.occurrences)
    done = flat(edits, "qid", "file", "new_text", F.lit(None).cast("string").alias("error"), span="name_range")
    return done.unionByName(refused.select("qid", F.lit(None).cast("string").alias("file"), F.col("new_name").alias("new_text"), "error", *[F.lit(-1).alias(c) for c in ("sl", "sc", "el", "ec")]))


_NO_SPAN = "-1 as sl, -1 as sc, -1 as el, -1 as ec"
RENAME_SQL = _CTE + f"""
, uses as ({_USES_SQL}), asked as (select k, {_sql('p.n{k}/g{k}')} as fqn from part_links where k % 20 = 0)
select asked.k as qid, file, 'fresh' as new_text, cast(null as varchar) as error, sl, sc, el, ec from asked join uses using (fqn)
union all select k, {_sql(FILE)}, 'fresh', null, {_span(7, '(def ', 'g{k}')} from part_links where k % 20 = 0
""" + "".join(
    f"union all select k + {at}000000000, null, {_sql(name)}, '{error}', {_NO_SPAN} from part_links where k % 20 = 0\n"
    for at, name, error in ((1, "f{k}", "already defined"), (2, "1x", "invalid name"), (3, "c", "core"), (4, "y", "unknown"), (5, "z", "keyword"))
)


def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over the corpus's definitions."""
    asked = spark.createDataFrame([(1, "g1"), (2, "f12"), (3, "m3"), (4, "P"), (5, "h7")], "qid int, query string")
    return search.search_symbols(relations(spark, sf_dir).symbols, asked).select("qid", F.col("tier").cast("int").alias("tier"), "fqn", F.col("position").cast("int").alias("position"))


SEARCH_SQL = _CTE + ", names as (" + " union all ".join(f"select {_sql('p.n{k}/' + d[0])} as fqn, {_sql(d[0])} as name from part_links where {d[6]}" for d in _DEFINED) + """), asked as (
  select * from (values (1, 'g1'), (2, 'f12'), (3, 'm3'), (4, 'P'), (5, 'h7')) as t(qid, query)
), scored as (
  select qid, fqn, name, case when lower(name) = lower(query) then 0 when starts_with(lower(name), lower(query)) then 1 when contains(lower(name), lower(query)) then 2
    when regexp_matches(lower(name), array_to_string(string_split(lower(query), ''), '.*')) then 3 end as tier from names, asked
)
select qid, tier, fqn, cast(position as int) as position from (select *, row_number() over (partition by qid order by tier, length(name), fqn) as position from scored where tier is not null) where position <= 128
"""


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in every twentieth part's file: (qid, file, line, ch, word, is_keyword, line_text)."""
    base, out = _asked(spark, sf_dir), None
    for at, (line, before, word, is_keyword, _) in enumerate(_PLACES):
        one = base.select(
            (F.col("k") * 10 + at).alias("qid"), _columns(FILE).alias("file"), F.lit(line).alias("line"), F.length(_columns(before)).alias("ch"),
            _columns(word).alias("word"), F.lit(is_keyword).alias("is_keyword"), _columns([*LINES, USES][line]).alias("line_text"), "k",
        )
        out = one if out is None else out.unionByName(one)
    return out.where("not is_keyword or k % 3 <> 0").drop("k")


# line, text before the cursor, word there, keyword?, the definition: (file, line, text before, token, via) or none
_PLACES = [
    (6, _before(LINES[6], "g{a}"), "a/g{a}", False, ("src/p/n{a}.clj", 7, "(def ", "g{a}", "definition")),
    (8, _before(H_LINE, "x g{k}"), "x", False, (FILE, 8, _before(H_LINE, "x (inc"), "x", "local")),
    (1, _before(LINES[1], "a]"), "a", False, ("src/p/n{a}.clj", 0, "", "", "namespace")),
    (1, _before(LINES[1], "p.n{a}"), "p.n{a}", False, ("src/p/n{a}.clj", 0, "", "", "namespace")),
    (11, _before(USES, "t{k}"), "t{k}", True, None),
    (10, "(", "comment", False, (CORE_FILE[0], 1, "(defmacro ", "comment", "definition")),
    (8, _before(H_LINE, "z)]"), "z", False, (FILE, 8, _before(H_LINE, "z] "), "z", "local")),
    (8, _before(H_LINE, "n{d}/"), "n{d}/g{d}", False, None),
]


def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to definitions: locals, names, aliases and namespaces, core names; keywords never to vars."""
    r = relations(spark, sf_dir)
    return flat(references.definitions(_cursors(spark, sf_dir), r, r.core_names, _special(spark)), "qid", "file", "via")


DEFINITIONS_SQL = _CTE + " union all ".join(
    f"select k * 10 + {at} as qid, {_sql(to[0])} as file, '{to[4]}' as via, {_span(to[1], to[2], to[3])} from part_links where k % 20 = 0" for at, (_, _, _, _, to) in enumerate(_PLACES) if to
)


def code_local_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of the inner local ``x`` of every twentieth part, its declaration included."""
    r = relations(spark, sf_dir)
    return flat(references.local_references(_cursors(spark, sf_dir).where("pmod(qid, 10) = 1"), r.bindings, r.tokens), "qid", "name", span="name_range")


LOCAL_SQL = _CTE + " union all ".join(
    f"select k * 10 + 1 as qid, 'x' as name, {_span(8, before, 'x')} from part_links where k % 20 = 0" for before in (_before(H_LINE, "x (inc"), _before(H_LINE, "x z)]"), _before(H_LINE, "x g{k}"))
)


def code_local_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locals visible in the body of every twentieth part's last arity, each once."""
    asked = _cursors(spark, sf_dir).where("pmod(qid, 10) = 1").withColumn("prefix", F.lit(""))
    return flat(references.local_completions(asked, relations(spark, sf_dir).bindings), "qid", "name", span="name_range")


LOCAL_COMPLETIONS_SQL = _CTE + " union all ".join(
    f"select k * 10 + 1 as qid, '{name}' as name, {_span(8, before, name)} from part_links where k % 20 = 0" for name, before in (("x", _before(H_LINE, "x (inc")), ("w", _before(H_LINE, "w (*")), ("z", _before(H_LINE, "z] ")))
)


def _unresolved(spark: SparkSession, sf_dir: str) -> tuple[Relations, DataFrame]:
    r = relations(spark, sf_dir)
    asked = r.qualified.select("file", "prefix", "name").distinct().withColumn("qid", F.concat_ws("/", "file", "prefix", "name"))
    return r, requires.candidates(asked, r.namespaces, r.symbols, requires.alias_table(spark))


def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces that could be required for the unresolved names of each file."""
    return _unresolved(spark, sf_dir)[1].select("file", "namespace", "alias", F.col("rank").cast("int").alias("rank"), F.col("position").cast("int").alias("position"))


CANDIDATES_SQL = _CTE + f"select {_sql(FILE)} as file, {_sql('p.n{d}')} as namespace, {_sql('n{d}')} as alias, 2 as rank, 1 as position from part_links where d <> k"


def code_require_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the candidates' specs go, and their text."""
    r, found = _unresolved(spark, sf_dir)
    return requires.require_edits(found, r.libspecs, r.ns_forms).select("file", "line", "ch", "new_text")


REQUIRE_EDITS_SQL = _CTE + f"select {_sql(FILE)} as file, 3 as line, cast(length({_sql(LINES[3][:-2])}) as int) as ch, chr(10) || repeat(' ', 12) || {_sql('[p.n{d} :as n{d}]')} as new_text from part_links where d <> k"


def code_clean_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses rewritten without the specs that nothing uses."""
    r = relations(spark, sf_dir)
    done = requires.clean_namespaces(r.libspecs, r.namespaces, r.used_prefixes, r.bare)
    return done.select("file", "removes_clause", F.array_join(F.col("start").cast("array<string>"), ":").alias("start"), F.array_join(F.col("stop").cast("array<string>"), ":").alias("stop"), "new_text")


CLEAN_SQL = _CTE + f"""
select {_sql(FILE)} as file, false as removes_clause, '1:11' as "start", '3:' || length({_sql(LINES[3][:-2])}) as stop,
  {_sql(' [p.n{a} :as a]')} || chr(10) || {_sql(LINES[2])} as new_text from part_links where k % 3 = 0 and c <> k
"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, out = _asked(spark, sf_dir), None
    for at, (word, _, _) in enumerate(_WORDS):
        one = base.select((F.col("k") * 10 + at).alias("qid"), _columns(word).alias("word"), _columns("p.n{k}").alias("ns"))
        out = one if out is None else out.unionByName(one)
    return out


_WORDS = [
    ("a/g{a}", "p.n{a}/g{a}", "definition"), ("f{b}", "p.n{b}/f{b}", "definition"), ("g{k}", "p.n{k}/g{k}", "definition"), ("if", "if", "special"), ("comment", "clojure.core/comment", "core"),
    ("nowhere", None, None), ("p.n{d}/h{d}", "p.n{d}/h{d}", "definition"), ("t{k}", None, None),
]


def code_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to definitions by the order of precedence: one row for each."""
    r = relations(spark, sf_dir)
    return resolve.resolve(_words(spark, sf_dir), r.namespaces, r.symbols, r.core_names, _special(spark)).select("qid", "word", "fqn", "origin")


RESOLVE_SQL = _CTE + " union all ".join(
    f"select k * 10 + {at} as qid, {_sql(word)} as word, {_sql(fqn) if fqn else 'null'} as fqn, {repr(origin) if origin else 'null'} as origin from part_links where k % 20 = 0" for at, (word, fqn, origin) in enumerate(_WORDS)
)


def code_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees over words."""
    r = relations(spark, sf_dir)
    return resolve.hover(_words(spark, sf_dir), r.namespaces, r.symbols, r.core_names, _special(spark))


def _card(signature: str, label: str, doc: str = "") -> str:
    shown = f"'```clojure' || chr(10) || {_sql(signature)} || chr(10) || '```' || chr(10) || {_sql('*' + label + '*')} || chr(10)"
    return shown + (f" || chr(10) || {_sql(doc)}" if doc else "")


_CARDS = [
    _card("(def g{a})", "p.n{a}"), None, _card("(def g{k})", "p.n{k}"), _card("(if test then else)", "special form", "Chooses."),
    _card("(defmacro comment [& body])", "clojure.core"), "null", _card("(defn h{d} [x] [x z])", "p.n{d}"), "null",
]
_CARDS[1] = "'```clojure' || chr(10) || " + _sql("(defn f{b} [x y])") + " || chr(10) || '```' || chr(10) || " + _sql("*p.n{b}*") + " || chr(10) || chr(10) || 'Part ' || (select p_name from part where p_partkey = b) || '.'"
HOVER_SQL = _CTE + " union all ".join(f"select k * 10 + {at} as qid, {_sql(_WORDS[at][0])} as word, {text} as text from part_links where k % 20 = 0" for at, text in enumerate(_CARDS))


# What is typed in every twentieth part's namespace; the last one stands at the place of a local.
_TYPED = ["a/g", "h{k}", "f{b}", "sl", "i", "b", "p.n{k}", "Part{k}", "host.Box{k}/s", "zn{k}", "w"]


def _host_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host class for each part, with a static method, a static field and a method of its instances."""
    rows = parts(spark, sf_dir)
    spelled = [("Box{k}", "class", False), ("size{k}", "method", True), ("spare", "field", True), ("start", "method", False)]
    texts = F.lit(None).cast("array<string>")
    out = None
    for line, (name, kind, static) in enumerate(spelled):
        span = F.struct(F.lit(line).alias("start_line"), F.lit(0).alias("start_char"), F.lit(line).alias("end_line"), F.length(_columns(name)).alias("end_char"))
        one = rows.select(
            _columns("host.Box{k}").alias("class"), _columns(name).alias("name"), F.lit(kind).alias("kind"), F.lit(static).alias("is_static"), F.lit("(int n)" if kind == "method" else "").alias("params"),
            F.lit("int").alias("returns"), F.lit(None).cast("string").alias("doc"), texts.alias("extends"), texts.alias("implements"), _columns("host/Box{k}.java").alias("file"), span.alias("range"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def code_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that prefixes grow into, from all pools: own, referred, built-in, native, local, aliases, namespaces, classes, their members."""
    r, base = relations(spark, sf_dir), _asked(spark, sf_dir)
    typed = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), _columns(t).alias("prefix")) for at, t in enumerate(_TYPED)]))
    asked = base.select("k", _columns("p.n{k}").alias("ns"), typed.alias("t")).select((F.col("k") * 100 + F.col("t.at")).alias("qid"), "t.prefix", "ns")
    place = base.select((F.col("k") * 100 + 10).alias("qid"), _columns(FILE).alias("file"), F.lit(8).alias("line"), F.length(_columns(_before(H_LINE, "x g{k}"))).alias("ch"), F.lit("w").alias("prefix"))
    every = parts(spark, sf_dir)
    return completion.complete(
        asked, r.namespaces, r.symbols, r.core_names, _special(spark), classes=every.select(_columns("host.m{a}.Part{k}").alias("fqn")), members=_host_members(spark, sf_dir),
        visible_locals=references.local_completions(place, r.bindings), natives=every.select(_columns("zn{k}").alias("name")),
    )


COMPLETION_SQL = _CTE + f"""
, asked as (select * from part_links where k % 20 = 0),
classes as (select a.k, 'Part' || p.k as label, row_number() over (partition by a.k order by 'host.m' || p.a || '.Part' || p.k) as place from asked a join part_links p on starts_with('Part' || p.k, 'Part' || a.k))
select k * 100 as qid, 'alias member' as pool, {_sql('a/g{a}')} as label from asked
union all select a.k * 100 + 1, 'own', 'h' || a.k from asked a
union all select k * 100 + 2, 'refer', 'f' || b from asked
union all select k * 100 + 2, 'own', 'f' || k from asked where starts_with('f' || k, 'f' || b)
union all select k * 100 + 3, 'core', 'slurp' from asked
union all select k * 100 + 4, 'special', 'if' from asked
union all select k * 100 + 5, 'alias', 'b' from asked
union all select a.k * 100 + 6, 'namespace', 'p.n' || p.k from asked a join part_links p on starts_with('p.n' || p.k, 'p.n' || a.k)
union all select distinct k * 100 + 7, 'class', label from classes where place <= 50
union all select k * 100 + 8, 'static', 'host.Box' || k || '/' || m.name from asked, (values ('size'), ('spare')) as m(name) where m.name <> 'size'
union all select k * 100 + 8, 'static', 'host.Box' || k || '/size' || k from asked
union all select a.k * 100 + 9, 'native', 'zn' || p.k from asked a join part_links p on starts_with('zn' || p.k, 'zn' || a.k)
union all select k * 100 + 10, 'local', 'w' from asked
"""


def code_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discarded and comment forms."""
    return flat(relations(spark, sf_dir).ignored, "file")


IGNORED_SQL = _CTE + f"select {_sql(FILE)} as file, 9 as sl, 0 as sc, 9 as el, 15 as ec from part_links union all select {_sql(FILE)}, {_span(10, '', LINES[10])} from part_links"


def code_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of every twentieth part's file in order of the text, with their kinds' numbers."""
    asked = _asked(spark, sf_dir).select(_columns(FILE).alias("file"))
    rows = references.document_symbols(relations(spark, sf_dir).symbols, asked)
    return rows.select("file", "name", "kind", "symbol_kind", F.col("ordinal").cast("int").alias("ordinal"))


OUTLINE_SQL = _CTE + " union all ".join(
    f"select {_sql(FILE)} as file, {_sql(d[0])} as name, '{d[1]}' as kind, {number} as symbol_kind, {at} as ordinal from part_links where k % 20 = 0 and {d[6]}" for d, number, at in zip(_DEFINED, (12, 13, 12, 13, 11, 12), (0, 1, 2, 3, 3, 4), strict=True)
)


def code_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project and library definitions as one index."""
    symbols = relations(spark, sf_dir).symbols
    project = merge.last_write(symbols.where("source_kind = 'project'"))
    return merge.merge_libraries(project, symbols.where("source_kind <> 'project'")).select("fqn", "source_kind")


MERGE_SQL = _CTE + " union all ".join(f"select {_sql('p.n{k}/' + d[0])} as fqn, 'project' as source_kind from part_links where {d[6]}" for d in _DEFINED) + " union all select * from (values ('clojure.core/comment', 'dir'), ('clojure.core/format', 'dir'), ('clojure.core/slurp', 'dir')) as t"


def code_namespace_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that name namespaces, by alias or in full, to files."""
    base = _asked(spark, sf_dir)
    asked = base.select((F.col("k") * 10).alias("qid"), F.lit("a").alias("word"), _columns("p.n{k}").alias("ns")).unionByName(base.select((F.col("k") * 10 + 1).alias("qid"), _columns("p.n{d}").alias("word"), _columns("p.n{k}").alias("ns")))
    return resolve.namespace_location(asked, relations(spark, sf_dir).namespaces)


LOCATION_SQL = _CTE + f"select k * 10 as qid, 'a' as word, {_sql('p.n{a}')} as target, {_sql('src/p/n{a}.clj')} as file from part_links where k % 20 = 0 union all select k * 10 + 1, {_sql('p.n{d}')}, {_sql('p.n{d}')}, {_sql('src/p/n{d}.clj')} from part_links where k % 20 = 0"


def code_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arities of calls being typed in every twentieth part's file."""
    r = relations(spark, sf_dir)
    base, out = _asked(spark, sf_dir), None
    for at, text in enumerate(("(f{b} ", "(p.n{d}/h{d} 1 ", "(a/nope ", "(g{k} 1")):
        one = base.select((F.col("k") * 10 + at).alias("qid"), _columns("p.n{k}").alias("ns"), _columns(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    found = editing.signature_help(out, r.namespaces, r.symbols, r.core_names, _special(spark))
    return found.select("qid", "fqn", F.array_join("arities", " ").alias("arities"), "signature", "parameter")


SIGNATURES_SQL = _CTE + f"select k * 10 as qid, {_sql('p.n{b}/f{b}')} as fqn, '[x y]' as arities, 0 as signature, 0 as parameter from part_links where k % 20 = 0 union all select k * 10 + 1, {_sql('p.n{d}/h{d}')}, '[x] [x z]', 1, 1 from part_links where k % 20 = 0"

_TWINS = {
    code_symbols: SYMBOLS_SQL, code_occurrences: OCCURRENCES_SQL, code_namespaces: NAMESPACES_SQL, code_diagnostics: DIAGNOSTICS_SQL, code_references: REFERENCES_SQL, code_rename: RENAME_SQL,
    code_search: SEARCH_SQL, code_definitions: DEFINITIONS_SQL, code_local_references: LOCAL_SQL, code_local_completions: LOCAL_COMPLETIONS_SQL, code_candidates: CANDIDATES_SQL,
    code_require_edits: REQUIRE_EDITS_SQL, code_clean_namespaces: CLEAN_SQL, code_resolve: RESOLVE_SQL, code_hover: HOVER_SQL, code_completion: COMPLETION_SQL, code_ignored: IGNORED_SQL,
    code_outline: OUTLINE_SQL, code_merge: MERGE_SQL, code_namespace_location: LOCATION_SQL, code_signatures: SIGNATURES_SQL,
}
QUERIES = {f.__name__: f for f in _TWINS}
ORACLE = {f.__name__: sql for f, sql in _TWINS.items()}
