"""The relational kernels over ordinary tables, each with the SQL that says the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import columns as C
from skein.functions.edits import fold
from skein.operators import intervals, merge, references, requires
from skein.operators.resolve import first_hit
from skein.operators.search import search
from skein.plans.session import ship, table
from skein.sources import projects
from skein.streaming.documents import settled

SEARCHES = ((1, "cold bolt"), (2, "co"), (3, "bolt"), (4, "cdbt"), (5, ""))


def search_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over part names: all four tiers, the best 128 of each query."""
    rows = table(spark, sf_dir, "part").select("p_name", F.format_string("%012d", F.col("p_partkey")).alias("key"))
    asked = spark.createDataFrame(list(SEARCHES), "qid int, query string")
    return search(rows, asked, "p_name", "key").select("qid", F.col("tier").cast("int").alias("tier"), "p_name", "key", F.col("position").cast("long").alias("position"))


SEARCH_SQL = f"""
with asked(qid, query) as (values {", ".join(f"({k}, '{q}')" for k, q in SEARCHES)}), scored as (
  select qid, p_name, printf('%012d', p_partkey) as key, case when query = '' then 3 when lower(p_name) = query then 0 when starts_with(lower(p_name), query) then 1
    when contains(lower(p_name), query) then 2 when regexp_matches(lower(p_name), '(?s)' || array_to_string(string_split(query, ''), '.*')) then 3 end as tier
  from part, asked
), ranked as (select *, row_number() over (partition by qid order by tier, strlen(p_name), key) as position from scored where tier is not null)
select qid, tier, p_name, key, position from ranked where position <= 128
"""


MANY_LIMIT = 10


def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many searches as there are parts: pieces of their long names, some with a character left out; the best ten of each."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_partkey").alias("long_name"))
    rows = part.select("long_name", F.format_string("%012d", F.col("p_partkey")).alias("key"))
    piece = F.substring("long_name", F.lit(1) + F.col("p_partkey") % 25, F.lit(2) + F.col("p_partkey") % 6)
    loose = F.concat(F.left(piece, F.lit(1)), F.substring(piece, F.lit(3), F.lit(9)))
    asked = part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 3 == 0, loose).otherwise(piece).alias("query"))
    return search(rows, asked, "long_name", "key", MANY_LIMIT).select("qid", F.col("tier").cast("int").alias("tier"), "key", F.col("position").cast("long").alias("position"))


MANY_SQL = f"""
with parts as (select p_partkey as qid, printf('%012d', p_partkey) as key, lower(concat_ws(' ', p_name, p_type, p_brand, p_partkey)) as name from part),
pieces as (select qid, substring(name, 1 + qid % 25, 2 + qid % 6) as piece from parts),
asked as (select qid, case when qid % 3 = 0 then substring(piece, 1, 1) || substring(piece, 3, 9) else piece end as query from pieces),
texts as (select distinct query from asked),
scored as (
  select query, name, key, case when query = '' then 3 when name = query then 0 when starts_with(name, query) then 1
    when contains(name, query) then 2 when regexp_matches(name, '(?s)' || array_to_string(string_split(query, ''), '.*')) then 3 end as tier
  from parts, texts
), ranked as (select *, row_number() over (partition by query order by tier, strlen(name), key) as position from scored where tier is not null)
select qid, tier, key, position from ranked join asked using (query) where position <= {MANY_LIMIT}
"""


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item of an order and supplier after the first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return merge.repeats(lines, ["l_orderkey", "l_suppkey"], ["l_linenumber"])


REPEATED_SQL = """
select l_orderkey, l_suppkey, l_linenumber from (
  select *, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber) as k from lineitem) where k > 1
"""


def best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of each supplier: the cheapest part it delivers, ties by key."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    best = merge.best_of(lines.join(parts, "l_partkey"), ["l_suppkey"], ["p_retailprice", "l_partkey"], ["l_partkey", "p_retailprice"])
    return best.select("l_suppkey", F.col("l_partkey").alias("part"), F.col("p_retailprice").alias("price"))


BEST_SQL = """
select l_suppkey, l_partkey as part, p_retailprice as price from (
  select l_suppkey, l_partkey, p_retailprice, row_number() over (partition by l_suppkey order by p_retailprice, l_partkey) as k
  from lineitem join part on p_partkey = l_partkey) where k = 1
"""


def unresolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders nobody placed, and labels without a document: references that nothing resolves."""
    left = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    other = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(other.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


UNRESOLVED_SQL = """
select 'customer' as kind, c_custkey as id from customer where c_custkey not in (select o_custkey from orders)
union all select 'document', doc_id from documents where doc_id not in (select doc_id from labels)
"""


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the same user follows up within an hour are dropped."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return settled(events, ["user_id"], "ts", "event_id", F.expr("interval 1 hour")).select("event_id", "user_id")


DEBOUNCE_SQL = """
select event_id, user_id from (select *, lead(ts) over (partition by user_id order by ts, event_id) as next_ts from events)
where next_ts is null or next_ts > ts + interval 1 hour
"""


def utf16_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in bytes, code points and UTF-16 units of whole texts with a character beyond the basic plane."""
    line = F.concat(F.lit("\U0001f600"), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    return docs.select("doc_id", C.utf16_length(F.col("line")).alias("units"), F.length("line").cast("long").alias("points"), F.octet_length("line").cast("long").alias("bytes"))


UTF16_SQL = """
select doc_id, length(line) + 1 as units, length(line) as points, strlen(line) as bytes
from (select doc_id, chr(128512) || coalesce(text, '') as line from documents)
"""


def precedence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which name a customer key resolves to: a supplier's, else a part's brand, else its nation's; the rule that hit."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rules = [
        ("supplier", "s_acctbal > 5000", "s_suppkey", "s_name", "c_custkey"), ("part", "p_size < 10", "p_partkey", "p_brand", "c_custkey"), ("nation", "true", "n_nationkey", "n_name", "c_nationkey"),
    ]
    known = None
    for name, rule, key, value, _ in rules:
        one = table(spark, sf_dir, name).where(rule).select(F.concat(F.lit(f"{name}:"), F.col(key)).alias("term"), F.col(value).alias("name"))
        known = one if known is None else known.unionByName(one)
    tries = F.array(*[F.struct(F.lit(k).alias("rank"), F.concat(F.lit(f"{name}:"), F.col(own)).alias("term")) for k, (name, _, _, _, own) in enumerate(rules)])
    return first_hit(asked, "c_custkey", tries, known).select("c_custkey", "hit.name", F.col("rank").cast("int").alias("rule"))


PRECEDENCE_SQL = """
select c_custkey, coalesce(s_name, p_brand, n_name) as name,
  case when s_name is not null then 0 when p_brand is not null then 1 when n_name is not null then 2 end as rule
from customer left join (select * from supplier where s_acctbal > 5000) on c_custkey = s_suppkey
left join (select * from part where p_size < 10) on c_custkey = p_partkey left join nation on c_nationkey = n_nationkey
"""


def _as_symbols(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(
        F.concat_ws("/", "p_brand", "p_name").alias("fqn"), F.col("p_brand").alias("ns"), F.col("p_name").alias("name"), F.lit(kind).alias("source_kind"),
        F.format_string("%012d", F.col("p_partkey")).alias("file"), F.col("p_size").alias("ordinal"),
    )


def library_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows join only where the project does not own their namespace; one row per name."""
    part = table(spark, sf_dir, "part")
    project = _as_symbols(part.where("p_partkey % 7 = 0 and p_size <= 25"), "project")
    library = _as_symbols(part.where("p_partkey % 7 <> 0"), "archive")
    return merge.merge_libraries(project, library).select("fqn", "source_kind", "file")


LIBRARY_SQL = """
with rows as (select p_brand || '/' || p_name as fqn, p_brand as ns, printf('%012d', p_partkey) as file, p_size as ordinal, p_partkey % 7 = 0 as mine from part),
project as (select * from rows where mine and ordinal <= 25),
library as (select *, row_number() over (partition by fqn order by file, ordinal) as k from rows where not mine and ns not in (select ns from project))
select fqn, 'project' as source_kind, file from project union all select fqn, 'archive', file from library where k = 1
"""


def rescan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newer snapshot of some customers' orders replaces the old; customers it lacks go, save the kept."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    fresh = orders.where("o_custkey % 3 = 0 and o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return merge.rescan(orders, fresh, orders.where("o_custkey % 5 = 0"), "o_custkey")


RESCAN_SQL = """
with fresh as (select o_orderkey, o_custkey, o_totalprice + 1 as o_totalprice from orders where o_custkey % 3 = 0 and o_orderkey % 2 = 0)
select o_orderkey, o_custkey, o_totalprice from orders where o_custkey % 5 = 0 and o_custkey not in (select o_custkey from fresh) union all select * from fresh
"""


def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return merge.first_of(events, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


LAST_SQL = """
select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) where k = 1
"""


def remove_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items of removed customers go together."""
    gone = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    orders = merge.remove_files(table(spark, sf_dir, "orders"), gone, "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


REMOVE_SQL = """
select l_orderkey, count(*) as n_lines from lineitem where l_orderkey in (
  select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 5)) group by l_orderkey
"""


def cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which archives must be read anew, and which cached rows hold: equal path, time and format."""
    part = table(spark, sf_dir, "part")
    archives = part.select(F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("mtime")).distinct()
    cached = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("mtime"), (F.col("p_partkey") % 4 + 7).cast("int").alias("version"), "p_partkey")
    stale, valid = merge.cache_plan(archives, cached, 10)
    return stale.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("read")).unionByName(valid.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("hold")))


CACHE_SQL = """
with archives as (select distinct p_name as path, p_size as mtime from part),
valid as (select p_name as path, p_size as mtime from part where p_partkey % 3 = 0 and p_partkey % 4 + 7 = 10)
select path, count(*) as n, 'read' as what from archives where (path, mtime) not in (select (path, mtime) from valid) group by path
union all select path, count(*), 'hold' from valid group by path
"""


def alias_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two regions also appear under second names."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    symbols = nations.select(F.concat_ws("/", "r_name", "n_name").alias("fqn"), F.col("r_name").alias("ns"), F.col("n_name").alias("name"))
    names = spark.createDataFrame([("ASIA", "EAST"), ("EUROPE", "WEST")], "ns string, other string")
    return merge.with_alias_copies(symbols, names)


ALIAS_SQL = """
with symbols as (select r_name || '/' || n_name as fqn, r_name as ns, n_name as name from nation join region on n_regionkey = r_regionkey)
select * from symbols union all
select other || '/' || name, other, name from symbols join (values ('ASIA', 'EAST'), ('EUROPE', 'WEST')) as t(ns, other) using (ns)
"""


def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings tables in one, the overlay first; targets without a kind drop after the merge."""
    part = table(spark, sf_dir, "part")
    base = part.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("macro")).agg(F.min("p_brand").alias("target"))
    overlay = part.where("p_partkey % 5 = 0").groupBy(F.col("p_name").alias("macro")).agg(F.max("p_brand").alias("target"))
    kinds = part.where("p_size > 20").groupBy(F.col("p_brand").alias("target")).agg(F.min("p_type").alias("kind"))
    return merge.overlay_settings(base, overlay, kinds)


OVERLAY_SQL = """
with base as (select p_name as macro, min(p_brand) as target from part where p_partkey % 2 = 0 group by 1),
overlay as (select p_name as macro, max(p_brand) as target from part where p_partkey % 5 = 0 group by 1),
kinds as (select p_brand as target, min(p_type) as kind from part where p_size > 20 group by 1)
select macro, target, kind from (select coalesce(o.macro, b.macro) as macro, coalesce(o.target, b.target) as target from base b full join overlay o on o.macro = b.macro) join kinds using (target)
"""


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view, the innermost of the user's day windows around it (the one begun last)."""
    events = table(spark, sf_dir, "events")
    windows = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("window"), F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("interval 1 day")).alias("to_ts"))
    views = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    day = 86_400
    met = intervals.meet(views, windows, ["user_id"], F.unix_timestamp("ts"), F.unix_timestamp("from_ts"), F.unix_timestamp("to_ts"), day).where("ts between from_ts and to_ts")
    return merge.first_of(met, ["event_id"], [F.col("from_ts").desc(), F.col("window").desc()]).select("event_id", "window")


INTERVAL_SQL = """
select event_id, win as "window" from (select v.event_id, w.event_id as win, row_number() over (partition by v.event_id order by w.ts desc, w.event_id desc) as k
  from events v join events w on v.user_id = w.user_id and v.event_type <> 'purchase' and w.event_type = 'purchase' and v.ts between w.ts and w.ts + interval 1 day) where k = 1
"""


def first_wins_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first walk over derived edges: each node as first met."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = suppliers.count()
    steps = F.array(F.struct(F.lit(0).alias("ord"), F.pmod(F.col("s_suppkey") * 2, F.lit(n)).alias("lib")), F.struct(F.lit(1).alias("ord"), F.pmod(F.col("s_suppkey") * 3 + 1, F.lit(n)).alias("lib")))
    edges = suppliers.select(F.col("s_suppkey").cast("string").alias("parent"), F.explode(steps).alias("e")).select("parent", "e.ord", F.col("e.lib").cast("string").alias("lib"))
    return projects.walk_dependencies(edges, "1").select("lib", F.col("depth").cast("int").alias("depth"))


WALK_SQL = """
with recursive edges as (select s_suppkey as a, s_suppkey * 2 % (select count(*) from supplier) as b from supplier
  union select s_suppkey, (s_suppkey * 3 + 1) % (select count(*) from supplier) from supplier),
walk(lib, depth) as (select b, 1 from edges where a = 1 union select b, depth + 1 from walk join edges on a = lib where depth < 24)
select cast(lib as varchar) as lib, min(depth) as depth from walk group by lib
"""


def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions of names, kinds, classes and addresses over part names; each holds for some parts and not for others."""
    k = F.col("p_partkey")
    pick = lambda *texts: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in texts]), F.pmod(k, F.lit(len(texts))).cast("int"))
    joined, number = F.replace("p_name", F.lit(" "), F.lit("")), k.cast("string")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.concat(F.lit("ns."), pick(F.initcap("p_name"), F.col("p_name"))).alias("p"), F.concat(pick("map->", "->", "1map->"), joined).alias("f"),
        F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t "))).alias("w"), F.concat(F.lit("/w x/ü/"), number, pick("+1.clj", "%.clj", "=.jar!/a b/c.clj")).alias("path"),
    )
    return parts.select(
        "p_partkey", C.is_interop(F.col("p")).alias("interop"), C.factory_type(F.col("f")).alias("factory"), C.normalized(F.col("w")).alias("spaced"), C.is_valid_name(F.col("f")).alias("valid"),
        C.is_internal(F.concat("p", pick(".impl", ".internal", ".implx", ""))).alias("internal"), C.simple_name(F.col("p")).alias("simple"), C.unquoted(F.concat(F.lit('"'), "p", pick('"', ""))).alias("unquoted"),
        C.artifact_path(F.lit("/m2"), F.lit("org.x"), F.col("f"), F.lit("1")).alias("artifact"), C.checkout_dir(F.lit("/home"), F.concat(F.lit("https://h/"), F.col("f"), F.lit(".git")), F.lit("v/1")).alias("checkout"),
        C.kind_allowed(F.lit("source"), pick("source.fix", "source", "sourcery")).alias("allowed"), C.entry_class(F.concat(pick("java.base/", "jdk.x/", ""), F.lit("java/util/Map"), number, pick(".java", ".txt"))).alias("class"),
        C.clean_javadoc(F.concat(F.lit("/** A "), "p", F.lit(".\n * Two. */"))).alias("javadoc"), C.path_uri(F.col("path")).alias("uri"), (C.uri_path(C.path_uri(F.col("path"))) == F.col("path")).alias("back"),
    )


NAMES_SQL = r"""
with named as (
  select p_partkey, p_partkey % 2 as two, p_partkey % 3 as three, p_partkey % 4 as four, replace(p_name, ' ', '') as joined, p_name,
    'ns.' || case when p_partkey % 2 = 0 then array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') else p_name end as p from part
), made as (select *, case three when 0 then 'map->' when 1 then '->' else '1map->' end || joined as f from named)
select p_partkey, two = 0 as interop, case when three < 2 then joined end as factory, p_name as spaced, three < 2 as valid, four < 2 as internal, substr(p, 4) as simple,
  case when two = 0 then p else '"' || p end as unquoted, '/m2/org/x/' || f || '/1/' || f || '-1.jar' as artifact, '/home/gitlibs/h/' || f || '/v_1' as checkout, three < 2 as allowed,
  case when two = 0 then 'java.util.Map' || p_partkey end as class, 'A ' || p || '.' || chr(10) || 'Two.' as javadoc,
  case when three = 2 then 'jar:' else '' end || 'file:///w%20x/%C3%BC/' || p_partkey || case three when 0 then '%2B1.clj' when 1 then '%25.clj' else '%3D.jar!/a%20b/c.clj' end as uri, true as back
from made
"""


def line_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before a place on the second line of each document, counted in UTF-16 units, behind a character of two."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("first\n"), F.lit("\U0001f600"), F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", C.line_prefix(F.col("text"), F.lit(1), F.lit(7)).alias("prefix"), C.line_prefix(F.col("text"), F.lit(0), F.lit(99)).alias("line"))


PREFIX_SQL = "select doc_id, chr(128512) || left(string_split(coalesce(text, ''), chr(10))[1], 5) as prefix, 'first' as line from documents"


@F.pandas_udf(T.StringType())
def _edited(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fold(t, [(0, 0, 0, 0, "<<"), (0, 0, 0, 2, ""), (0, 0, 0, 0, "\n"), (1, 0, 1, 0, ">>")]))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document after four edits, each placed in the outcome of the one before."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", _edited(F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))


EDITED_SQL = "select doc_id, length(coalesce(text, '')) + 3 as chars, sha256(chr(10) || '>>' || coalesce(text, '')) as sha256 from documents"


def token_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each benchmark item's first word in the benchmark's lines: an equi-join on the name."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("ordinal", "fqn"))
    occurrences = words.select(F.col("item_id").cast("string").alias("file"), "fqn", F.col("ordinal").alias("name_range"))
    asked = words.where("ordinal = 0").select(F.col("item_id").alias("qid"), "fqn")
    return references.references(asked, occurrences, occurrences, declarations=False).select("qid", "fqn", "file", F.col("name_range").cast("long").alias("place"))


REFERENCES_SQL = """
with words as (select item_id, unnest(string_split(text, ' ')) as fqn, generate_subscripts(string_split(text, ' '), 1) - 1 as place from benchmark)
select a.item_id as qid, fqn, cast(w.item_id as varchar) as file, w.place from words w join (select item_id, fqn from words where place = 0) a using (fqn)
"""


def candidate_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Require candidates over nations (names) in regions (namespaces): three sources, best rank, must define the name."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    low = F.concat(F.lit("geo."), F.lower("r_name"))
    symbols = nations.select(low.alias("ns"), F.col("n_name").alias("name"))
    none = F.create_map().cast("map<string,string>")
    namespaces = symbols.select(F.col("ns").alias("name")).distinct().select(F.concat("name", F.lit(".f")).alias("file"), "name", none.alias("aliases"), F.array().cast("array<string>").alias("requires"))
    usages = nations.select(F.col("n_nationkey").alias("qid"), F.lit("geo.asia.f").alias("file"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("r_name")).otherwise(low).alias("prefix"), F.col("n_name").alias("name"))
    aliases = spark.createDataFrame([("europe", "geo.europe")], "prefix string, namespace string")
    found = requires.candidates(usages, namespaces, symbols, aliases)
    return found.select("qid", "namespace", "alias", F.col("rank").cast("int").alias("rank"))


CANDIDATES_SQL = """
with n as (select n_nationkey as qid, n_name, lower(r_name) as r, 'geo.' || lower(r_name) as ns from nation join region on n_regionkey = r_regionkey)
select qid, ns as namespace, case when qid % 2 = 0 then r end as alias, case when qid % 2 = 1 then 1 when r = 'europe' then 0 else 2 end as rank from n where r <> 'asia'
"""

QUERIES = {f.__name__: f for f in (
    search_tiers, search_many, repeated_rows, best_rank, unresolved_keys, debounce, utf16_columns, precedence_chain, library_merge, rescan_merge, last_write,
    remove_files, cache_plan, alias_copies, settings_overlay, interval_containment, first_wins_walk, name_functions, line_prefixes, edited_documents, token_references, candidate_ranks,
)}

ORACLE = {
    "search_tiers": SEARCH_SQL, "search_many": MANY_SQL, "repeated_rows": REPEATED_SQL, "best_rank": BEST_SQL, "unresolved_keys": UNRESOLVED_SQL, "debounce": DEBOUNCE_SQL,
    "utf16_columns": UTF16_SQL, "precedence_chain": PRECEDENCE_SQL, "library_merge": LIBRARY_SQL, "rescan_merge": RESCAN_SQL, "last_write": LAST_SQL,
    "remove_files": REMOVE_SQL, "cache_plan": CACHE_SQL, "alias_copies": ALIAS_SQL, "settings_overlay": OVERLAY_SQL, "interval_containment": INTERVAL_SQL,
    "first_wins_walk": WALK_SQL, "name_functions": NAMES_SQL, "line_prefixes": PREFIX_SQL, "edited_documents": EDITED_SQL, "token_references": REFERENCES_SQL, "candidate_ranks": CANDIDATES_SQL,
}
