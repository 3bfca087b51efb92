"""Scalar functions as column expressions: names, ranges, paths, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an identifier besides letters and digits.
IDENT = r"\p{L}\p{N}*+!_?<>=/.'&%#-"


def subsequence(text: Column, query: Column) -> Column:
    """Do the query's characters occur in the text in this order?"""
    pattern = F.array_join(F.transform(F.filter(F.split(query, ""), lambda c: c != ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*")
    # A backslash-E inside a quoted character cannot occur: each quote holds one character.
    return F.rlike(text, F.concat(F.lit("(?s)"), pattern))


def match_tier(name: Column, query: Column) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 subsequence, null for none; an empty query matches all at 3."""
    n, q = F.lower(name), F.lower(query)
    return F.when(q == "", 3).when(n == q, 0).when(F.startswith(n, q), 1).when(F.contains(n, q), 2).when(F.contains(n, F.left(q, F.lit(1))) & subsequence(n, q), 3)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def point(line: Column, char: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), char.cast("int").alias("char"))


def starts(span: Column) -> Column:
    return point(span["start_line"], span["start_char"])


def ends(span: Column) -> Column:
    return point(span["end_line"], span["end_char"])


def holds(span: Column, at: Column) -> Column:
    """Is the position inside, both ends included?"""
    return (starts(span) <= at) & (at <= ends(span))


def is_interop(prefix: Column) -> Column:
    """A host class or the host's own namespace."""
    return (prefix == "js") | F.rlike(F.element_at(F.split(prefix, "[.]"), -1), F.lit(r"^\p{Lu}"))


def is_internal(ns: Column) -> Column:
    return F.endswith(ns, F.lit(".impl")) | F.endswith(ns, F.lit(".internal"))


def is_valid_name(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^(?![0-9])[" + IDENT.replace("/", "") + r"]+$"))


def factory_type(name: Column) -> Column:
    """Type that ``->T`` or ``map->T`` constructs; null for other names."""
    found = F.regexp_extract(name, r"^(?:map)?->(.+)$", 1)
    return F.when(found != "", found)


def is_map_factory(name: Column) -> Column:
    return F.startswith(name, F.lit("map->"))


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def kind_allowed(requested: Column, kind: Column) -> Column:
    """Is ``kind`` the requested one or below it (``source`` holds ``source.x``)?"""
    return (kind == requested) | F.startswith(kind, F.concat(requested, F.lit(".")))


def entry_class(entry: Column) -> Column:
    """Class of an archive entry ``[module/]a/b/C.java``; null for others."""
    found = F.regexp_extract(entry, r"^(?:java\.[^/]+/|jdk\.[^/]+/)?(.+)\.java$", 1)
    return F.when((found != "") & ~F.rlike(found, F.lit("(^|/)(package|module)-info$")), F.replace(found, F.lit("/"), F.lit(".")))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def clean_javadoc(comment: Column) -> Column:
    """The text of a documentation comment without its furniture."""
    body = F.regexp_replace(comment, r"^\s*/\*\*+|\*+/\s*$", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*+ ?", "")))
    return F.trim(F.array_join(F.filter(lines, lambda x: ~F.startswith(x, F.lit("@"))), "\n"))


def unquoted(text: Column) -> Column:
    """Without one pair of quotes around, nothing unescaped."""
    return F.when((F.length(text) >= 2) & F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"')), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def uri_path(uri: Column) -> Column:
    """``file:`` and ``jar:file:`` addresses as index paths; a plus sign means itself."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^(?:jar:)?file:/*(?=/)", ""), F.lit("+"), F.lit("%2B")))


def path_uri(path: Column) -> Column:
    """The address of an index path: what is no letter, digit or plain mark is coded, a blank as ``%20``."""
    coded = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.when(F.contains(path, F.lit("!/")), F.concat(F.lit("jar:file://"), F.replace(coded, F.lit("%21/"), F.lit("!/")))).otherwise(F.concat(F.lit("file://"), coded))


def line_prefix(text: Column, line: Column, ch: Column) -> Column:
    """What stands on a line before a UTF-16 column (the whole line where that is beyond it); null without such a line."""
    own = F.get(F.split(text, "\n", -1), line.cast("int"))
    return F.decode(F.substring(F.encode(own, "UTF-16BE"), F.lit(1), 2 * ch.cast("int")), "UTF-16BE")


def checkout_dir(home: Column, url: Column, ref: Column) -> Column:
    """Where a checkout of a repository address is kept."""
    return F.concat_ws("/", home, F.lit("gitlibs"), F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"\.git$", ""), F.replace(ref, F.lit("/"), F.lit("_")))


def artifact_path(repo: Column, group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws("/", repo, F.replace(group, F.lit("."), F.lit("/")), artifact, version, F.concat(artifact, F.lit("-"), version, F.lit(".jar")))


def kind_label(kind: Column) -> Column:
    """How a kind of definition is named to a reader."""
    # Kinds and their labels.
    labels = {"Def": "def", "Defonce": "defonce", "Defn": "defn", "DefnPrivate": "defn-", "Defmacro": "defmacro", "Defmulti": "defmulti", "Defmethod": "defmethod", "Defprotocol": "defprotocol", "Defrecord": "defrecord", "Deftype": "deftype", "IntegrantKey": "integrant key"}
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[kind]


def symbol_kind(kind: Column) -> Column:
    """Number of a kind in outlines and searches."""
    # Symbol kinds of the editor protocol.
    numbers = {"Defn": 12, "DefnPrivate": 12, "Defmacro": 12, "Defmulti": 12, "Def": 13, "Defonce": 13, "Defprotocol": 11, "Defrecord": 5, "Deftype": 5, "Defmethod": 6, "IntegrantKey": 20}
    return F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[kind]


def completion_kind(kind: Column) -> Column:
    """Number of a kind among completions; any other kind is a value."""
    # Completion kinds of the editor protocol.
    numbers = {"Defn": 3, "DefnPrivate": 3, "Defmacro": 3, "Def": 6, "Defonce": 6, "Defprotocol": 8, "Defrecord": 7, "Deftype": 7}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[kind], F.lit(12))


def _card(language: str, signature: Column, label: Column, doc: Column | None) -> Column:
    """A signature as code, what it is, and its documentation."""
    shown = F.concat(F.lit(f"```{language}\n"), signature, F.lit("\n```\n*"), label, F.lit("*\n"))
    return shown if doc is None else F.concat(shown, F.when(doc != "", F.concat(F.lit("\n"), doc)).otherwise(""))


def hover_definition(kind: Column, name: Column, params: Column, ns: Column, doc: Column) -> Column:
    words = F.concat_ws(" ", kind_label(kind), name, F.when(F.size(params) > 0, F.array_join(params, " ")))
    return _card("clojure", F.concat(F.lit("("), words, F.lit(")")), ns, doc)


def hover_built_in(name: Column, params: Column, label: Column, doc: Column) -> Column:
    return _card("clojure", F.concat(F.lit("("), F.concat_ws(" ", name, F.when(params != "", params)), F.lit(")")), label, doc)


def hover_special(usage: Column, doc: Column) -> Column:
    return _card("clojure", usage, F.lit("special form"), doc)


def hover_class(fqn: Column, extends: Column, implements: Column, doc: Column) -> Column:
    above = F.when(F.size(extends) > 0, F.concat(F.lit("extends "), F.array_join(extends, ", ")))
    with_ = F.when(F.size(implements) > 0, F.concat(F.lit("implements "), F.array_join(implements, ", ")))
    return _card("java", F.concat_ws(" ", F.lit("class"), fqn, above, with_), F.lit("java class"), doc)


def hover_member(fqn: Column, kind: Column, name: Column, is_static: Column, params: Column, returns: Column, doc: Column) -> Column:
    """A method, field or constructor of a host class; ``params`` comes with its brackets."""
    static = F.when(is_static, "static")
    method = F.concat_ws(" ", static, F.when(returns != "", returns).otherwise("void"), F.concat(name, params))
    field = F.concat_ws(" ", static, F.when(returns != "", returns), name)
    return _card("java", F.when(kind == "method", method).when(kind == "field", field).otherwise(F.concat(simple_name(fqn), params)), fqn, doc)
