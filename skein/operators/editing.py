"""Help while typing: signatures, indentation, alias declarations, host members, and change routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.cursor import active_arity, call_at_udf, indent_udf, split_arities
from skein.functions.edn import parse
from skein.functions.facts import DEFINERS
from skein.operators.merge import first_of
from skein.operators.resolve import resolve
from skein.plans.session import ship

_ACTIVE = T.StructType([T.StructField("signature", T.IntegerType()), T.StructField("parameter", T.IntegerType())])


@F.pandas_udf(_ACTIVE)
def _active(arities: pd.Series, argument: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([active_arity(list(a), int(k)) for a, k in zip(arities, argument, strict=True)], columns=["signature", "parameter"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _arities(params: pd.Series) -> pd.Series:
    return params.map(lambda p: split_arities(p or ""))


def signature_help(cursors: DataFrame, namespaces: DataFrame, symbols: DataFrame, core: DataFrame, special: DataFrame) -> DataFrame:
    """(qid, ns, text before the cursor) to the called name's arities, and which arity and parameter is being typed.

    ``core`` has name, and may have params (a list of vectors as one text).
    """
    ship(cursors.sparkSession)
    called = cursors.withColumn("call", call_at_udf("text")).where("call.head is not null").select("qid", "ns", F.col("call.head").alias("word"), F.col("call.argument").alias("argument"))
    hit = resolve(called, namespaces, symbols, core, special)
    own = first_of(symbols.where("size(params) > 0"), ["fqn"], [F.col("ordinal")]).select("fqn", F.col("params").alias("own"))
    out = hit.join(own, "fqn", "left")
    if "params" in core.columns:
        out = out.join(F.broadcast(core.select(F.concat(F.lit("clojure.core/"), "name").alias("fqn"), _arities("params").alias("built"))), "fqn", "left").withColumn("own", F.coalesce("own", "built"))
    out = out.where(F.size(F.coalesce("own", F.array().cast("array<string>"))) > 0).withColumn("active", _active("own", "argument"))
    return out.select("qid", "fqn", F.col("own").alias("arities"), "active.signature", "active.parameter")


def format_lines(cursors: DataFrame) -> DataFrame:
    """(qid, text, before): the leading space of the line begun after ``before``, where it is not right yet.

    ``before`` is the text up to the line's start, ``text`` the line itself.
    """
    ship(cursors.sparkSession)
    own = F.length("text") - F.length(F.ltrim("text"))
    wanted = cursors.withColumn("indent", indent_udf("before")).where(F.col("indent").isNotNull() & (F.col("indent") != own))
    return wanted.select("qid", own.cast("int").alias("replaced"), F.repeat(F.lit(" "), F.col("indent")).alias("new_text"))


def on_alias_declaration(line: Column, word: Column) -> Column:
    """Does the line declare an alias that begins like the word?"""
    return F.exists(F.slice(F.split(line, ":as"), 2, 1 << 20), lambda after: F.startswith(F.ltrim(after), word))


def settings_rows(text: str) -> list[tuple[str, str]]:
    """``:lint-as`` of a settings text: (macro, target)."""
    top = parse(text)
    table = top.get(":lint-as") if isinstance(top, dict) else None
    return [(str(k), str(v)) for k, v in (table or {}).items()]


def settings(files: DataFrame) -> DataFrame:
    """Settings files (path, text) to their ``:lint-as`` entries: (path, macro, target)."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *entry) for path, text in zip(batch["path"], batch["text"], strict=True) for entry in settings_rows(text or "")]
            yield pd.DataFrame(rows, columns=["path", "macro", "target"])

    return files.select("path", "text").mapInPandas(run, "path string, macro string, target string")


def definer_kinds() -> list[tuple[str, str]]:
    """(target, kind) of every definer of the core namespace."""
    return [(f"clojure.core/{name}", kind) for name, kind in DEFINERS.items()]


def route_changes(changes: DataFrame) -> DataFrame:
    """(path, kind) to what a watched change asks for: read the file again, drop it, or rebuild more."""
    name = F.element_at(F.split("path", "/"), -1)
    manifest = name.isin("deps.edn", "lgx.edn", "project.clj", "bb.edn", "shadow-cljs.edn") | F.endswith("path", F.lit(".cp"))
    action = F.when(name.isin("config.edn", ".gitignore", ".ignore"), "rebuild").when(manifest, "libraries").when(F.col("kind") == "deleted", "remove").otherwise("extract")
    return changes.select("path", action.alias("action"))
