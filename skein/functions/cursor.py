"""Functions of a text and a place in it: words, calls, indentation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.reader import BRACKETS, Lines, read, utf16

_IDENT = re.compile(r"[\w*+!_?<>=/.'&%#-]*")
_CALLS = ("list", "lambda")


def is_ident(char: str) -> bool:
    return bool(char) and _IDENT.fullmatch(char) is not None


def word_at(text: str, line: int, ch: int) -> tuple[str, bool]:
    """The identifier around a position (touching counts), and whether a colon stands before it."""
    lines = Lines(text)
    if line >= len(lines.starts):
        return "", False
    at = lines.offset(line, ch)
    start = at
    while start > lines.starts[line] and is_ident(text[start - 1]):
        start -= 1
    end = at
    while end < len(text) and is_ident(text[end]):
        end += 1
    return text[start:end], start > 0 and text[start - 1] == ":"


def call_at(text: str) -> tuple[str, int] | None:
    """Head of the innermost list that ``text`` leaves open, and the number of the argument that its end belongs to."""
    root = read(text)
    call = next((f for f in reversed(root.unfinished()) if f.kind in _CALLS), None)
    if call is None or not call.kids or call.kids[0].kind != "symbol":
        return None
    last = call.kids[-1]
    # Bracketed forms and strings end with their closer; any other form goes on while nothing follows it.
    closed = last.shut and last.kind in (*BRACKETS, "string", "regex")
    typing = last.end == len(text) and not closed or any(f.start >= last.start for f in root.unfinished())
    done = len(call.kids) - typing
    return (text[call.kids[0].own : call.kids[0].end], done - 1) if done else None


def split_params(arity: str) -> list[str]:
    """Parameters of a vector as written: patterns whole, hints with their parameter, ``&`` with the rest."""
    forms = read(arity).kids
    params = forms[0].kids if len(forms) == 1 and forms[0].kind == "vector" else forms
    rest = next((k for k, p in enumerate(params) if p.bare() and p.name == "&"), len(params))
    spans = [(p.start, p.end) for p in params[:rest]]
    if rest < len(params):
        spans.append((params[rest].start, params[-1].end))
    return [arity[a:b] for a, b in spans]


def split_arities(params: str) -> list[str]:
    """The vectors of ``([] [x] [x & more])``."""
    forms = read(params).kids
    inside = forms[0].kids if len(forms) == 1 and forms[0].kind == "list" else forms
    return [params[f.own : f.end] for f in inside if f.kind == "vector"]


def active_arity(arities: list[str], argument: int) -> tuple[int, int]:
    """The arity that an argument calls for and the parameter it falls on; beyond all arities, the last of either."""
    sizes = [(len(p), bool(p) and p[-1].startswith("&")) for p in map(split_params, arities)]
    fits = [k for k, (size, open_) in enumerate(sizes) if open_ or size > argument] or [len(sizes) - 1]
    return max(fits[0], 0), max(0, min(argument, sizes[fits[0]][0] - 1)) if sizes else 0


def indent_at(text: str) -> int | None:
    """Column for a new line at the end of ``text``: in line with the open form's content; none inside a string.

    A list that begins with a symbol indents its body by two, all others align with their first form.
    """
    around = read(text).unfinished()
    if any(f.kind in ("string", "regex") for f in around):
        return None
    if not around:
        return 0
    form = around[-1]
    column = Lines(text).at(form.inside)[1]
    return column + (form.kind in _CALLS and bool(form.kids) and form.kids[0].kind == "symbol" and not form.kids[0].meta)


_WORD_AT = T.StructType([T.StructField("word", T.StringType()), T.StructField("is_keyword", T.BooleanType())])
_CALL_AT = T.StructType([T.StructField("head", T.StringType()), T.StructField("argument", T.IntegerType())])


@F.pandas_udf(_WORD_AT)
def word_at_udf(text: pd.Series, line: pd.Series, ch: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_at(t or "", a, b) for t, a, b in zip(text, line, ch, strict=True)], columns=["word", "is_keyword"])


@F.pandas_udf(_CALL_AT)
def call_at_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([call_at(t or "") or (None, None) for t in text], columns=["head", "argument"]).astype({"argument": "Int32"})


@F.pandas_udf(T.IntegerType())
def indent_udf(text: pd.Series) -> pd.Series:
    return pd.Series([indent_at(t or "") for t in text], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_params_udf(arity: pd.Series) -> pd.Series:
    return arity.map(lambda a: split_params(a or ""))


__all__ = ["active_arity", "call_at", "call_at_udf", "indent_at", "indent_udf", "is_ident", "split_arities", "split_params", "split_params_udf", "utf16", "word_at", "word_at_udf"]
