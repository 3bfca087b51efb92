"""Data notation: forms as plain Python values."""

from __future__ import annotations

import ast
from typing import Any

from skein.functions.reader import Form, read


class Name(str):
    """A symbol or keyword (keywords keep their colon)."""


def value(text: str, form: Form) -> Any:
    """A form's value; maps are dictionaries (keys that cannot be hashed are left out)."""
    if form.kind == "map":
        out = {}
        for key, item in zip(form.kids[::2], form.kids[1::2], strict=False):
            k = value(text, key)
            if not isinstance(k, (dict, list)):
                out[k] = value(text, item)
        return out
    if form.kind in ("vector", "list", "set"):
        return [value(text, k) for k in form.kids]
    if form.kind == "string":
        return _unescaped(text[form.own : form.end])
    if form.kind in ("symbol", "keyword"):
        return Name(text[form.own : form.end])
    if form.kind == "tagged":
        return value(text, form.kids[-1]) if form.kids else None
    return {"nil": None, "true": True, "false": False}.get(text[form.own : form.end], text[form.own : form.end])


def _unescaped(raw: str) -> str:
    try:
        return ast.literal_eval('"""' + raw[1:-1].replace('"""', '\\"\\"\\"') + ' """')[:-1]
    except (SyntaxError, ValueError):
        return raw[1:-1]


def parse(text: str) -> Any:
    """The first value of a text; none if there is none."""
    forms = read(text).kids
    return value(text, forms[0]) if forms else None


def values_after(text: str, keyword: str) -> list[Any]:
    """The vector that follows each such keyword, at any depth, wherever it stands (metadata and discards passed over)."""
    out = []
    for form in read(text).walk():
        for k, item in enumerate(form.kids):
            if item.kind == "keyword" and text[item.own : item.end] == keyword:
                after = next((x for x in form.kids[k + 1 :] if x.kind == "vector"), None)
                if after is not None:
                    out.append(value(text, after))
    return out
