"""Outline of a Java source file: the first top-level type and its members."""

from __future__ import annotations

import re

_NOISE = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+(\w+)(?:<[^{]*?>)?([^{]*)\{")
_MEMBER = re.compile(r"((?:\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|transient|volatile)\b\s+)*)(?:<[^>]+>\s*)?(?:([\w.$<>\[\],?& ]+?)\s+)?(\w+)\s*(\([^)]*\))?\s*(?:throws[^{;]+)?([{;=])", re.S)


def outline(text: str) -> dict | None:
    """Package, name, kind, supertypes, and members (name, kind, is_static, params, returns, doc, and the place of the name)."""
    plain = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    head = _TYPE.search(plain)
    if head is None:
        return None
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", plain)
    supers = {k: re.split(r"\s*,\s*", m[1].strip()) for k in ("extends", "implements") if (m := re.search(rf"\b{k}\s+([\w.$<>, ]+?)\s*(?=implements|permits|$)", head[3].strip()))}
    members, at, depth = [], head.end(), 1
    while at < len(plain) and depth:
        if plain[at] in "{}":
            depth += 1 if plain[at] == "{" else -1
            at += 1
            continue
        m = _MEMBER.match(plain, at) if depth == 1 and (plain[at].isalpha() or plain[at] in "@<_") else None
        if m is None or plain[at] == "@":
            at += 1
            continue
        modifiers, returns, name, params, end = m.groups()
        kind = "constructor" if params and not returns and name == head[2] else "method" if params and returns else "field" if returns and not params else None
        if kind and returns not in ("return", "new", "throw") and name not in ("class", "interface", "enum"):
            members.append({"name": name, "kind": kind, "is_static": "static" in modifiers.split(), "params": " ".join((params or "").split()), "returns": (returns or "").strip(), "doc": _doc_before(text, m.start()), "at": m.start(3)})
        at = m.end() - (end == "{")
    name = f"{package[1]}.{head[2]}" if package else head[2]
    return {"fqn": name, "kind": head[1], "extends": supers.get("extends", []), "implements": supers.get("implements", []), "members": members, "doc": _doc_before(text, head.start()), "name": head[2], "at": head.start(2)}


def _doc_before(text: str, at: int) -> str | None:
    """The documentation comment that ends before a place, annotations and modifiers aside."""
    end = text.rfind("*/", 0, at)
    if end < 0 or re.search(r"[;{}]", text[end + 2 : at]):
        return None
    start = text.rfind("/**", 0, end)
    return text[start : end + 2] if start >= 0 else None
