"""A tolerant reader for Clojure source text.

Text becomes forms with character offsets; nothing is ever rejected. Unclosed
brackets end at the end of the text and stray closers are passed over. Reader
discards stay beside a form's children (``gaps``) so positional code never
trips over them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_TOKEN = re.compile(
    r"""
    (?P<space>[\s,]+)
  | (?P<comment>;[^\n]*|\#![^\n]*)
  | (?P<regex>\#"(?:[^"\\]|\\.)*(?:"|\Z))
  | (?P<string>"(?:[^"\\]|\\.)*(?:"|\Z))
  | (?P<char>\\(?:newline|space|tab|return|backspace|formfeed|u[0-9a-fA-F]{4}|o[0-7]{1,3}|.|\Z))
  | (?P<open>\#\?@\(|\#\?\(|\#\(|\#\{|\#::?[^\s,()\[\]{}"]*\{|[(\[{])
  | (?P<close>[)\]}])
  | (?P<prefix>\#_|\#'|\#\^|\#=|~@|['`~@^])
  | (?P<tag>\#[^\s,()\[\]{}"';`~@^\\\#][^\s,()\[\]{}"';`~@^\\]*)
  | (?P<symbolic>\#\#\w*)
  | (?P<atom>[^\s,()\[\]{}";`~@^\\]+)
  | (?P<other>.)
    """,
    re.X | re.S,
)
_NUMBER = re.compile(r"[+-]?\d")
_CLOSED = re.compile(r'#?"(?:[^"\\]|\\.)*"', re.S)
BRACKETS = frozenset(["list", "vector", "map", "lambda", "set", "branches", "splice", "nsmap"])
_CLOSER = {"(": ")", "[": "]", "{": "}", "#(": ")", "#{": "}", "#?(": ")", "#?@(": ")"}
_BRACKET_KIND = {"(": "list", "[": "vector", "{": "map", "#(": "lambda", "#{": "set", "#?(": "branches", "#?@(": "splice"}
_PREFIX_KIND = {"#_": "discard", "#'": "var", "#^": "meta", "#=": "eval", "~@": "unsplice", "'": "quote", "`": "template", "~": "unquote", "@": "deref", "^": "meta"}


class Form:
    """One form: its kind, its span (metadata included), its own span, its parts, and whether the text closes it."""

    __slots__ = ("kind", "start", "end", "own", "kids", "gaps", "meta", "ns", "name", "ns_start", "name_start", "auto", "tag", "inside", "shut")

    def __init__(self, kind: str, start: int, end: int = -1):
        self.kind, self.start, self.end, self.own = kind, start, end, start
        self.kids: list[Form] = []
        self.gaps: list[Form] = []
        self.meta: list[Form] = []
        self.ns: str | None = None
        self.name = self.tag = ""
        self.ns_start = self.name_start = self.inside = start  # inside: the place after an opening bracket
        self.auto, self.shut = False, True

    def walk(self, gaps: bool = False) -> Iterator[Form]:
        """The form and all below it, in order of the text."""
        todo = [self]
        while todo:
            form = todo.pop()
            yield form
            below = form.kids + (form.gaps if gaps else [])
            if form.kind != "symbol":
                below = form.meta + below
            todo.extend(sorted(below, key=lambda f: -f.start))

    def bare(self) -> bool:
        return self.kind == "symbol" and self.ns is None

    def unfinished(self) -> list[Form]:
        """The forms around the end of the text that it does not close, from the outermost in."""
        out, form = [], self
        while form.kids:
            form = form.kids[-1]
            if not form.shut:
                out.append(form)
            elif form.kind in BRACKETS:
                break
        return out


class _Frame:
    __slots__ = ("form", "closer", "needs")

    def __init__(self, form: Form, closer: str, needs: int):
        self.form, self.closer, self.needs = form, closer, needs  # closer of a bracket, or forms that a prefix waits for


def read(text: str) -> Form:
    """The whole text as one form of kind ``file``."""
    root = Form("file", 0, len(text))
    stack = [_Frame(root, "", 0)]

    def give(form: Form) -> None:
        """Put a finished form in its place; prefixes that are then complete finish too."""
        while True:
            top = stack[-1]
            if form.kind == "discard":
                top.form.gaps.append(form)
                return
            top.form.kids.append(form)
            if not top.needs or len(top.form.kids) < top.needs:
                return
            stack.pop()
            form = _finish(top.form, form.end)

    def abandon() -> None:
        """A prefix without its form ends here."""
        frame = stack.pop()
        frame.form.end = max([frame.form.own + 1, *[k.end for k in frame.form.kids]])
        if frame.form.kind != "meta":
            give(frame.form)

    for m in _TOKEN.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "open":
            word = m[0]
            form = Form(_BRACKET_KIND.get(word, "nsmap"), start)
            form.inside = end
            if form.kind == "nsmap":
                form.auto = word.startswith("#::")
                form.tag = word[1:-1].lstrip(":")
            stack.append(_Frame(form, _CLOSER.get(word, "}"), 0))
        elif kind == "close":
            depth = next((k for k in range(len(stack) - 1, 0, -1) if not stack[k].needs), 0)
            if depth == 0 or stack[depth].closer != m[0]:
                # Close the nearest bracket of this shape if there is one, else pass over the stray closer.
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].closer == m[0]), 0)
                if depth == 0:
                    continue
            while len(stack) - 1 > depth:
                if stack[-1].needs:
                    abandon()
                else:
                    frame = stack.pop()
                    frame.form.end = start
                    give(frame.form)
            frame = stack.pop()
            frame.form.end = end
            give(frame.form)
        elif kind in ("prefix", "tag"):
            form = Form(_PREFIX_KIND[m[0]] if kind == "prefix" else "tagged", start)
            form.tag = "" if kind == "prefix" else m[0][1:]
            stack.append(_Frame(form, "", 2 if form.kind == "meta" else 1))
        else:
            give(_atom(kind, m[0], start, end))
    while len(stack) > 1:
        if stack[-1].needs:
            abandon()
        else:
            frame = stack.pop()
            frame.form.end, frame.form.shut = len(text), False
            give(frame.form)
    return root


def _finish(form: Form, end: int) -> Form:
    """A prefix form that has all its parts. Metadata goes to the form that carries it."""
    form.end = end
    if form.kind != "meta":
        return form
    target = form.kids[1]
    target.meta = [form.kids[0], *target.meta]
    target.start = form.start
    target.gaps = form.gaps + target.gaps
    return target


def _atom(kind: str, word: str, start: int, end: int) -> Form:
    if kind != "atom":
        form = Form({"symbolic": "number", "other": "unknown"}.get(kind, kind), start, end)
        form.shut = kind not in ("string", "regex") or _CLOSED.fullmatch(word) is not None
        return form
    if word[0] == ":":
        form = Form("keyword", start, end)
        form.auto = word.startswith("::")
        body = start + (2 if form.auto else 1)
        _split(form, word[body - start :], body)
        return form
    if _NUMBER.match(word):
        return Form("number", start, end)
    if word in ("nil", "true", "false"):
        return Form("constant", start, end)
    form = Form("symbol", start, end)
    _split(form, word, start)
    return form


def _split(form: Form, word: str, at: int) -> None:
    ns, slash, name = word.partition("/")
    if slash and ns and name:
        form.ns, form.name, form.ns_start, form.name_start = ns, name, at, at + len(ns) + 1
    else:
        form.name, form.name_start = word, at


class Lines:
    """Offsets to 0-based (line, UTF-16 column), and back."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.plain = text.isascii() or all(ord(c) < 0x10000 for c in text)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset) - 1
        begin = self.starts[line]
        return line, offset - begin if self.plain else utf16(self.text[begin:offset])

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        return (*self.at(start), *self.at(end))

    def offset(self, line: int, column: int) -> int:
        """The place of a position; beyond the end of a line means its end."""
        if line >= len(self.starts):
            return len(self.text)
        begin = self.starts[line]
        stop = self.starts[line + 1] - 1 if line + 1 < len(self.starts) else len(self.text)
        if self.plain:
            return min(begin + column, stop)
        while begin < stop and column > 0:
            column -= utf16(self.text[begin])
            begin += 1
        return begin


def utf16(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(c > "￿" for c in text)
