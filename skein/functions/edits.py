"""Edits of a text by lines and UTF-16 columns, on a piece table.

The text is never rebuilt between edits: it is a run of pieces of fixed strings,
kept in blocks of bounded length with their sums of characters and line ends. An
edit finds its places by the sums, cuts pieces there and puts one in; the text
is joined once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Characters of a piece at most, pieces of a block at most.
PIECE, BLOCK = 1024, 32

Edit = tuple[int, int, int, int, str]


class _Block:
    """Pieces that follow each other, and their sums."""

    __slots__ = ("chars", "lines", "pieces")

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.count()

    def count(self) -> None:
        self.chars = sum(map(len, self.pieces))
        self.lines = sum(p.count("\n") for p in self.pieces)


def _cut(text: str) -> list[str]:
    return [text[k : k + PIECE] for k in range(0, len(text), PIECE)]


class Pieces:
    """A text under edits; lines end with a newline, columns count UTF-16 units and stop at the line's end."""

    def __init__(self, text: str):
        self._load(text)

    def _load(self, text: str) -> None:
        pieces = _cut(text)
        self.blocks = [_Block(pieces[k : k + BLOCK]) for k in range(0, len(pieces), BLOCK)] or [_Block([])]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b.pieces)

    def _line_start(self, line: int) -> tuple[int, int, int] | None:
        """Block, piece and character where a line begins; none if there is no such line."""
        if line <= 0:
            return 0, 0, 0
        left = line
        for b, block in enumerate(self.blocks):
            if block.lines < left:
                left -= block.lines
                continue
            for p, piece in enumerate(block.pieces):
                here = piece.count("\n")
                if here < left:
                    left -= here
                    continue
                at = -1
                for _ in range(left):
                    at = piece.index("\n", at + 1)
                return b, p, at + 1
        return None

    def _place(self, line: int, ch: int) -> tuple[int, int, int]:
        """Block, piece and character of a position, kept inside the text and the line."""
        start = self._line_start(line)
        if start is None:
            return len(self.blocks) - 1, len(self.blocks[-1].pieces), 0
        b, p, c = start
        left = ch
        while b < len(self.blocks):
            pieces = self.blocks[b].pieces
            while p < len(pieces):
                piece = pieces[p]
                stop = piece.find("\n", c)
                end = len(piece) if stop < 0 else stop
                if piece.isascii():
                    if left <= end - c:
                        return b, p, c + max(left, 0)
                    left -= end - c
                else:
                    while c < end and left > 0:
                        left -= 2 if piece[c] > "\uffff" else 1
                        c += 1
                    if c < end or left <= 0 and c < len(piece):
                        return b, p, c
                if stop >= 0:
                    return b, p, stop
                p, c = p + 1, 0
            b, p = b + 1, 0
        return len(self.blocks) - 1, len(self.blocks[-1].pieces), 0

    def apply(self, edit: Edit) -> None:
        line, ch, to_line, to_ch, new = edit
        if line < 0:
            self._load(new or "")
            return
        b, p, c = self._place(line, ch)
        e, q, d = self._place(to_line, to_ch)
        if (e, q, d) < (b, p, c):  # the end stands before the start: nothing is taken out twice, what lies between doubles
            tail = self._from(e, q, d)
            head = self._until(b, p, c)
            self._load(head + (new or "") + tail)
            return
        first, last = self.blocks[b], self.blocks[e]
        before = first.pieces[:p] + ([first.pieces[p][:c]] if c else [])
        after = ([last.pieces[q][d:]] if q < len(last.pieces) else []) + last.pieces[q + 1 :]
        middle = _cut(new or "")
        # Neighbours that are short become one piece, so that many edits at one place do not pile up.
        while before and middle and len(before[-1]) + len(middle[0]) <= PIECE:
            middle[0] = before.pop() + middle[0]
        while after and middle and len(after[0]) + len(middle[-1]) <= PIECE:
            middle[-1] += after.pop(0)
        if not middle and before and after and len(before[-1]) + len(after[0]) <= PIECE:
            middle = [before.pop() + after.pop(0)]
        joined = before + middle + after
        size = BLOCK if len(joined) <= BLOCK else BLOCK // 2
        self.blocks[b : e + 1] = [_Block(joined[k : k + size]) for k in range(0, len(joined), size)]
        if not self.blocks:
            self.blocks = [_Block([])]

    def _until(self, b: int, p: int, c: int) -> str:
        parts = [x for block in self.blocks[:b] for x in block.pieces] + self.blocks[b].pieces[:p]
        return "".join(parts) + (self.blocks[b].pieces[p][:c] if c else "")

    def _from(self, b: int, p: int, c: int) -> str:
        own = self.blocks[b].pieces
        return (own[p][c:] if p < len(own) else "") + "".join(own[p + 1 :]) + "".join(x for block in self.blocks[b + 1 :] for x in block.pieces)


def fold(text: str, edits: Iterable[Edit]) -> str:
    """Edits (start, end, text) in order, each on the outcome of the one before; a full replacement has line -1."""
    edits = [tuple(e) for e in edits]
    # What comes before the last full replacement is gone.
    full = next((k for k in range(len(edits) - 1, -1, -1) if edits[k][0] < 0), None)
    if full is not None:
        text, edits = edits[full][4] or "", edits[full + 1 :]
    if not edits:
        return text
    pieces = Pieces(text)
    for e in edits:
        pieces.apply(e)
    return pieces.text()

