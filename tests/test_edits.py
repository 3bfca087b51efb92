"""The piece table against rebuilding the text at each edit."""

from __future__ import annotations

import random
import time

from skein.functions.edits import PIECE, Pieces, fold
from skein.functions.reader import Lines


def rebuilt(text, edits):
    for line, ch, to_line, to_ch, new in edits:
        if line < 0:
            text = new
            continue
        at = Lines(text)
        text = text[: at.offset(line, ch)] + new + text[at.offset(to_line, to_ch) :]
    return text


def test_edits_equal_rebuilding():
    rng = random.Random(1)
    letters = ["a", "b", "\n", "é", "\U0001f600", "xyz", "\r\n", " " * 30, "long" * 300]
    for size in (0, 3, 40, 3000):
        text = "".join(rng.choices(letters, k=size))
        edits = []
        for _ in range(150):
            a, b = sorted([(rng.randrange(12), rng.randrange(40)), (rng.randrange(12), rng.randrange(40))])
            if rng.random() < 0.1:
                a, b = b, a  # an end before its start
            edits.append((*a, *b, "".join(rng.choices(letters, k=rng.randrange(4)))))
            if rng.random() < 0.02:
                edits.append((-1, 0, 0, 0, "".join(rng.choices(letters, k=20))))
        assert fold(text, edits) == rebuilt(text, edits)


def test_places_beyond_the_text_mean_its_end():
    for text in ("", "one", "one\n", "one\ntwo", "é\U0001f600\nx"):
        for edit in ((0, 99, 0, 99, "!"), (9, 0, 9, 9, "!"), (1, 0, 1, 1, "!"), (0, 0, 99, 0, "")):
            assert fold(text, [edit]) == rebuilt(text, [edit])


def test_a_hundred_thousand_edits_on_a_megabyte():
    rng = random.Random(2)
    text = "".join("x" * rng.randrange(60) + "\n" for _ in range(33_000))
    edits = []
    for _ in range(100_000):
        line, ch = rng.randrange(33_000), rng.randrange(30)
        edits.append((line, ch, line, ch + rng.randrange(2), rng.choice(["y", "", "\n", "word"])))
    assert fold(text, edits[:300]) == rebuilt(text, edits[:300])
    times = []
    for n in (25_000, 100_000):
        began = time.process_time()
        pieces = Pieces(text)
        for e in edits[:n]:
            pieces.apply(e)
        times.append(time.process_time() - began)
    assert times[1] < 8 * max(times[0], 0.05)
    assert all(len(p) <= PIECE * 2 for b in pieces.blocks for p in b.pieces)


def test_typing_at_one_place_leaves_few_pieces():
    pieces = Pieces("(ns a)\n")
    for k in range(5000):
        pieces.apply((1, k, 1, k, "z"))
    assert pieces.text() == "(ns a)\n" + "z" * 5000 and sum(len(b.pieces) for b in pieces.blocks) < 20
