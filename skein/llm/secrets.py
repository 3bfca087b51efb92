"""Secret scans by grammar inference.

Labelled credentials of each format (drawn by rule from the published shapes)
form a prefix tree whose statistically compatible states are merged (Hoeffding
test, red-blue order) into a probabilistic automaton. In every run of token
characters all automata are scored from every format's prefix, then from the
start and after each separator of what is left. The
longest stretch whose mean log-likelihood per character beats two backgrounds
of ordinary tokens (small letters, capitals) is a span. Base patterns are found
first and always stay; automata add spans that overlap none of them.

Offsets count code points; ends are exclusive. A base span is the whole match
of its pattern.

Defined results: a null or empty text has no spans; a row without id is
scanned like any other; repeated rows are reported each. Of formats that hit at
one place the longest stretch wins, then the likelier, then the later by name.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common

TRAIN = 250  # labelled credentials of each format
ALPHA = 0.01
SEEN = 40
SEED = 31
MARGIN = 0.1  # nats a character by which a format must beat the background
MASK = "[SECRET]"

# The base kinds and their patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST = 20  # characters of a span found by an automaton
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
_SEPARATED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]")
_STEMS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

_ALNUM = string.ascii_letters + string.digits
# Published credential shapes: (prefixes, alphabet, lengths).
FORMATS: dict[str, tuple[tuple[str, ...], str, tuple[int, ...]]] = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _ALNUM, (36,)),
    "gitlab": (("glpat-",), _ALNUM + "_-", (20,)),
    "slack": (("xoxb-", "xoxp-", "xoxa-"), string.digits + "-" + _ALNUM, (40, 48)),
    "stripe": (("sk_live_", "rk_live_", "sk_test_"), _ALNUM, (24, 32)),
    "google": (("AIza",), _ALNUM + "_-", (35,)),
    "npm": (("npm_",), _ALNUM, (36,)),
    "sendgrid": (("SG.",), _ALNUM + "_-", (66,)),
    "jwt": (("eyJhbGciOi", "eyJ0eXAiOi"), _ALNUM + "_-.", (80, 120)),
}


def labelled(kind: str, rows: int = TRAIN) -> list[str]:
    """Credentials of one format, drawn from its published shape."""
    prefixes, alphabet, lengths = FORMATS[kind]
    rng = random.Random(f"{SEED}:{kind}")
    return [rng.choice(prefixes) + "".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(rows)]


class Automaton:
    """A probabilistic automaton learned from a sample by state merging.

    States of the prefix tree are red (kept) or blue (a red state's successors);
    a blue state joins one of the red states from which its outgoing and stopping
    frequencies, and those of all states below, do not differ by more than
    Hoeffding's bound: the one that makes what follows it likeliest.
    """

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.stop: list[int] = [0]
        self.seen: list[int] = [0]
        for word in sample:
            state = 0
            self.seen[0] += 1
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.stop.append(0)
                    self.seen.append(0)
                self.count[state][c] = self.count[state].get(c, 0) + 1
                state = self.next[state][c]
                self.seen[state] += 1
            self.stop[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._normalise()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _closed(self, state: int, symbols: dict[str, int]) -> bool:
        """Is a symbol among these that the state should have shown? One seen ``SEEN`` times as often as it has symbols has shown them all."""
        return self.seen[state] >= SEEN * (len(self.count[state]) + 1) and any(c not in self.count[state] for c in symbols)

    def _compatible(self, one: int, two: int) -> bool:
        todo = [(one, two)]
        while todo:
            x, y = todo.pop()
            n, m = self.seen[x], self.seen[y]
            if not n or not m:
                continue
            if self._differ(self.stop[x], n, self.stop[y], m):
                return False
            if self._closed(x, self.next[y]) or self._closed(y, self.next[x]):
                return False
            for c in self.next[x].keys() | self.next[y].keys():
                if self._differ(self.count[x].get(c, 0), n, self.count[y].get(c, 0), m):
                    return False
            todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys() if self.next[x][c] != self.next[y][c]]
        return True

    def _fit(self, red: int, blue: int) -> float:
        """Log-probability of all that follows the blue state under the red one's smoothed frequencies."""
        total, symbols = 0.0, len(_ALNUM) + 5
        todo: list[tuple[int | None, int]] = [(red, blue)]
        while todo:
            x, y = todo.pop()
            known, size = (self.count[x], self.seen[x] + 0.5 * symbols) if x is not None else ({}, 0.5 * symbols)
            total += sum(n * math.log((known.get(c, 0) + 0.5) / size) for c, n in self.count[y].items())
            total += self.stop[y] * math.log(((self.stop[x] if x is not None else 0) + 0.5) / size)
            todo += [(self.next[x].get(c) if x is not None else None, t) for c, t in self.next[y].items() if t != y]
        return total

    def _fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            self.stop[x] += self.stop[y]
            self.seen[x] += self.seen[y]
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
            for c, t in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], t))
                else:
                    self.next[x][c] = t

    def _merge(self) -> None:
        red = [0]
        while True:
            inside = set(red)
            blue = [(s, c, t) for s in red for c, t in sorted(self.next[s].items()) if t not in inside]
            if not blue:
                break
            # The state with the most evidence first.
            s, c, t = max(blue, key=lambda e: self.seen[e[2]])
            # Of the states that a little evidence cannot tell apart, the one under which it is likeliest.
            match = max((r for r in red if self._compatible(r, t)), key=lambda r: self._fit(r, t), default=None)
            if match is None:
                red.append(t)
            else:
                self.next[s][c] = match
                self._fold(match, t)
        self.states = len(red)

    def _normalise(self) -> None:
        number: dict[int, int] = {0: 0}
        order = [0]
        for s in order:
            for t in self.next[s].values():
                if t not in number:
                    number[t] = len(number)
                    order.append(t)
        self.moves: list[dict[str, tuple[int, float]]] = []
        self.end: list[float] = []
        for s in order:
            total = sum(self.count[s].values()) + self.stop[s] + 1
            self.moves.append({c: (number[t], math.log((self.count[s].get(c, 0) + 1e-9) / total)) for c, t in self.next[s].items()})
            self.end.append(math.log((self.stop[s] + 0.05) / total))
        del self.next, self.count, self.stop, self.seen

    def likelihood(self, word: str) -> float:
        """Log-probability of a string; minus infinity if no path spells it."""
        state, total = 0, 0.0
        for c in word:
            move = self.moves[state].get(c)
            if move is None:
                return -math.inf
            state, total = move[0], total + move[1]
        return total + self.end[state]

    def longest(self, run: str, start: int, plain: list[dict[str, float]], ahead: dict[tuple[int, int], tuple[float, ...]]) -> tuple[int, float] | None:
        """End and gain of the longest stretch from ``start`` that beats all backgrounds.

        ``ahead`` holds the best gains still to come from a place and state of
        this run, so a walk ends as soon as nothing further can be accepted.
        """
        place, state, chain = start, 0, []
        while (place, state) not in ahead:
            chain.append((place, state))
            move = self.moves[state].get(run[place]) if place < len(run) else None
            if move is None:
                break
            place, state = place + 1, move[0]
        for place, state in reversed(chain):
            move = self.moves[state].get(run[place]) if place < len(run) else None
            stop = self.end[state]
            later = ahead[place + 1, move[0]] if move else ()
            ahead[place, state] = tuple(max(stop, move[1] - p[run[place]] - MARGIN + x) for p, x in zip(plain, later, strict=True)) if move else (stop,) * len(plain)
        place, state, found, gains = start, 0, None, [0.0] * len(plain)
        while all(g + x >= 0 for g, x in zip(gains, ahead[place, state], strict=True)):
            least = min(gains) + self.end[state]
            if place - start >= SHORTEST and least >= 0 and run[place - 1] not in ".=":
                found = place, least
            move = self.moves[state].get(run[place]) if place < len(run) else None
            if move is None:
                break
            gains = [g + move[1] - p[run[place]] - MARGIN for g, p in zip(gains, plain, strict=True)]
            place, state = place + 1, move[0]
        return found


class Grammar:
    """An automaton for each format, and a background of plain characters."""

    def __init__(self, formats: tuple[str, ...] = tuple(FORMATS)):
        self.automata = {kind: Automaton(labelled(kind)) for kind in formats}
        # Letters of running text outweigh the rest, so a format must explain a token's capitals, digits and prefix;
        # in names of constants capitals do.
        small, large = string.ascii_lowercase, string.ascii_uppercase
        rest = dict.fromkeys(string.digits, 0.1 / 10) | dict.fromkeys("+/_.=-", 0.07 / 6)
        weights = [dict.fromkeys(a, 0.75 / 26) | dict.fromkeys(b, 0.08 / 26) | rest for a, b in ((small, large), (large, small))]
        self.plain = [{c: math.log(p) for c, p in w.items()} for w in weights]
        self.prefixed = re.compile("|".join(f"(?={re.escape(p)})" for kind in formats for p in FORMATS[kind][0]) or r"(?!)")

    def best(self, token: str) -> tuple[str, float] | None:
        """The likeliest format of a candidate and its margin a character, if it beats the backgrounds enough."""
        background = max(sum(map(p.__getitem__, token)) for p in self.plain)
        found = max(((a.likelihood(token), kind) for kind, a in self.automata.items()), default=(-math.inf, ""))
        gain = (found[0] - background) / len(token)
        return (found[1], gain) if gain >= MARGIN else None

    def stretches(self, run: str) -> list[tuple[int, int, str]]:
        """(start, end, format) of the accepted stretches of a run, none over another: those at a prefix first."""
        found: list[tuple[int, int, str]] = []

        def walk(low: int, high: int, starts: re.Pattern) -> None:
            part, done, ahead = run[low:high], 0, {kind: {} for kind in self.automata}
            for at in (m.start() for m in starts.finditer(part)):
                if at < done:
                    continue  # inside what was accepted before
                hits = [(*hit, kind) for kind, a in self.automata.items() if (hit := a.longest(part, at, self.plain, ahead[kind]))]
                if hits:
                    done, _, kind = max(hits)
                    found.append((low + at, low + done, kind))

        walk(0, len(run), self.prefixed)
        for low, high in zip([0, *(e for _, e, _ in found)], [*(s for s, _, _ in found), len(run)], strict=True):
            if high - low >= SHORTEST:
                walk(low, high, _SEPARATED)
        return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def spans_of(text: str | None, grammar: Grammar) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base spans, and all spans as (start, end, kind) by start and then kind (base kinds first)."""
    if not text:
        return [], []
    base = base_spans(text)
    names = [*KINDS, *grammar.automata]
    found = list(base)
    taken = 0  # base spans before this one end before the run at hand
    for m in _CANDIDATE.finditer(text):
        while taken < len(base) and base[taken][2] <= m.start():
            taken += 1
        # What the base patterns leave of the run; spans of different kinds may overlap, so each end is compared.
        low, k = m.start(), taken
        while low < m.end():
            while k < len(base) and base[k][2] <= low:
                k += 1
            stop, after = (base[k][0], base[k][2]) if k < len(base) and base[k][0] < m.end() else (m.end(), m.end())
            if stop - low >= SHORTEST:
                found += [(low + a, names.index(kind), low + b) for a, b, kind in grammar.stretches(text[low:stop])]
            low = max(low, after)
            k += 1
    return base, [(s, e, names[k]) for s, k, e in sorted(found)]


def _scan(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for whole in batches:
            for batch in common.chunks(whole, "text"):
                base, every = [], []
                for text in batch.column(1).to_pylist():
                    own, found = spans_of(text, grammar)
                    base.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in own])
                    every.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])
        common.tidy()

    return run


def _mask(grammar: Grammar, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.chunks(whole, "text"):
                out = []
                for text in batch.column(place).to_pylist():
                    end, pieces = 0, []
                    for s, e, _ in spans_of(text, grammar)[1]:
                        if s >= end:
                            pieces += [text[end:s], MASK]
                        end = max(end, e)
                    out.append("".join([*pieces, text[end:]]) if end else text)
                yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))
        common.tidy()

    return run


_SPAN = "array<struct<start:long,end:long,kind:string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base spans, all spans."""
    common.extra(docs, ("doc_id", "text"))
    common.ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan(Grammar()), f"doc_id long, base {_SPAN}, spans {_SPAN}")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns; every span of ``text`` is replaced by a mark (overlaps by one)."""
    common.extra(docs, ("text",))
    common.ship(docs.sparkSession)
    return docs.mapInArrow(_mask(Grammar(), docs.columns.index("text")), docs.schema)


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    joined = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
