"""Plain versions of the operators: slow, direct, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    words = SPACE.findall(lower(text))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def near_classes(docs, percent):
    """id -> (set size, class) by comparing all pairs."""
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def removed_words(docs, width=50):
    """id -> (n_words, n_removed, kept text) with unique ids."""
    words = {i: SPACE.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def late_windows(words, doc, width=50):
    """Places of the document's windows that a smaller id holds too; ``words`` are id -> words."""
    held = {tuple(w[k : k + width]) for i, w in words.items() if i < doc for k in range(len(w) - width + 1)}
    return {k for k in range(len(words[doc]) - width + 1) if tuple(words[doc][k : k + width]) in held}


def page_templates(pages, hosts, least=3, share=0.2):
    """host -> (containers, texts) of the frequent classes, from whole occurrence vectors.

    ``pages`` are (id, host, nodes {path: times}, texts {(holder, key): times}, blocks [(holder, key)]); equal ids are copies.
    """
    out = {}
    for host in hosts:
        own = {i: p for i, *p in pages if p[0] == host}
        if len(own) < least:
            continue
        vectors, kinds, holder = {}, {}, {}
        for i, (_, nodes, texts, _) in own.items():
            for token, times in nodes.items():
                vectors.setdefault(token, {})[i] = times
                kinds[token] = "tag"
            for (where, token), times in texts.items():
                vectors.setdefault(token, {})[i] = times
                kinds[token], holder[token] = "text", where
        classes = {}
        for token, vector in vectors.items():
            if len(vector) >= max(least, share * len(own)):
                classes.setdefault(tuple(sorted(vector.items())), set()).add(token)
        tags, fixed = set(), set()
        for members in classes.values():
            if not any(kinds[t] == "tag" for t in members):
                continue
            tags |= {t for t in members if kinds[t] == "tag"}
            mine = {t for t in members if kinds[t] == "text"}
            for where in {holder[t] for t in mine}:
                rounds = set()
                for _, _, _, blocks in own.values():
                    seen = [k for h, k in blocks if h == where and k in mine]
                    if seen:
                        once = list(dict.fromkeys(seen))
                        rounds.add(tuple(once) if once * (len(seen) // len(once)) == seen else tuple(seen))
                if len(rounds) == 1:
                    fixed |= {t for t in mine if holder[t] == where}
        out[host] = (tags, fixed)
    return out


def item_hits(docs, items, width=10):
    """[(id, n_words, n_hit, item ids)] in order of docs."""
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, text in items:
        w = rule.findall(lower(text))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    out = []
    for i, text in docs:
        w, hit, found = rule.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found, key=lambda x: (x is not None, x or ""))))
    return out


def targets(sizes):
    """Source -> target: shares by weight 1, 2, 3, at most three times the size."""
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    left, done, free = sum(sizes.values()), {}, set(names)
    while free:
        over = {k for k in free if weight[k] * left / sum(weight[x] for x in free) > 3 * sizes[k]}
        if not over:
            break
        for k in over:
            done[k] = 3 * sizes[k]
        left -= sum(done[k] for k in over)
        free -= over
    return done | {k: weight[k] * left / sum(weight[x] for x in free) for k in free}


def text_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACE.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dups += line in seen
            seen.add(line)
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if count[r] > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)]


def base_secrets(text):
    """Comma-joined kind:start:end."""
    text = text or ""
    spans = []
    for k, (kind, rule, group, least) in enumerate((
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32),
    )):
        spans += [(m.start(), k, kind, m.end()) for m in re.finditer(rule, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
