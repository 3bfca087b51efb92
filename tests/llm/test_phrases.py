"""Collocations: against plain counting, in small segments, on awkward rows, and against the query's SQL."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import phrases
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain_version(rows, least, widest=4, top=2000, covered=80):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, widest + 1):
                for s in range(len(words) - k + 1):
                    own[tuple(words[s : s + k])] += 1
    out = []
    for lang, own in counts.items():
        good = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        over = {}
        for p, a in good.items():
            for w in range(2, len(p)):
                for s in range(len(p) - w + 1):
                    over[p[s : s + w]] = max(over.get(p[s : s + w], 0), a)
        scored = []
        for p, a in good.items():
            if 100 * over.get(p, 0) >= covered * a:
                continue
            score, _, left, right = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, n, p.decode(), -a, left, right, totals[lang], -score) for n, (score, a, p, left, right) in enumerate(scored[:top], 1)]
    return sorted(out)


def found(table, *args, **named):
    return sorted(map(tuple, phrases.collocations(table, *args, **named).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def awkward():
    rng = random.Random(5)
    words = ["the", "The", "of", "É", "ñandú", "a-b", " ", " ", "x\x1cy", "\x00", "w" * 300]
    rows = [(None, None), ("en", ""), ("en", " \t\n.,;"), ("", "a b a b a b"), ("und", "p q"), (None, "p q"), ("de", "the of"), ("en", "z z z z z z z z"), ("zz", "." * 500)]
    for k in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\r\n", "!"]) for _ in range(rng.randint(0, 80)))
        rows += [(rng.choice(["en", "en", "de", None]), text)] * rng.choice([1, 1, 1, 3])
    rows.append(("en", " ".join(rng.choices(["of", "the", "a-b", "q"], k=5000))))
    return rows


@pytest.mark.parametrize(("least", "step", "top"), [(2, 64, 2000), (5, 4_000_000, 2000), (300, 1000, 3)])
def test_awkward_texts_equal_plain_counting(spark, least, step, top):
    rows = awkward()
    table = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit(1), "n": F.lit("x"), "k": F.lit(2), "block": F.lit(3), "score": F.lit(4)}).repartition(5)
    assert found(table, least, top=top, step=step) == plain_version(rows, least, top=top)


def test_a_level_without_frequent_phrases_and_empty_tables(spark):
    table = spark.createDataFrame([("en", "a b c d e f g")], "lang string, text string")
    assert found(table, 2) == [] and found(table.limit(0), 2) == []


def test_nothing_is_counted_that_the_bitmaps_exclude():
    """Buckets and Apriori let every frequent phrase through and keep most others away."""
    rng = np.random.default_rng(3)
    buckets = phrases.Buckets(30)
    often, seldom = rng.integers(0, 1 << phrases.BITS, 1000), rng.integers(0, 1 << phrases.BITS, 10_000)
    for _ in range(40):
        buckets.add(often)
    buckets.add(seldom)
    bits = np.packbits(buckets.counts >= 30)
    assert phrases._set(bits, often.astype(np.uint64)).all()
    assert phrases._set(bits, np.setdiff1d(seldom, often).astype(np.uint64)).sum() == 0


def test_segments_cover_each_window_once():
    rng = random.Random(9)
    text = " ".join(rng.choice(["a", "bb", "c.", "d" * 90]) for _ in range(700)).encode()
    whole = [w for w, _ in phrases.segments([text], 3, 10**9)][0]
    for width in (1, 2, 3):
        windows = []
        for words, old in phrases.segments([text], width, 50):
            start = max(0, old - width + 1)
            windows += [tuple(words[k : k + width]) for k in range(start, len(words) - width + 1)]
        assert windows == [tuple(whole[k : k + width]) for k in range(len(whole) - width + 1)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    wanted = con.sql(phrases.OP11_SQL).fetchall()
    assert found(spark.read.parquet(f"{SF}/documents.parquet")) == sorted(wanted) and wanted
