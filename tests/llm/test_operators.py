"""Each operator against a plain version, on awkward rows, and on empty tables."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, common, decontaminate, langid, mixing, neardup, pages, quality, queries, secrets, substrings, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, start long, bucket long, kept boolean"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, 4, True) for i, t, s in rows], DOCS)


def awkward(seed=3):
    """Nulls, empties, a very long text, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ñandú", "THE", "the"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = text(70), text(120)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", "b"), (5, "one two", "b"), (6, text(9000), "c"), (7, base, "a"), (8, base.upper(), "a")]
    for k in range(9, 40):
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((k, " ".join(words), "a"))
    rows += [(k, f"{text(rng.randint(0, 30))} {passage}\n{text(rng.randint(0, 60))}", "b") for k in range(40, 52)]
    rows += [(k, text(rng.randint(1, 90)), None) for k in range(52, 60)]
    rows += [rows[10], rows[10], (None, base, "a"), (None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).cache()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_all_pairs(docs, rows, percent):
    found = neardup.near_duplicates(docs, percent).collect()
    wanted = brute.near_classes([(i, t) for i, t, _ in rows], percent)
    assert len(found) == len(rows)
    text = dict((i, t) for i, t, _ in rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == wanted[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == len(brute.shingles(text[r["doc_id"]]))


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base), "a")]
    for k in range(1, 160):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            words[rng.randrange(150)] = f"y{rng.random()}"
        rows.append((k, " ".join(words), "a"))
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, rows), 85).collect()}
    assert found == brute.near_classes([(i, t) for i, t, _ in rows], 85)


def test_members_of_one_class_do_not_pair_up(spark):
    """A large class and a few strangers that share its rarest shingles: rows grow with the class, not its square."""
    met = {}
    for size in (200, 400):
        rows = [(token, 0, node, 20, 20 - token) for node in range(size) for token in range(10)]
        rows += [(token, 1000 + k, 1000 + k, 20, 20 - token) for k in range(4) for token in range(10)]
        prefix = spark.createDataFrame(rows, "token long, component long, node long, n long, rest long")
        pairs = neardup.across(prefix, 80)
        met[size] = pairs.count()
        assert pairs.distinct().count() == 4 * size + 6
    assert met[400] < 2.1 * met[200]


def test_prefixes_meet_every_similar_pair_of_different_components(spark):
    rng = random.Random(9)
    sets = {k: set(rng.sample(range(60), rng.randint(25, 50))) for k in range(60)}
    for k in range(60, 90):
        sets[k] = set(sorted(sets[k - 60])[rng.randint(0, 3) :]) | {1000 + k}
    component = {k: k % 7 for k in sets}
    rows = [(k, component[k], len(s), t) for k, s in sets.items() for t in s]
    prefix = neardup.prefixes(spark.createDataFrame(rows, "node long, component long, n long, token long"), 80)
    found = {(r["a"], r["b"]) for r in neardup.across(prefix, 80).collect()}
    wanted = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert wanted and wanted <= found


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert found == {k: 0 for k in range(1, 201)}


def test_substrings_equal_all_windows(spark):
    rows = [(i, t, s) for k, (i, t, s) in enumerate(awkward()) if i is not None]
    rows = list({i: (i, t, s) for i, t, s in rows}.values()) + [(None, rows[0][1], "a")]
    found = {r["doc_id"]: r for r in substrings.dedupe_substrings(docs_of(spark, rows).repartition(3)).collect()}
    wanted = brute.removed_words([(i, t) for i, t, _ in rows if i is not None])
    for i, (n, gone, kept) in wanted.items():
        spans = found[i]["spans"]
        assert (found[i]["n_words"], sum(s["stop"] - s["start"] for s in spans), found[i]["kept_text"]) == (n, gone, kept)
    assert found[None]["spans"] == []


def test_substrings_do_not_depend_on_batches(spark):
    rows = [(k, " ".join(f"p{j % 60}" for j in range(200 + k)), "a") for k in range(30)]
    wanted = {i: k for i, (_, _, k) in brute.removed_words([(i, t) for i, t, _ in rows]).items()}
    for docs, hot in ((docs_of(spark, rows).coalesce(1), 10**9), (docs_of(spark, rows).repartition(7), 10**9), (docs_of(spark, rows).repartition(7), 1)):
        assert {r["doc_id"]: r["kept_text"] for r in substrings.dedupe_substrings(docs, 1, hot).collect()} == wanted


def passages(seed=12):
    """Documents that share passages with each other, one of them with many different endings."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared, hot = [text(rng.randint(50, 160)) for _ in range(6)], text(70)
    rows = []
    for k in range(60):
        words = text(rng.randint(0, 40))
        for part in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, 20)
            words += part[cut:] + text(rng.randint(0, 8))
        rows.append((k, " ".join(words + hot + text(rng.randint(1, 60))), "a"))
    return rows


def test_factors_are_matches_that_reach_as_far_as_their_reference(spark):
    rows = passages()
    words = {i: t.split() for i, t, _ in rows}
    wanted = brute.removed_words([(i, t) for i, t, _ in rows])
    for docs, hot in ((docs_of(spark, rows).repartition(5), 10**9), (docs_of(spark, rows).repartition(5), 2)):
        for r in substrings.dedupe_substrings(docs, 1, hot).collect():
            own, end = words[r["doc_id"]], 0
            assert r["kept_text"] == wanted[r["doc_id"]][2]
            late = brute.late_windows(words, r["doc_id"])
            for f in r["factors"]:
                there = words[f["source"]][f["source_start"] :]
                size = f["stop"] - f["start"]
                assert f["source"] < r["doc_id"] and f["start"] >= end and own[f["start"] : f["stop"]] == there[:size]
                # Greedy: the first word that begins a factor does; between factors no window starts that has a reference.
                assert f["start"] in late and not any(k in late for k in range(end, f["start"]))
                end = f["stop"]
            assert not any(k in late for k in range(end, len(own)))


def test_a_greedy_parse_takes_the_factor_that_reaches_farthest():
    runs = [(0, 3, 7, 10), (3, 2, 7, 13), (4, 30, 8, 0), (60, 1, 9, 5)]
    factors = substrings.parse(200, runs)
    # Both runs of document 7 are one factor; the window at its end belongs to document 8, which goes on from there.
    assert factors == [(0, 54, 7, 10), (60, 110, 9, 5)]
    assert substrings.duplicate_spans(factors, runs) == [(0, 110)]  # windows 5 to 33 lie across the border
    assert substrings.parse(200, [(10, 5, 3, 0), (12, 20, 4, 2)]) == [(10, 64, 3, 0)]
    assert substrings.parse(10, []) == []


def test_hot_anchors_spread(spark):
    """Every ending of a hot passage meets under a key of its own."""
    rows = passages()
    hashes = common.WordHashes()
    listed = [(i, 0, t.encode()) for i, t, _ in rows]
    anchors = np.unique(substrings.Windows(listed, hashes).gram[substrings.Windows(listed, hashes).at])
    cold = substrings.blocks_of(listed, hashes, np.empty(0, np.uint64)).to_pandas()
    warm = substrings.blocks_of(listed, hashes, anchors).to_pandas()
    most = lambda d: d[d["hashes"].notna()].groupby("anchor").size().max()
    assert most(cold) > 20 and most(warm) == 1


def test_decontamination_equals_all_windows_in_one_and_many_blocks(spark, docs, rows):
    long_text = next(t for i, t, _ in rows if i == 6)
    words = long_text.split()
    items = [("a", " ".join(words[100:130])), ("b", " ".join(words[8000:8012]).upper()), ("c", "one two"), ("d", None), ("e", ""), (None, " ".join(words[500:512])), ("a", " ".join(words[700:712])), ("f", "!!")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, segment int")
    wanted = sorted(brute.item_hits([(i, t) for i, t, _ in rows], items), key=str)
    for block_words in (10**6, 8):
        found = decontaminate.decontaminate(docs, bench, block_words).collect()
        got = sorted(((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["stops"], strict=True)), r["items"]) for r in found), key=str)
        assert got == wanted


def test_blocks_keep_rows_of_one_id_and_length_apart(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "x"), (None, "a b c d e f g", "x"), (None, "q r s t u v w", "x"), (2, None, "x")]
    items = [("one", "a b c"), ("two", "h i j"), (None, "k l")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    wanted = sorted(brute.item_hits([(i, t) for i, t, _ in rows], items), key=str)
    for block_words in (10**6, 1):
        found = decontaminate.decontaminate(docs_of(spark, rows).repartition(2), bench, block_words).collect()
        assert sorted(((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["stops"], strict=True)), r["items"]) for r in found), key=str) == wanted


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    near = "alpha beta gamma so delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    found = decontaminate.decontaminate(docs_of(spark, [(1, near, "a"), (2, "alpha kappa", "a"), (3, item, "a")]), bench).collect()
    assert {r["doc_id"]: (r["items"], r["near_items"]) for r in found} == {1: ([], ["i"]), 2: ([], []), 3: (["i"], [])}


def test_chats_come_back(spark):
    odd = ["<|im_start|>", "<|im_end|>\n", "\\", "\\<|", "<\\|im_end|>", "", None, "a\nb", "é\U0001f600", "<|im_end|><|im_start|>assistant ok"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "<|im_end|>"]), rng.choice(odd)) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, example int, formatted string")
    examples = chat.format_chats(table)
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert back[conv]["losses"] == [x for _, r, x in own if r == "assistant"]
    for e in examples.collect():
        body = e["formatted"]
        assert body.count("<|im_end|>\n") == body.count("<|im_start|>")
        if e["loss_start"] is not None:
            assert body[e["loss_start"] + e["loss_length"] :] == "<|im_end|>\n"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    plain = lambda d: d[columns].astype(object).where(d[columns].notna(), None).astype(str)  # noqa: E731  nulls have several names
    order = lambda d: plain(d).sort_values(columns).reset_index(drop=True)
    assert order(found).equals(order(wanted))


HOST = "http://h.example/{}"
PAGE = """<html><head><title>T</title><script>if (a<b) {{ '</p>' }}</script></head><body><nav><a href="/x">Menu</a></nav>
<div class="notice">Accept cookies</div><div class="crumbs">Always the same line</div>{}<footer>&copy; h</footer></body></html>"""


def test_pages(spark):
    article = lambda k: f"<article><h1>Title&nbsp;{k}</h1><p>Caf&eacute; <b>bo</b>ld &amp; <i>x</i><br>line {k}<p>Next\n  one<ul><li>a<li>b</ul><aside>ad</aside><div class='comments'>no {k}</div></article>"
    rows = [(k, HOST.format(k), PAGE.format(article(k))) for k in range(5)]
    rows += [(10, None, None), (11, "", ""), (12, HOST.format(12), "no markup &lt;here"), (13, "http://other/", PAGE.format("<div id=main-text><p>Lone page</p></div>"))]
    rows += [(20 + k, f"http://plain.example/{k}", PAGE.format(f"<div class=body><p>Story {k} told once</p></div>")) for k in range(4)]
    rows += [rows[0], (None, HOST.format(99), PAGE.format("<article>unclosed <p>text"))]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, slots int")
    found = [(r["page_id"], r["text"]) for r in pages.extract_pages(table).collect()]
    assert len(found) == len(rows)
    text = dict(found)
    assert text[3] == "Title 3 Café bold & x line 3 Next one a b" and text[10] == "" and text[11] == ""
    assert text[12] == "no markup <here" and text[None] == "unclosed text"
    assert text[22] == "Story 2 told once"  # the line that all pages of the host repeat is the template's


def test_page_templates_keep_whole_articles(spark):
    page = lambda body, tail="": f"<html><body>{body}{tail}</body></html>"
    named = [(k, f"http://named/{k}", page(f"Site name<div class=story><p>Story {k}</div>")) for k in range(4)]
    copies = [(10 + k, f"http://copies/{k}", page(f"<div class=story><p>Story {min(k, 4) // 4}</div>")) for k in range(5)]
    parts = [(20 + k, f"http://parts/{k}", page(f"<div class=content><section>{'One ' * 40}{k}</section><section>{'Two ' * 40}{k}</section></div><div class=long>{'Long ' * 90}{k}</div>")) for k in range(4)]
    # An article that says the same on most pages is the template's; what varies is the text.
    walls = [(30 + k, f"http://walls/{k}", page("<article><p>Please log in</article>", f"<div class=story>Story {k}</div>")) for k in range(4)]
    table = spark.createDataFrame(named + copies + parts + walls, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in pages.extract_pages(table).collect()}
    assert [text[k] for k in range(4)] == [f"Story {k}" for k in range(4)]
    assert [text[10 + k] for k in range(5)] == ["Story 0"] * 4 + ["Story 1"]
    assert all(text[20 + k] == f"{'One ' * 40}{k} {'Two ' * 40}{k} {'Long ' * 90}{k}" for k in range(4))  # no part is small
    assert [text[30 + k] for k in range(4)] == [f"Story {k}" for k in range(4)]


def test_language_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    vocabulary = langid.Vocabulary(pieces)
    rng = np.random.default_rng(0)
    table = rng.random((len(pieces) + 1, 2))
    for word in ("a", "ab", "abab", "bax"):
        marked = "▁" + word

        def total(at, k, marked=marked):
            if at == len(marked):
                return 1.0
            out = 0.0
            for end in range(at + 1, len(marked) + 1):
                piece = marked[at:end]
                number = pieces.index(piece) if piece in pieces else len(pieces) if end == at + 1 else None
                if number is not None:
                    out += table[number, k] * total(end, k)
            return out

        reached = langid.Lattice(vocabulary, [word]).log_forward(table)[0]
        assert np.allclose(np.exp(reached), [total(0, 0), total(0, 1)])
    word, piece, uses = langid.Lattice(vocabulary, ["abab"]).posteriors(table[:, :1])
    length = np.array([len((pieces + ["?"])[p]) for p in piece])
    assert np.isclose((uses * length).sum(), 5)  # expected pieces cover every character once


def test_words_of_any_length_sum_all_segmentations():
    """Against a plain forward pass in logarithms: no piece and no word is too long."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "abababababababab", "▁" + "ab" * 15]
    vocabulary = langid.Vocabulary(pieces)
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces) + 1, 3)) * 1e-6
    number = {p: k for k, p in enumerate(pieces)}
    for word in ("ab" * 100, "abx" * 700, "ab" * 15, "a" * 17):
        marked = "▁" + word
        done = np.full((len(marked) + 1, 3), -np.inf)
        done[0] = 0
        for to in range(1, len(marked) + 1):
            for size in range(1, min(to, vocabulary.longest) + 1):
                k = number.get(marked[to - size : to], len(pieces) if size == 1 else None)
                if k is not None:
                    done[to] = np.logaddexp(done[to], done[to - size] + np.log(table[k]))
        lattice = langid.Lattice(vocabulary, [word, word])
        assert np.allclose(lattice.log_forward(table), done[-1])
        owner, piece, uses = lattice.posteriors(table[:, :1])
        length = np.array([len((pieces + ["?"])[p]) for p in piece])
        assert np.allclose(np.bincount(owner, uses * length), len(marked))
        # Forward and backward agree on the whole.
        total, scale = lattice.sums(table, True)
        assert np.allclose(np.log(total[0]) + scale[0], done[-1])
    assert vocabulary.longest == 31


def test_languages(spark):
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * (1 + k % 5), "en" if k % 2 else "de") for k in range(60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 34 !!", "en"), (103, "the dog", None), (None, "die katze und", "de"), (104, "x" * 5000, None), (7, rows[7][1], "en")]
    table = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(table, F.col("doc_id") % 4 != 2, langid.PIECES).collect()]
    names = {i: n for i, n, _ in found}
    assert len(found) == len(rows) and all(0 <= s <= 1 for _, _, s in found)
    assert names[100] == names[101] == names[102] == "und" and names[103] == "en" and names[None] == "de"
    assert all(names[k] == ("en" if k % 2 else "de") for k in range(60))


def test_secrets_base_spans_and_masks(spark):
    rng = random.Random(2)
    parts = ['password: "abcdefgh1"', "PASSWD=short", "token = 'x.y/z+aaaa=='", "AKIA" + "A" * 16, "AKIAB", "f" * 40, "0" * 31, "é\U0001f600", "api_key:12345678", "Secret  :  zzzzzzzzz", "ſecret=abcdefghi", " ", "\n", "tokentoken=aaaaaaaa"]
    rows = [(k, "".join(rng.choices(parts, k=6)), "a") for k in range(80)] + [(90, None, "a"), (91, "", "a"), (None, parts[0], "a")]
    found = secrets.find_secrets(docs_of(spark, rows)).collect()
    text = {i: t for i, t, _ in rows}
    for r in found:
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]) == brute.base_secrets(text[r["doc_id"]])
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    masked = secrets.mask_secrets(docs_of(spark, rows))
    assert masked.columns == docs_of(spark, rows).columns
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    for r in found:
        # Characters under any span are gone; each run of spans leaves one mark.
        source = text[r["doc_id"]]
        under = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        left = "".join(c for k, c in enumerate(source or "") if k not in under)
        assert (got[r["doc_id"]] or "").replace(secrets.MASK, "") == left
    assert got[90] is None and got[None] == secrets.MASK + '"'  # a span ends with the value


def test_grammars_accept_their_format_only():
    grammar = secrets.Grammar()
    rng = random.Random(77)
    for kind, (prefixes, alphabet, lengths) in secrets.FORMATS.items():
        fresh = [rng.choice(prefixes) + "".join(rng.choices(alphabet, k=lengths[0])) for _ in range(60)]
        hits = [grammar.best(x) for x in fresh]
        assert sum(h is not None for h in hits) >= 48, kind
    plain = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) + "7" for _ in range(200)] + ["a/b/c/2024-01-01/report.final.version", "x86_64-linux-gnu-gcc-12.2.0"]
    assert not any(grammar.best(x) for x in plain)
    base, every = secrets.spans_of("see ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bD1fG3hJ5"[:36] + " ok", grammar)
    assert not base and [k for _, _, k in every] == ["github"]


def test_credentials_inside_runs_are_found():
    grammar = secrets.Grammar()
    rng = random.Random(78)
    frames = ["STRIPE_KEY={}", "GH_PAT={}", "https://host/a/{}", "x={}", "see {}.", "u:p/{}/tail", "a={}=b"]
    for kind, (prefixes, _, lengths) in secrets.FORMATS.items():
        # Letters only too: digits are no condition.
        for alphabet in (secrets._ALNUM, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            tokens = [rng.choice(prefixes) + "".join(rng.choices(alphabet, k=lengths[0])) for _ in range(40)]
            tokens = [t for t in tokens if grammar.best(t)]
            assert len(tokens) >= 30, kind
            for token in tokens:
                for frame in frames:
                    text = frame.format(token)
                    spans = secrets.spans_of(text, grammar)[1]
                    assert any(text[s:e] == token for s, e, _ in spans), (kind, text)
    clean = ["MAX_CONNECTIONS_PER_HOST_LIMIT", "https://www.example.org/a/b/the-quick-brown-fox.html", "AbstractSingletonProxyFactoryBean", "my_npm_config_registry_for_all_users", "a/b/c/2024-01-01/report.final.version"]
    assert not any(secrets.spans_of(t, grammar)[1] for t in clean)


def test_recall_by_format_in_frames():
    grammar = secrets.Grammar()
    rng = random.Random(79)
    frames = ["{}", "export VALUE={}", "https://h.io/x/{}", '{{"value": "{}"}}', "hex: " + "a1" * 20 + " {}"]
    for kind, (prefixes, alphabet, lengths) in secrets.FORMATS.items():
        fresh = [rng.choice(prefixes) + "".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(100)]
        for frame in frames:
            hits = 0
            for token in fresh:
                text = frame.format(token)
                hits += any(s <= text.index(token) and e >= text.index(token) + len(token) for s, e, _ in secrets.spans_of(text, grammar)[1])
            assert hits >= 90, (kind, frame, hits)


def test_spans_of_a_long_log_cost_no_square():
    import time

    grammar = secrets.Grammar()
    line = "token=abcdefgh12345 id=" + "0123456789abcdef" * 2 + " path/to/some/long/file/name.txt\n"
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        base, every = secrets.spans_of(line * n, grammar)
        took.append(time.perf_counter() - began)
        assert len(base) == 2 * n and len(every) >= 2 * n
    assert took[1] < 12 * took[0]


def test_mixing_meets_its_targets(spark, docs, rows):
    found = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.SPACE.findall(t or ""))
    wanted = brute.targets(sizes)
    by_target = {}
    for r in found:
        assert r["taken"] <= 3 * r["size"]
        by_target.setdefault(r["target"], []).append(r["taken"])
    assert sorted(round(t, 6) for t in by_target) == sorted(round(t, 6) for t in wanted.values())
    assert all(abs(sum(v) - t) <= 1 for t, v in by_target.items())


def test_shards_hold_the_sources_by_weight(spark):
    """Totals are exact, each slot is dealt once, and no shard strays far from the shares."""
    rows = [(k, "w " * (50 + k % 100), "abc"[k % 3] if k % 7 else "a") for k in range(6000)]
    sized = docs_of(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.source_plan(sized).cache()
    wanted = {r["sid"]: (r["slots"], r["blocks"]) for r in plan.collect()}
    slots = mixing.mix_slots(spark, plan).collect()
    by_shard, dealt = {}, {}
    for r in slots:
        by_shard.setdefault(r["shard"], {}).setdefault(r["sid"], []).append(1)
        dealt.setdefault(r["sid"], []).append((r["epoch"], r["block"]))
    total = sum(n for n, _ in wanted.values())
    assert len(slots) == total and all(len(set(v)) == len(v) == wanted[s][0] for s, v in dealt.items())
    assert max(by_shard) == -(-total // mixing.SHARD) - 1
    for shard, own in by_shard.items():
        size = sum(map(len, own.values()))
        assert size == mixing.SHARD or shard == max(by_shard)
        for sid, (n, _) in wanted.items():
            share = n / total
            assert abs(len(own.get(sid, [])) - size * share) < 6 * (size * share * (1 - share)) ** 0.5 + 1


def test_permutations_are_permutations(spark):
    for size in (1, 2, 7, 100):
        table = spark.range(size).select("id", mixing.permuted(F.col("id"), F.lit(size).cast("long"), F.lit(4)).alias("p"))
        back = table.select("id", "p", mixing.permuted(F.col("p"), F.lit(size).cast("long"), F.lit(4), inverse=True).alias("back")).collect()
        assert sorted(r["p"] for r in back) == list(range(size)) and all(r["id"] == r["back"] for r in back)


def test_quality_statistics_equal_the_rules(spark, docs, rows):
    extra = ["a|b # <x> &\n\na|b # <x> &\n \t\na|b # <x> &", "one two three four five six seven eight " * 4, "\n\n", "É É\nÉ É"]
    table = docs.unionByName(docs_of(spark, [(200 + k, t, "a") for k, t in enumerate(extra)]))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40, 59)] + [(k, 1, 0) for k in (6, 7)] + [(201, 0, 0), (None, 1, 1), (40, None, None)], "doc_id long, quality int, toxic int")
    found = quality.quality(table, labels).collect()
    text = {i: t for i, t, _ in rows} | {200 + k: t for k, t in enumerate(extra)}
    assert len(found) == len(rows) + len(extra)
    for r in found:
        if r["doc_id"] is not None:
            n, chars, symbols, dups, repeats = brute.text_statistics(text[r["doc_id"]])
            assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [n, chars, symbols, dups, repeats]
            assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and (not r["base_failed"] or not r["kept"]) and 0 <= r["anomaly"] <= 1


def test_forest_isolates_the_odd_row():
    rng = np.random.default_rng(1)
    sample = rng.normal(0, 1, (500, 3))
    low, high = np.array([-6.0] * 3), np.array([6.0] * 3)
    scores = quality.Forest(sample, low, high).score(np.array([[0, 0, 0], [5.5, 5.5, -5.5]], float))
    assert scores[1] > scores[0] + 0.1


def test_paths_equal_walks_through_the_trees():
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 1, (300, 4))
    forest = quality.Forest(rows, rows.min(0), rows.max(0), trees=20)
    found = forest.score(rows)
    for row, score in zip(rows[:50], found, strict=False):
        total = 0.0
        for feature, split, path in zip(forest.feature, forest.split, forest.path, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if row[feature[node]] >= split[node] else 1)
            total += path[node]
        assert np.isclose(score, 2 ** (-total / 20 / quality._average_path(forest.size)))


def test_one_extreme_document_changes_no_other_verdict(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) + str(rng.randrange(50))
    plain = lambda: " ".join(word() for _ in range(rng.randint(30, 80)))
    rows = [(k, plain(), "a") for k in range(3000)] + [(3000 + k, plain().upper() + " !!! | | | ### $$$ ***", "a") for k in range(60)]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 3000, 3)] + [(3000 + k, 0) for k in range(30)], "doc_id long, quality int")
    found = {r["doc_id"]: r["kept"] for r in quality.quality(docs_of(spark, rows), labels).collect()}
    assert sum(found[3000 + k] for k in range(60)) <= 3 and sum(not found[k] for k in range(3000)) <= 30
    blob = (9999, "QUJD" * 200_000 + " " + plain(), "a")
    other = {r["doc_id"]: r["kept"] for r in quality.quality(docs_of(spark, [*rows, blob]), labels).collect()}
    assert sum(other[k] != found[k] for k in found) <= 3


def test_calibration_equals_a_try_of_every_threshold():
    rng = np.random.default_rng(4)
    scores = rng.random(400)
    good, bad = rng.random(400) < 0.7, rng.random(400) < 0.2
    bad &= ~good
    value = lambda t: (scores[bad] >= t).mean() - quality.WEIGHT * (scores[good] >= t).mean()
    assert np.isclose(value(quality.calibrate(scores, good, bad)), max(value(t) for t in [*scores, 2.0]))


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(4)
    plain = [f"t{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        words = rng.choices(plain, k=40)
        bad = k % 9 == 0
        if bad:
            words[3], words[20] = rng.choice(["blargh", "zonkuh"]), rng.choice(["idiot", "blargh"])
        rows.append((k, " ".join(words), "a"))
        labels.append((k, 1, int(bad)))
    table = docs_of(spark, rows + [(1000, None, "a"), (1001, "", "a"), (None, "you idiot blargh", "a"), rows[0]])
    known = spark.createDataFrame(labels + [(5, 0, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(table, known, F.col("doc_id") % 3 != 1).collect()
    assert len(found) == 904 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 3 == 1]
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 9 == 0) for r in held)
    assert all(r["score"] < 0.7 for r in found if r["doc_id"] in (1000, 1001))


def test_unlabelled_documents_teach_and_wrong_labels_do_not_rule(spark):
    """Few labels, a tenth of them wrong: the posteriors of all documents decide."""
    rng = random.Random(8)
    plain = [f"t{k}" for k in range(300)]
    rows, truth = [], {}
    for k in range(3000):
        words = rng.choices(plain, k=30)
        truth[k] = k % 6 == 0
        if truth[k]:
            words[2], words[9], words[15] = "idiot", "you", "scum"
        rows.append((k, " ".join(words), "a"))
    known = [(k, int(truth[k]) if rng.random() > 0.1 else 1 - int(truth[k])) for k in range(0, 3000, 10)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    found = toxicity.toxicity(docs_of(spark, rows), labels, F.lit(True)).collect()
    assert sum((r["score"] >= 0.7) != truth[r["doc_id"]] for r in found) <= 30


def test_capitals_of_the_whole_text_count():
    assert toxicity.capitals("aBCdÉ ß1", "abcdé ß1") == 3 and toxicity.capitals("İA", "İA".lower()) == 2
    look = toxicity.Voters([]).look
    assert look("aaaaaaA" * 10)[0] >> 11 & 1 == 0 and look("AAAAAAa" * 10)[0] >> 11 & 1 == 1


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    votes = np.zeros(4000, np.int64)
    for k in range(6):
        votes |= np.where(truth, rng.random(4000) < 0.8, rng.random(4000) < 0.05).astype(np.int64) << k
    votes |= (rng.random(4000) < 0.5).astype(np.int64) << 9
    patterns, counts = np.unique(votes, return_counts=True)
    model = toxicity.LabelModel(patterns, np.full(len(patterns), -1), counts)
    guess = model.predict(votes, np.full(4000, -1)) > 0.5
    assert (guess == truth).mean() > 0.95 and abs(model.prior - 0.2) < 0.05


@pytest.mark.parametrize("run", [
    neardup.near_duplicates, substrings.dedupe_substrings, mixing.mix_sources, secrets.find_secrets, secrets.mask_secrets,
    lambda d: langid.identify(d, F.col("doc_id") % 4 != 2, langid.PIECES),
    lambda d: quality.quality(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")),
    lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int"), F.lit(True)),
    lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
])
def test_empty_tables(spark, run):
    assert run(docs_of(spark, [])).collect() == []
    assert len(run(docs_of(spark, [(1, None, None)])).collect()) == 1


def test_other_empty_tables(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="text"):
        neardup.near_duplicates(spark.createDataFrame([(1,)], "doc_id long"))


def test_window_hashes_follow_the_words():
    words = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 5, 8, 16, 50):
        hashes = common.window_hashes(words, width)
        seen = {}
        for k in range(200 - width + 1):
            assert seen.setdefault(tuple(words[k : k + width]), hashes[k]) == hashes[k]
        assert len(set(hashes.tolist())) == len(seen)
    assert len(common.window_hashes(words[:3], 4)) == 0
