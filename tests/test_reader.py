"""The reader and the facts of files."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions.edits import fold
from skein.functions.cursor import active_arity, call_at, indent_at, split_arities, split_params, word_at
from skein.functions.edn import parse, values_after
from skein.functions.facts import file_facts, is_config
from skein.functions.java import outline
from skein.functions.reader import Lines, read, utf16
from skein.sources.projects import dependency_rows, deps_paths, lein_paths


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='()[]{}#_\'`~@^"\\;: a/b1\n,?', max_size=60))
def test_any_text_is_read_and_spans_nest(text):
    root = read(text)
    for form in root.walk(gaps=True):
        assert 0 <= form.start <= form.end <= len(text)
    file_facts("a.clj", text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n\U0001f600é", max_size=40))
def test_positions_and_offsets_agree(text):
    lines = Lines(text)
    for offset in range(len(text) + 1):
        assert lines.offset(*lines.at(offset)) == offset
    assert utf16(text) == len(text.encode("utf-16-be")) // 2


def test_columns_count_utf16_units():
    facts = file_facts("a.clj", '(ns a) "\U0001f600" (def x 1)')
    assert facts.symbols[0]["name_range"] == (0, 17, 0, 18)


def test_unclosed_and_stray_brackets():
    facts = file_facts("a.clj", ")) (ns a.b) (defn f [x] (g x")
    assert facts.ns == "a.b" and [s["fqn"] for s in facts.symbols] == ["a.b/f"]


def test_shadowing_and_order_of_bindings():
    facts = file_facts("a.clj", "(ns a)\n(def x 1)\n(defn f [] (let [y x x y] x))\n(defn g [] x)")
    uses = [o["name_range"] for o in facts.occurrences if o["fqn"] == "a/x"]
    assert uses == [(2, 19, 2, 20), (3, 11, 3, 12)]


def test_quoted_data_is_no_usage_and_discards_are_marked():
    facts = file_facts("a.clj", "(ns a)\n'b (quote c) `d #_(e)")
    names = {o["fqn"]: o["discarded"] for o in facts.occurrences}
    assert names == {"a/d": False, "a/e": True}


def test_reader_conditionals_define_all_branches():
    facts = file_facts("a.cljc", "(ns a (:require #?(:clj [b :as c] :cljs [d :as e])))\n#?(:clj (def x 1) :cljs (def y 2))")
    assert facts.aliases == {"c": "b", "e": "d"} and [s["name"] for s in facts.symbols] == ["x", "y"]


def test_macros_declared_alike_define():
    facts = file_facts("a.clj", "(ns a (:require [ui :refer [defc]]))\n(defc button [p] p)", {"ui/defc": "Defn"})
    assert facts.symbols[0]["fqn"] == "a/button" and facts.symbols[0]["kind"] == "Defn"
    assert "ui/defc" in [o["fqn"] for o in facts.occurrences]
    assert [b["local"] for b in facts.bindings] == [False]


def test_component_keys():
    facts = file_facts("a.clj", "(ns a (:require [integrant.core :as ig]))\n(defmethod ig/init-key ::db [_ c] c)\n(ig/ref ::db)")
    assert [s["fqn"] for s in facts.symbols if s["kind"] == "IntegrantKey"] == [":a/db"]
    assert [o["name_range"] for o in facts.occurrences if o["fqn"] == ":a/db"] == [(2, 8, 2, 12)]


def test_protocol_implementations_resolve_to_the_protocol():
    facts = file_facts("a.clj", "(ns a (:require [p :as p]))\n(defrecord R [] p/Shape (area [this] this) Object (toString [_] 1))")
    assert "p/area" in [o["fqn"] for o in facts.occurrences] and "a/toString" not in [o["fqn"] for o in facts.occurrences]


def test_a_value_string_is_no_doc():
    facts = file_facts("a.clj", '(def v "1.0")\n(def w "Doc." 2)')
    assert [s["doc"] for s in facts.symbols] == [None, "Doc."]


def test_config_files():
    assert is_config("sys.edn", "{:a/b 1}") and is_config("s.edn", "{:x #ig/ref :y}")
    assert not is_config("deps.edn", "{:a/b 1}") and not is_config("x.edn", "{:paths []}") and not is_config("x.clj", "{:a/b 1}")


def test_cursor_functions():
    assert word_at("(a/b  c)", 0, 4) == ("a/b", False) and word_at(":key", 0, 2) == ("key", True)
    assert call_at("(f a [b ") == ("f", 1) and call_at("(f") is None and call_at("[x ") is None
    assert call_at('(g "(" ; (\n x ') == ("g", 2)
    assert split_params("[^:p ^String s & {:keys [a b]}]") == ["^:p ^String s", "& {:keys [a b]}"]
    assert split_arities("([] [x] [x [y] & z])") == ["[]", "[x]", "[x [y] & z]"]
    assert active_arity(["[]", "[x]", "[x & r]"], 3) == (2, 1)
    assert indent_at("(defn f [x]\n") == 2 - 0 and indent_at("[1 2\n") == 1 and indent_at('(f "') is None and indent_at("") == 0
    assert indent_at("((f) 1\n") == 1


def test_edits_apply_in_order():
    assert fold("ab\ncd", [(0, 1, 1, 1, "X"), (0, 0, 0, 0, "Y")]) == "YaXd"
    assert fold("a", [(-1, 0, 0, 0, "new")]) == "new"


def test_manifests():
    assert deps_paths('{:paths ["src"] :aliases {:t {:extra-paths ["test" "src"] :paths ["no"]}}}') == ["src", "test"]
    assert lein_paths('(defproject a "1" :source-paths ^:replace ["s"] :profiles {:dev {:test-paths ["t"]}})') == ["s", "t"]
    rows = dependency_rows("root", '{:deps {a/b {:git/url "https://h/x.git" :git/tag "v/1"} c {:local/root "../c" :deps/root "s"} d {:mvn/version "1"}}}')
    assert [r[2:] for r in rows] == [("a/b", "git", "https://h/x.git", "v_1", None), ("c", "local", "../c", None, "s")]
    assert parse('{:a [1 "x\\n" #{b}]}') == {":a": ["1", "x\n", ["b"]]}
    assert values_after("(:k #_[0] [1])", ":k") == [["1"]]


def test_java_outline():
    found = outline("package p; /** Doc. */ public interface I extends A, B { int f(int x); String N = \"{\"; }")
    assert found["fqn"] == "p.I" and found["extends"] == ["A", "B"] and found["doc"] == "/** Doc. */"
    assert [(m["name"], m["kind"]) for m in found["members"]] == [("f", "method"), ("N", "field")]
