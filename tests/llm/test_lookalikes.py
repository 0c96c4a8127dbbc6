import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.lookalikes import Drawings, Rewriter, character_counts, consistent_texts, drawn_pairs, lookalike_classes, lookalike_letters, lookalike_pairs, prepared, rewrite_table

DDL = "doc_id bigint, text string, form string, id int"


LETTERS: list = []
#: One form per taste: Latin letters are the most frequent, or others are.
FREQUENT: list = []


@pytest.fixture(scope="module", autouse=True)
def letters(spark):
    LETTERS[:] = lookalike_letters(spark)
    FREQUENT[:] = rewriter("plain text abcdefghijklmnopqrstuvwxyz \u00e9 ABCDE"), rewriter("\u0430\u0435\u0456\u0440\u0131\u04d3\u0131\u03bf\u0391")


def rewriter(*texts):
    return Rewriter(*rewrite_table(Counter(prepared("".join(texts))), LETTERS))


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("ｔｈｅ", "the", True), ("pаypаl", "paypal", True), ("ﬁle", "file", True), ("oﬃce", "office", True), ("café", "café", True), ("cafе́", "café", True),
        ("a​b", "ab", True), ("e‍́", "é", True), ("a b", "a b", True), ("a b", "a b", True), ("x‑y", "x-y", True), ("K", "K", True), ("Ｋ", "К", True), ("が", "が", True), ("ё", "ë", True),
        ("th\u0430\u0308lt", "th\u00e4lt", True), ("\u0435\u0300", "\u00e8", True), ("\u0435\u0308", "\u00eb", True), ("\u0456\u0308", "\u00ef", True), ("\u0410\u0308", "\u00c4", True), ("a\u200b\u0308", "\u04d3", True), ("\u0441\u0327\u0301", "\u1e09", True),
        ("\u03bd", "v", True), ("\u03c1", "p", True), ("\u217c", "l", True), ("\u2160", "I", True), ("\u2163", "IV", True), ("\u0131", "i", True), ("\u0474", "V", True), ("\u0406", "I", True), ("\u04c0", "\u0399", True),
        ("I", "l", False), ("\u0406", "l", False), ("m", "rn", False), ("\u0417", "3", False), ("\u00f8", "o", False), ("\u0142", "l", False), ("\u0219", "\u015f", False), ("\u2212", "-", False), ("\u0456", "\u0457", False),
        ("А", "Α", True), ("co­op", "coop", True), ("a️b", "ab", True), ("한", "한", True), ("ά", "ά", True),
        ("m2", "m²", False), ("é", "e", False), ("A", "a", False), ("a.", "a!", False), ("1", "l", False), ("0", "O", False), ("½", "1/2", False), ("①", "1", False), ("a b", "ab", False), ("rn", "m", False), ("№", "No", False), ("é", "è", False),
    ],
)
def test_pairs_of_strings(a, b, same):
    for f in FREQUENT:
        assert (f(a) == f(b)) is same


def test_representative_is_the_most_frequent():
    assert rewriter("ааа" * 5, "a")("a") == "а"
    assert rewriter("а", "aaa")("а") == "a"


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from([*"aeoABKéüй ﬁ́̈​ ｅ２²が", *"\u0430\u0435\u043e\u0456\u0440\u0410\u0391\u03bf\u03c1\u03bd\u0131\u217c\u2163\u04d3\u0450\u1e09\u0327\u0300\u0305"]), max_size=30))
def test_rewriting_twice_changes_nothing_and_respects_normal_forms(s):
    f = FREQUENT[len(s) % 2]
    assert f(f(s)) == f(s) == f(unicodedata.normalize("NFD", s)) == f(unicodedata.normalize("NFC", s))


def test_equal_drawings_become_equal_texts():
    """Every code point that takes part, alone and with accents, in texts that hold it or something drawn like it."""
    d = Drawings(LETTERS)
    points = sorted({*d.points.parent, *(a for a, _ in drawn_pairs())} - {" "})
    f = rewriter("".join(points), "plain text")
    for mark in ("", "\u0301", "\u0308\u0301", "\u0305"):
        seen = {}
        for c in points:
            form = f(c + mark)
            assert f(form) == form
            assert seen.setdefault(d.of(c + mark), form) == form
        assert len(set(seen.values())) == len(seen)


def test_each_code_point_is_spelled_out_in_one_way():
    d = Drawings(LETTERS)
    for a, b in d.pairs:
        assert d.of(a) == d.of(b)


def test_counts(spark):
    df = spark.createDataFrame([("aé😀",), ("a",), (None,), ("",)], "text string").repartition(3)
    assert {chr(r.point): r.n for r in character_counts(df).collect()} == {"a": 2, "é": 1, "😀": 1}


def test_documents(spark):
    rows = [(1, "the pаge"), (2, "the page"), (3, "the page"), (4, "The page"), (5, None), (6, " "), (7, " "), (8, "ｔｈｅ page"), (9, "x" * 200000), (10, "ｘ" * 200000), (None, "zz")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], DDL)
    assert sorted(map(tuple, lookalike_pairs(df).collect())) == [(1, 2), (1, 3), (1, 8), (2, 8), (3, 8), (9, 10)]
    c = {r.id: (r.class_id, r.spellings) for r in lookalike_classes(df).collect()}
    assert c[8] == (1, 3) and c[4] == (4, 1) and 5 not in c and 6 not in c and 7 not in c
    t = {r.id: r.form for r in consistent_texts(df).collect()}
    assert t[1] == t[8] == "the page" and t[5] is None
    empty = df.limit(0)
    assert lookalike_pairs(empty).count() == lookalike_classes(empty).count() == consistent_texts(empty).count() == 0
