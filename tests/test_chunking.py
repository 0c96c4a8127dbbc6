import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators.chunking import chunk_sections, windows


@pytest.mark.parametrize(
    "words, room, want",
    [
        (["abcde"] * 1000, 2045, [(0, 340), (307, 340), (614, 340), (921, 79), (981, 19), (996, 4), (999, 1)]),
        (["a"] * 1100, 2045, [(0, 1022), (922, 178), (1056, 44), (1089, 11), (1098, 2)]),
        (["x" * 3000, "y", "z"], 2045, [(0, 1), (1, 2)]),
        (["ab"] * 5, -4, [(i, 1) for i in range(5)]),
        ([], 2045, []),
    ],
)
def test_golden_windows(words, room, want):
    assert list(windows(words, room)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), max_size=200), st.integers(5, 200))
def test_windows_cover_all_words(words, room):
    spans = list(windows(words, room))
    covered = set()
    for a, n in spans:
        covered |= set(range(a, a + n))
        assert n == 1 or sum(len(w) + 1 for w in words[a : a + n]) <= room
    assert covered == set(range(len(words)))
    short = list(windows(words, room, drop_contained_tails=True))
    assert short == spans[: len(short)] and (not words or sum(short[-1]) == len(words))


def test_sections(spark):
    rows = [(1, "H", "abcde " * 340 + "abcd", 7), (2, "H", " ".join(["abcde"] * 341)[:2045], 7), (3, None, "a\nb", 7), (4, "H", None, 7), (5, "H", "", 7), (6, "h" * 2050, "ab ab", 7), (1, "H", "x", 7), (7, "H", " " * 3000, 7)]
    df = spark.createDataFrame(rows, "id int, heading string, text string, prefix int")
    got = chunk_sections(df, ["id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
        assert r.chunk_id == hashlib.md5(r.chunk_text.encode()).hexdigest()
        assert r.token_count == len(r.chunk_text) // 4
    assert {k: len(v) for k, v in by.items()} == {1: 2, 2: 1, 3: 1, 6: 2} or {k: len(v) for k, v in by.items()}[3] == 1
    assert by[2][0].chunk_text == "H\n\n" + rows[1][2]
    assert by[3][0].chunk_text == "\n\na\nb"
    assert 4 not in by and 5 not in by and 7 not in by
    assert [r.n_words for r in by[6]] == [1, 1]


def test_empty(spark):
    df = spark.createDataFrame([], "id int, heading string, text string")
    assert chunk_sections(df, ["id"]).count() == 0
