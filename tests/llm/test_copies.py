import random
import re
from collections import defaultdict

import pytest

from corpusloom.llm.copies import collapsed, copies

DDL = "chunk_no bigint, text string, id int, rep int, plain string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], DDL)


def found(spark, rows):
    return sorted((r.rep, r.id) for r in copies(frame(spark, rows)).collect() if r.id != r.rep)


def squeeze(s):
    return re.sub(r"[\W_]", "", s.lower())


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("H\n\nSome text, here.", "h some TEXT here", True),
        ("H\n\nSome text", "H\n\nSome texts", False),
        ("H\n\na: 1\nb: 2", "H\n\nB = 2; A = 1", True),
        ("H\n\na: 1\nb: 2", "H\r\n \r\n B:2 |a:1|", True),
        ("H\n\na: 1\nb: 2", "G\n\nb: 2\na: 1", False),
        ("H\n\na: 1\nb: 2\nfree text", "H\n\nb: 2\na: 1\nfree text", False),
        ("H\n\na: 1", "H\n\n1: a", False),
        ("\n\na: 1\nb: 2", "\n\nb: 2\na: 1", True),
        ("x: 1\ny: 2", "y: 2\nx: 1", False),
        ("H\n\none two", "H\n\ntwo one", False),
        ("Über Straße", "ÜBER STRAßE!", True),
    ],
)
def test_pairs(spark, a, b, same):
    assert bool(found(spark, [(1, a), (2, b)])) is same


def test_chain_through_plain_and_fields(spark):
    rows = [(5, "H\n\na: 1\nb: 2"), (3, "H a 1 b 2"), (9, "H\n\nb: 2\na: 1"), (7, "H b 2 a 1"), (8, "other")]
    assert found(spark, rows) == [(3, 5), (3, 7), (3, 9)]


def test_one_plain_form_read_as_two_field_lists(spark):
    rows = [(1, "H\n\na: bc\nd: e"), (2, "H\n\nab: c\nde: e".replace("de: e", "d: e")), (3, "H\n\nd: e\na: bc"), (4, "H\n\nd: e\nab: c"), (5, "H\n\nab: c\nd: e")]
    assert found(spark, rows) == [(1, 2), (1, 3), (1, 4), (1, 5)]
    rows = [(1, "H\n\na: b\nc: d"), (2, "H\n\nab: c; d = d".replace("d = d", "d: x")), (3, "H\n\nc: d\na: b")]
    assert found(spark, rows) == [(1, 3)]


def test_nulls_blanks_repeats_hot_groups(spark):
    rows = [(1, None), (2, " \n"), (3, "!!!"), (4, "..."), (None, "zz")] + [(10 + i, "Hot  Text" if i % 2 else "hot text!") for i in range(60)] + [(10, "hot text!"), (100, "x" * 300000), (101, "X" * 300000)]
    got = found(spark, rows)
    assert got == [(10, i) for i in range(11, 70)] + [(100, 101)]
    out = {r.id: r.n_copies for r in collapsed(frame(spark, rows)).collect()}
    assert out == {10: 61, 100: 2, None: 1}


def test_random_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        fields = [f"{n}{rnd.choice([':', ' = ', ': '])}{v}" for n, v in zip("abcd", rnd.choices("123", k=rnd.randint(1, 3)))]
        rnd.shuffle(fields)
        rows.append((i, rnd.choice(["H", "h "]) + "\n\n" + rnd.choice(["\n", " ; ", "|"]).join(fields)))
    groups = defaultdict(list)
    for i, t in rows:
        parts = [squeeze(p) for p in re.split(r"[\n;|]", t.split("\n\n", 1)[1])]
        groups["".join(sorted(parts)) if len(parts) > 1 else "1" + parts[0]].append(i)
    assert found(spark, rows) == sorted((g[0], x) for g in groups.values() for x in g[1:])


def test_empty(spark):
    assert copies(frame(spark, [])).count() == 0 and collapsed(frame(spark, [])).count() == 0
