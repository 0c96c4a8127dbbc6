import numpy as np
import pytest

from corpusloom.llm.vectors import current_vectors, similar_pairs, similar_vectors

DDL = "put_no bigint, key string, data struct<float32: array<float>>, metadata string, v int, vid int"


def log(spark, rows):
    return spark.createDataFrame([(n, k, None if x is None else (x,), "m", 1, 2) for n, k, x in rows], DDL)


def brute(x, names, k):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, name in enumerate(names):
        s = n @ n[i]
        order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(s[j], 6), names[j]))
        out[name] = order[:k]
    return out


@pytest.mark.parametrize("cell_rows, children", [(1024, 256), (100, 256), (100, 3)])
def test_recall_on_clusters(spark, cell_rows, children):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 20, axis=0) + 0.15 * rng.normal(size=(1200, 16))
    names = [f"k{i:04d}" for i in range(len(x))]
    df = log(spark, [(i, n, v.tolist()) for i, (n, v) in enumerate(zip(names, x))])
    out = similar_vectors(current_vectors(df, dim=16), k=5, dim=16, m=8, keep=40, cell_rows=cell_rows, children=children, sample=300).collect()
    want = {(a, names[j]) for a, js in brute(x, names, 5).items() for j in js}
    got = {(r.key, r.other) for r in out}
    assert len(out) == 5 * len(x) and len(got & want) / len(want) >= 0.97


def test_only_good_current_vectors(spark):
    nan, one = float("nan"), [1.0, 0.0, 0.0, 0.0]
    rows = [
        (1, "a", one), (2, "a", [0.0, 1.0, 0.0, 0.0]), (3, "b", [0.0, 2.0, 0.1, 0.0]), (4, "c", [nan, 1.0, 0.0, 0.0]), (5, "d", [0.0] * 4), (6, "e", []),
        (7, "f", None), (8, "g", [1.0]), (9, None, one), (10, "h", one), (11, "h", None), (12, "i", [None, 1.0, 0.0, 0.0]), (0, "b", one), (2, "a", [0.0, 1.0, 0.0, 0.0]), (13, "j", [1e-30, 0.0, 0.0, 0.0]),
    ]
    cur = current_vectors(log(spark, rows), dim=4)
    assert sorted(r.key for r in cur.collect()) == ["a", "b", "j"]
    pairs = similar_pairs(similar_vectors(cur, k=1, dim=4, m=2))
    assert sorted(map(tuple, pairs.collect()))[0] == ("a", "b")


def test_equal_vectors_are_neighbours_and_a_hot_group_stays_small(spark):
    hot = [(i, f"h{i:03d}", [1.0, 1.0, 0.0, 0.0]) for i in range(60)]
    rest = [(100 + i, f"r{i}", [0.0, 1.0, float(i), 1.0]) for i in range(5)]
    got = {}
    for r in similar_vectors(current_vectors(log(spark, hot + rest), dim=4), k=3, dim=4, m=2, cell_rows=1, children=2).collect():
        got.setdefault(r.key, {})[r["rank"]] = r.other
    assert got["h000"] == {1: "h001", 2: "h002", 3: "h003"} and got["h001"] == {1: "h000", 2: "h002", 3: "h003"} and got["h059"] == {1: "h000", 2: "h001", 3: "h002"}
    assert all(len(v) == 3 for v in got.values()) and len(got) == 65


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    df = log(spark, [(i, f"k{i}", [1.0, float(i), 0.0, 0.0]) for i in range(n)])
    assert similar_vectors(current_vectors(df, dim=4), dim=4, m=2).count() == (2 if n == 2 else 0)


def test_all_equal(spark):
    df = log(spark, [(i, f"k{i}", [1.0, 2.0, 0.0, 0.0]) for i in range(3)])
    assert sorted(map(tuple, similar_pairs(similar_vectors(current_vectors(df, dim=4), dim=4, m=2)).collect())) == [("k0", "k1"), ("k0", "k2"), ("k1", "k2")]
