import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm.pack import pack, sum_of_squares, token_count

DDL = "doc_id bigint, text string, id int, n int, shard int, n_tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DDL)


def test_tokens(spark):
    texts = ["", "  ", None, "a b", "a_1-b!!c", "é日本　x", "éa", "…—a", "a\x1cb", "x" * 100000]
    got = [r.n for r in frame(spark, list(enumerate(texts))).coalesce(1).select(token_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


def test_sum_of_squares_places_one_at_a_time():
    sizes = np.random.default_rng(1).integers(1, 101, 3000)
    box = sum_of_squares(sizes, 100)
    fill = np.bincount(box, weights=sizes)
    assert fill.max() <= 100 and set(box) == set(range(len(fill)))
    assert sizes.sum() / (100 * len(fill)) > 0.95
    assert list(sum_of_squares(np.array([100, 100]), 100)) == [0, 1]
    assert list(sum_of_squares(np.array([60, 40, 60, 40]), 100)) in ([0, 0, 1, 1], [0, 1, 1, 0])


def test_each_rule_step():
    """Every placement has the smallest sum of squares that any choice gives."""
    sizes = np.random.default_rng(2).integers(1, 20, 200)
    box, level = sum_of_squares(sizes, 20), {}
    count = [0] * 21
    for s, b in zip(sizes.tolist(), box.tolist()):
        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + s < 20:
                c[h + s] += 1
            return sum(x * x for x in c[1:20])

        options = [h for h in range(0, 21 - s) if h == 0 or count[h]]
        h = level.get(b, 0)
        assert after(h) == min(map(after, options))
        if h:
            count[h] -= 1
        level[b] = h + s
        if h + s < 20:
            count[h + s] += 1


def test_pack(spark):
    rows = [(i, "w " * (i % 40)) for i in range(500)] + [(900, "w " * 95), (901, "w " * 30), (902, "w " * 60), (903, None), (None, "w w"), (5, "w " * 5)]
    out = pack(frame(spark, rows), capacity=30, shard_rows=200).collect()
    fill, parts = {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.id, []).append((r.part_no, r.first_token, r.n_tokens))
    assert max(fill.values()) <= 30
    assert sorted(parts[900]) == [(1, 0, 30), (2, 30, 30), (3, 60, 30), (4, 90, 5)] and parts[901] == [(1, 0, 30)] and sorted(parts[902]) == [(1, 0, 30), (2, 30, 30)]
    assert parts[903] == [(1, 0, 0)] and parts[None] == [(1, 0, 2)] and len(parts[5]) == 2
    assert {i for i, p in parts.items() if len(p) > 1 and i != 5} == {i for i in range(500) if i % 40 > 30} | {900, 902}
    assert sum(fill.values()) == sum(len((t or "").split()) for _, t in rows)


def test_empty(spark):
    assert pack(frame(spark, [])).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    df = frame(spark, [(i, "w " * (1 + i % 7)) for i in range(200)])
    a, b = ({(r.id, r.container) for r in pack(x, capacity=10).collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert a == b
