import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.retrieve import context, cosine_distance, sources, top_k, with_text
from corpusloom.providers import HashEmbedder, embedded


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<float>, label int").repartition(5)
    q = spark.createDataFrame([(1, x[1].tolist(), None), (2, x[2].tolist(), 2), (3, None, None), (4, [0.0] * 8, None)], "qid long, qv array<float>, qlabel int")
    got = {(r.qid, r["rank"]): r.key for r in top_k(df, q, 4, "id", "v", "label").collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for qid, only in ((1, None), (2, 2)):
        d = 1 - n @ n[qid]
        order = [i for i in np.argsort(d) if only is None or i % 3 == only][:4]
        assert [got[qid, r] for r in range(1, 5)] == order
    assert {k[0] for k in got} == {1, 2}


def test_dirty_vectors_and_ties(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", []), ("e", [float("nan"), 1.0]), ("f", [0.0, 0.0]), ("g", [1.0]), ("h", [None, 1.0]), ("a2", [3.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, v array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qv array<float>")
    assert [r.key for r in top_k(df, q, 2).orderBy("rank").collect()] == ["a", "a2"]
    assert top_k(df.limit(0), q).count() == 0
    assert top_k(df, q.limit(0)).count() == 0


def test_distance_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 3.0])], "a array<float>, b array<float>")
    assert [round(r.d, 9) for r in df.select(cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [0.0, 1.0]


def test_context_and_sources(spark):
    hits = spark.createDataFrame(
        [(1, "k1", 1, 0.1, "s", "h", "u"), (1, "k2", 2, 0.2, None, None, "u"), (1, "k3", 3, 0.31236, "t", "i", "w"), (1, "k4", 4, 0.4, "t", "i", None), (1, "k5", 5, 0.5, "t", "i", "")],
        "qid long, key string, rank int, distance double, service string, heading string, source_url string",
    )
    texts = spark.createDataFrame([("k1", " one "), ("k2", "\n"), ("k3", "three")], "key string, text string")
    c = context(with_text(hits, texts)).first()
    assert c.context == "[Source 1] S — h\nURL: u\n\none\n\n---\n\n[Source 3] T — i\nURL: w\n\nthree" and c.n_blocks == 2
    s = sources(hits).orderBy("n").collect()
    assert [(r.n, r["rank"], r.source_url, r.distance, r.similarity) for r in s] == [(1, 1, "u", 0.1, 0.9), (2, 3, "w", 0.3124, 0.6876)]


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_blocks_of_queries_give_the_same(spark, block):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(60, 4)).astype(float)
    df = spark.createDataFrame([(f"k{i:02d}", v.tolist()) for i, v in enumerate(x)], "key string, v array<float>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:9])], "qid long, qv array<float>")
    got = sorted((r.qid, r["rank"], r.key, round(r.distance, 6)) for r in top_k(df, q, 5, block=block).collect())
    want = sorted((r.qid, r["rank"], r.key, round(r.distance, 6)) for r in top_k(df, q, 5).collect())
    assert got == want and len({g[0] for g in got}) == sum(v.any() for v in x[:9])



def test_embedder(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", ""), ("c", None), ("d", "X  y")], "k string, t string")
    v = {r.key: r.v for r in embedded(df, HashEmbedder(16), "k", "t").collect()}
    assert set(v) == {"a", "b", "d"} and v["a"] == v["d"] and not any(v["b"])
