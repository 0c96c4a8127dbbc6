import pytest

from corpusloom import jobs
from corpusloom.operators.answer import NO_HITS, NO_TEXT, answered, prompt, responses
from corpusloom.providers import HashEmbedder
from corpusloom.sources.progress import read_failed, read_progress, write_failed, write_progress
from corpusloom.sources.versioned import VersionedTable
from pyspark.sql import functions as F

PAGE = "<title>T</title><body><h2>{0}</h2><p>" + "word " * 60 + "</p><h2>b</h2><p>" + "text " * 60 + "</p>"


def test_build_twice_changes_nothing(spark, tmp_path):
    c = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 3, "x"), ("", 4, "y"), (None, 5, "z"), ("c", 6, None)], "chunk_id string, chunk_no long, text string")
    v, t = VersionedTable(spark, f"file://{tmp_path}/v"), VersionedTable(spark, f"file://{tmp_path}/t")
    assert jobs.build(c, v, t, HashEmbedder(8)) == 2
    first = sorted(map(str, v.read().collect()))
    assert jobs.build(c, v, t, HashEmbedder(8)) == 0
    assert sorted(map(str, v.read().collect())) == first and sorted(map(tuple, t.read().collect())) == [("a", "new"), ("b", "x")]


def test_seed(spark):
    c = spark.createDataFrame([(1, "u", "x", "s"), (2, "w", "y", "s")], "chunk_no long, source_url string, chunk_id string, service string")
    q = spark.createDataFrame([("u", "old", ["q"])], "url string, service string, chunk_ids array<string>")
    ing = c.select("chunk_id")
    keep = {r.url: r.service for r in jobs.seed(c, ing, q).collect()}
    over = {r.url: r.service for r in jobs.seed(c, ing, q, overwrite=True).collect()}
    assert keep == {"u": "old", "w": "s"} and over == {"u": "s", "w": "s"}


def test_discover_is_all_or_nothing(spark):
    found = spark.createDataFrame([("s", "a"), ("s", "b")], "service string, url string")
    q = spark.createDataFrame([("b", "s", ["1"]), ("c", "s", ["1", "2"])], "url string, service string, chunk_ids array<string>").withColumns({c: F.lit("") for c in ("next_check", "last_checked", "last_modified", "etag")})
    v = spark.createDataFrame([("1",), ("2",), ("3",)], "key string")
    none = spark.createDataFrame([], "service string, error string")
    queue, vectors = jobs.discover(found, none, q, v)
    assert sorted(r.url for r in queue.collect()) == ["a", "b"] and sorted(r.key for r in vectors.collect()) == ["1", "3"]
    with pytest.raises(RuntimeError, match="sitemap failed"):
        jobs.discover(found, spark.createDataFrame([("s", "timeout")], "service string, error string"), q, v)


def test_refresh(spark):
    q = spark.createDataFrame([("a", "s", ["old", "both"], "2031-01-01T00:00:00+00:00"), ("b", "s", ["both"], "2031-01-02T00:00:00+00:00"), ("z", "s", None, "2039-01-01T00:00:00+00:00")], "url string, service string, chunk_ids array<string>, next_check string")
    q = q.withColumns({c: F.lit("") for c in ("last_checked", "last_modified", "etag")})
    f = spark.createDataFrame([(1, "a", 404, None), (2, "a", 200, PAGE.format("h")), (3, "b", 304, None), (4, "z", 200, PAGE.format("h"))], "fetch_no long, url string, status int, html string").withColumns({"last_modified": F.lit("L"), "etag": F.lit("E")})
    v = spark.createDataFrame([("old", [1.0]), ("both", [1.0])], "key string, v array<float>")
    out = jobs.refresh(q, f, v, HashEmbedder(4), "2031-02-01 00:00:00")
    queue = {r.url: r for r in out["queue"].collect()}
    assert len(queue["a"].chunk_ids) == 2 and queue["b"].chunk_ids == ["both"] and queue["z"].next_check.startswith("2039")
    assert {r.key for r in out["vectors"].collect()} == {"both", *queue["a"].chunk_ids}
    assert {r.outcome: r.n for r in out["stats"].collect()} == {"changed": 1, "unchanged": 1}


def test_answers(spark):
    df = spark.createDataFrame([(1, 2, "ctx"), (2, 2, None), (3, 0, None)], "qid long, n_hits int, context string").withColumn("prompt", prompt(F.col("context"), F.lit("q?")))
    a = answered(df, lambda p, n: f"{len(p) > 10} {n}")
    assert {r.qid: r.answer for r in a.collect()} == {1: "True 1024", 2: NO_TEXT, 3: NO_HITS}
    s = spark.createDataFrame([(1, 2, 5, "s", "h", "w", 0.2), (1, 1, 1, "s", "h", "u", 0.1)], "qid long, n int, rank int, service string, heading string, source_url string, distance double")
    body = {r.qid: r.body for r in responses(a, s).collect()}
    assert body[1] == '{"answer":"True 1024","sources":[{"service":"s","heading":"h","source_url":"u","distance":0.1,"rank":1},{"service":"s","heading":"h","source_url":"w","distance":0.2,"rank":5}]}'
    assert body[3].endswith('"sources":[]}')


def test_progress(spark, tmp_path):
    p = f"file://{tmp_path}/p"
    ids = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "chunk_id string")
    write_progress(ids, p + "/d", "t")
    write_failed(spark.createDataFrame([("c", "embed: x"), ("d", None), (None, "put: y")], "chunk_id string, message string"), p + "/f", "t")
    assert sorted(r.chunk_id for r in read_progress(spark, p + "/d").collect()) == ["a", "b"]
    assert sorted(map(tuple, read_failed(spark, p + "/f").collect())) == [("c", "embed", "embed: x"), ("d", "put", "")]
    assert read_progress(spark, p + "/x").count() == 0 == read_failed(spark, p + "/x").count()
