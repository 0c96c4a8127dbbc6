import random
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators.dedupe import keep_first_ranked, keep_last, top_per_group
from corpusloom.operators.queue import apply_refresh, diff, orphaned_ids, overdue, page_diff, url_map
from corpusloom.operators.runs import runs_of, with_total
from corpusloom.operators.tables import delete_keys, fail_if_any, insert_if_absent, upsert

KV = "k string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_are_idempotent(spark):
    t, s = spark.createDataFrame([("a", 1), ("b", 2)], KV), spark.createDataFrame([("b", 3), ("c", 4)], KV)
    up = upsert(t, s, ["k"])
    assert rows(up) == [("a", 1), ("b", 3), ("c", 4)] == rows(upsert(up, s, ["k"]))
    ins = insert_if_absent(t, s, ["k"])
    assert rows(ins) == [("a", 1), ("b", 2), ("c", 4)] == rows(insert_if_absent(ins, s, ["k"]))
    assert rows(delete_keys(t, s, ["k"])) == [("a", 1)]


def test_fail_if_any(spark):
    t = spark.createDataFrame([("a", 1)], KV)
    assert fail_if_any(t, "v > 1", "too many").count() == 1
    with pytest.raises(PySparkException, match="too many"):
        fail_if_any(t, "v = 1", "too many").count()


def test_keep_last_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", None, "n"), ("b", None, "m"), (None, 1, "z"), ("a", 2, "x")], "k string, o int, v string")
    assert rows(keep_last(df, ["k"], "o")) == [("a", 2, "x"), ("b", None, "m"), (None, 1, "z")]
    assert keep_last(df.limit(0), ["k"], "o").count() == 0


def test_keep_first_and_top(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4), ("b", 9), ("b", 8), ("b", 7)], "k string, r int")
    assert rows(keep_first_ranked(df, "k", "r")) == [("a", 1), ("b", 7)]
    top = top_per_group(df.filter("k = 'b'"), ["k"], [F.col("r")], 2)
    assert rows(top) == [("b", 7), ("b", 8)]
    top.collect()
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_url_map(spark):
    c = spark.createDataFrame([(1, "u", "x", "s1"), (2, "u", "y", "s2"), (3, "u", "x", "s3"), (4, "", "x", "s"), (5, None, "x", "s"), (6, "w", "z", "s"), (7, "u", None, "s9")], "chunk_no long, source_url string, chunk_id string, service string")
    ing = spark.createDataFrame([("x",), ("y",), ("x",)], "chunk_id string")
    assert rows(url_map(c, ing)) == [("u", "s3", ["x", "y"])]


def test_discovery(spark):
    f, q = spark.createDataFrame([("a",), ("b",), ("b",)], "url string"), spark.createDataFrame([("b", ["1", "2"]), ("c", ["2", "3", None]), ("d", None)], "url string, chunk_ids array<string>")
    st = diff(f, q)
    assert rows(st) == [("a", "new"), ("b", "kept"), ("c", "removed"), ("d", "removed")]
    assert rows(orphaned_ids(q, st.filter("status = 'removed'"))) == [("3",)]


def test_overdue_is_exact_top_k(spark):
    q = spark.createDataFrame([("s", "u1", "2"), ("s", "u2", "1"), ("t", "u3", "1"), ("t", "u4", "9"), ("t", "u5", ""), ("t", "u6", None)], "service string, url string, next_check string")
    out = overdue(q, "5", 2)
    assert [r.url for r in out.collect()] == ["u2", "u3"]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().toString()


def test_page_diff(spark):
    ddl = "url string, chunk_ids array<string>"
    o, n = spark.createDataFrame([("a", ["1", "2"]), ("b", None)], ddl), spark.createDataFrame([("a", ["2", "3"]), ("c", ["9"])], ddl)
    assert rows(page_diff(o, n)) == [("a", ["1"], ["3"]), ("b", [], []), ("c", [], ["9"])]


def test_refresh(spark):
    q = spark.createDataFrame([(u, "s", ["1"], "n", "c", "l", "e") for u in "abcde"], "url string, service string, chunk_ids array<string>, next_check string, last_checked string, last_modified string, etag string")
    f = spark.createDataFrame([("a", 200, ["2", "1"], "L", "E"), ("b", 304, None, "L", "E"), ("c", 0, None, "L", "E"), ("d", 200, [], "", ""), ("zz", 200, ["3"], "", "")], "url string, status int, chunk_ids array<string>, last_modified string, etag string")
    out = {r.url: tuple(r)[2:] for r in apply_refresh(q, f, F.lit("2031-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    now, then = "2031-01-01T00:00:00+00:00", "2031-02-05T00:00:00+00:00"
    assert out == {"a": (["1", "2"], then, now, "L", "E"), "b": (["1"], then, now, "l", "e"), "c": (["1"], "n", "c", "l", "e"), "d": (None, then, now, "", ""), "e": (["1"], "n", "c", "l", "e")}


def test_runs_and_total(spark):
    df = spark.createDataFrame([("k", i, b) for i, b in enumerate([True, True, False, True, True, True])] + [("j", 9, True)], "k string, n int, bad boolean")
    assert rows(runs_of(df, "bad", ["k"], "n", 2)) == [("k", 0, 1, 2), ("k", 3, 5, 3)]
    assert rows(with_total(df, "k", n=F.count(F.lit(1)))) == [("TOTAL", 7), ("j", 1), ("k", 6)]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_runs_across_blocks(spark, block):
    rng = random.Random(block)
    log = [(k, n, None if rng.random() < 0.1 else rng.random() < 0.7) for k in ("a", "b", None) for n in sorted(rng.sample(range(60), 30))]
    want = []
    for k in ("a", "b", None):
        run = []
        for n, bad in [(n, bad) for key, n, bad in log if key == k] + [(None, False)]:
            if bad:
                run.append(n)
            else:
                if len(run) >= 2:
                    want.append((k, run[0], run[-1], len(run)))
                run = []
    rng.shuffle(log)
    df = spark.createDataFrame(log, "k string, n long, bad boolean")
    got = [tuple(r) for r in runs_of(df, "bad", ["k"], "n", 2, block=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
