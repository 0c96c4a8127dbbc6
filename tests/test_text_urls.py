import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import urls as U


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("s", ["", " ", "a b", "  a  b　\n", "\x1ca\x1fb\x85c", "x\ty  z", " a", "no", "a  b   c "])
def test_white_space_is_pythons(spark, s):
    assert one(spark, s, T.strip) == s.strip()
    assert one(spark, s, T.squash) == " ".join(s.split())
    assert one(spark, s, T.words) == s.split()


def test_null_text(spark):
    assert one(spark, None, T.words) == []
    assert one(spark, None, T.is_blank) is True
    assert one(spark, None, T.token_estimate) is None


def test_ids_and_tokens(spark):
    assert one(spark, "H\n\nabc", T.content_id) == "0e18f0cf9c9cbc04eeca18ba853e42b5"
    assert one(spark, "Überschrift\n\nnaïve café", T.content_id) == "611d5e3e315cc18cae254b2b95c06c14"
    assert one(spark, "héa😀xxxx", T.token_estimate) == 2


@pytest.mark.parametrize("n, want", [(0, "0s"), (59, "59s"), (60, "1m"), (3599, "59m"), (3600, "1h 0m"), (7325, "2h 2m")])
def test_duration(spark, n, want):
    assert spark.range(1).select(T.duration(F.lit(n)).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    "tail, service, crawl, discovery",
    [
        ("/dg/API/x.html", "s", True, False),
        ("/dg/foo-api-reference.html", "s", True, False),
        ("/dg/index.html", "s", True, True),
        ("/dg/index.html?x", "s", False, True),
        ("/dg/Doc-History.html", "s", True, False),
        ("/ug/instance-types.html", "vmfleet", True, True),
        ("/ug/instance-types.html", "blobs", False, False),
        ("/vmfleet/x/pricing.html", "vmfleet", True, False),
    ],
)
def test_exclusion(spark, tail, service, crawl, discovery):
    df = spark.createDataFrame([("https://h" + tail, service)], "u string, s string")
    r = df.select(U.crawl_excluded(F.col("u"), F.col("s")).alias("c"), U.discovery_excluded(F.col("u"), F.col("s")).alias("d")).first()
    assert (r.c, r.d) == (crawl, discovery)


@pytest.mark.parametrize("u, want", [("https://h/a/b.html", "b.html"), ("https://h/a/b/", "b.html"), ("b", "b.html"), ("h//", "h.html")])
def test_cache_name(spark, u, want):
    assert one(spark, u, U.cache_name) == want


def test_scope(spark):
    df = spark.createDataFrame([("https://h/p/x.html",), ("https://h/p/x.htm",), ("https://h/q/x.html",)], "u string")
    assert [r.x for r in df.select(U.in_scope(F.col("u"), F.lit("https://h/p/")).alias("x")).collect()] == [True, False, False]
