import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom.session import materialise, scratch, shared_dir
from corpusloom.sources.chunk_files import read_chunk_files, write_chunk_files
from corpusloom.sources.pages import last_pages, read_through
from corpusloom.sources.sitemaps import sitemap_files, sitemap_urls
from corpusloom.sources.versioned import VersionedTable
from corpusloom.streaming.refresh import FETCH_DDL, read_fetches, run_refresh, windowed_counts


def test_sitemap(spark):
    xml = "<urlset xmlns='http://x'><url><loc> https://a </loc></url><u><v><loc>https://b?x=1&amp;y</loc></v></u><loc/><url><loc>https://a</loc></url></urlset>"
    df = spark.createDataFrame([("s", xml), ("t", None), ("e", "<urlset/>")], "service string, xml string")
    assert sorted(r.url for r in sitemap_urls(df, ["service"]).collect()) == ["https://a", "https://a", "https://b?x=1&y"]


def test_sitemap_round_trip(spark):
    urls = spark.range(2500).select(F.lit("s").alias("service"), F.concat(F.lit("https://h/?a=<1>&b="), F.col("id").cast("string")).alias("url"))
    files = sitemap_files(urls)
    assert files.count() == 3
    assert sorted(r.url for r in sitemap_urls(files, ["service"]).collect()) == sorted(r.url for r in urls.collect())


def test_chunk_files(spark, tmp_path):
    cols = "chunk_id string, service string, source_url string, page_title string, heading string, text string, chunk_hash string, token_count int"
    df = spark.createDataFrame([(str(i), "s" if i % 2 else None, "u", None, "h", "t\n é", None, i) for i in range(30)], cols)
    path = f"file://{tmp_path}/files"
    write_chunk_files(df, path, per_file=7)
    assert sorted(map(str, read_chunk_files(spark, [path, path + "-no"]).collect())) == sorted(map(str, df.collect()))
    assert read_chunk_files(spark, [path + "-no"]).count() == 0
    (tmp_path / "pretty.json").write_text('{"metadata": {"status": "complete"},\n "chunks": [{"chunk_id": "1"}]}')
    (tmp_path / "none.json").write_text('{"metadata": {}}')
    assert [r.chunk_id for r in read_chunk_files(spark, [f"file://{tmp_path}/*.json"], multi_line=True).collect()] == ["1"]


def test_read_through(spark):
    f = spark.createDataFrame([(1, "a", 200, "old"), (2, "a", 200, "new"), (3, "b", 200, None), (4, "c", 404, "x"), (5, None, 200, "x")], "fetch_no long, url string, status int, html string").withColumns({"last_modified": F.lit(""), "etag": F.lit("")})
    pages = last_pages(f)
    assert [(r.url, r.html) for r in pages.collect()] == [("a", "new")]
    urls = spark.createDataFrame([("a",), ("z",), ("a",)], "url string")
    out = {r.url: (r.origin, r.html) for r in read_through(urls, pages.limit(0), pages).collect()}
    assert out == {"a": ("fetch", "new"), "z": ("none", None)}


def test_versioned(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.replace(spark.range(2))
    t.replace(t.read().filter("id = 1"))
    assert t.versions() == [1, 2] and [r.id for r in t.read().collect()] == [1]


def test_shared_folder_is_the_named_one(spark):
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "file:///named/"))
    assert shared_dir(named) == "file:///named"
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_materialise_cuts_lineage(spark):
    df = materialise(spark.range(3).repartition(2), "x")
    assert df.count() == 3 and "Exchange" not in df._jdf.queryExecution().toString()


def test_refresh_stream(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame(rows, "fetch_no long, url string, status int, etag string")
        df.select("fetch_no", "url", "status", F.lit(None).cast("string").alias("html"), F.lit("").alias("last_modified"), "etag", F.expr("timestamp_ntz'2031-01-01 00:00:00'").alias("fetched_at")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    t = VersionedTable(spark, f"file://{tmp_path}/state")
    go = lambda: run_refresh(read_fetches(spark, f"file://{tmp_path}/in"), t, f"file://{tmp_path}/cp")
    put("1", [(1, "a", 200, "x"), (5, "b", 304, "y"), (6, "b", 0, "z"), (7, None, 200, "z")])
    go()
    put("2", [(2, "a", 404, "w"), (4, "b", 200, "late")])
    go()
    go()
    assert sorted((r.url, r.fetch_no, r.outcome) for r in t.read().collect()) == [("a", 2, "skipped"), ("b", 5, "unchanged")]


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", 200) for i in range(6)], "fetch_no long, url string, status int")
    df.select("fetch_no", "url", "status", F.lit(None).cast("string").alias("html"), F.lit("").alias("last_modified"), F.lit("").alias("etag"), F.expr("timestamp_ntz'2031-01-01 00:00:00' + make_dt_interval(0, int(fetch_no * 10))").alias("fetched_at")).write.parquet(f"file://{tmp_path}/in")
    s = windowed_counts(spark.readStream.schema(FETCH_DDL).parquet(f"file://{tmp_path}/in"), "fetched_at", "status")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 2, 3]


def test_scratch_folders_are_deleted(spark):
    with scratch(spark):
        outer = materialise(spark.range(3), "outer")
        with scratch(spark):
            inner = materialise(outer, "inner")
            paths = [f.removeprefix("file://") for df in (outer, inner) for f in df.inputFiles()]
            assert inner.count() == 3
        assert [os.path.exists(p) for p in paths] == [True] * len(outer.inputFiles()) + [False] * (len(paths) - len(outer.inputFiles()))
        assert outer.count() == 3
    assert not any(map(os.path.exists, paths))
