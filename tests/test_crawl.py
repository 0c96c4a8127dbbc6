import pytest

from corpusloom.jobs import discover, scrape, seed_counts
from corpusloom.operators.crawl import chosen_services, reachable
from corpusloom.operators.extract import page_titles

PROSE = " ".join(["Queues release messages until all replicas have caught up."] * 30)


@pytest.fixture()
def services(spark):
    return spark.createDataFrame([("blobs", "https://x/blobs/", 1), ("funcs", "https://x/funcs/", 2)], "service string, prefix string, xml int")


def test_chosen_services(services):
    assert chosen_services(services).count() == chosen_services(services, None).count() == chosen_services(services, " ALL ").count() == 2
    assert [r.service for r in chosen_services(services, "Funcs, funcs,").collect()] == ["funcs"]
    with pytest.raises(Exception, match="unknown service: nope"):
        chosen_services(services, "funcs,nope").collect()
    with pytest.raises(ValueError):
        chosen_services(services, " , ")


def test_reachable(spark, services):
    probes = spark.createDataFrame([("blobs", 503, 1), ("blobs", 200, 2), ("funcs", 200, 1), ("funcs", None, 2), (None, 200, 3)], "service string, status int, probe_no int")
    assert [r.service for r in reachable(services, probes).collect()] == ["blobs"]
    assert reachable(services, probes.limit(0)).count() == 0


def test_scrape(spark, services):
    def page(text):
        return f"<html><title>T</title><body><main><h1>H</h1><p>{text}</p></main></body></html>"

    urls = ["https://x/blobs/a.html", "https://x/blobs/b.html", "https://x/blobs/c.html", "https://x/blobs/a.html", "https://x/blobs/doc-history.html", "https://y/z.html", "https://x/blobs/d.htm"]
    xml = "<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>"
    maps = spark.createDataFrame([("blobs", xml, "x"), ("funcs", None, "x"), ("funcs", "<urlset/>", "x")], "service string, xml string, url string")
    cached = spark.createDataFrame([(urls[0], page(PROSE))], "url string, html string")
    fetched = spark.createDataFrame([(urls[0], page("other")), (urls[1], page("too short"))], "url string, html string")
    counts, chunks = scrape(maps, services, cached, fetched)
    assert [tuple(r) for r in counts.collect()] == [("blobs", 3, 1, 1, 1, 1)]
    assert {(r.service, r.url) for r in chunks.collect()} == {("blobs", urls[0])}
    counts, chunks = scrape(maps.limit(0), services, cached, fetched, "funcs")
    assert counts.count() == chunks.count() == 0


def test_page_titles(spark):
    rows = [(1, "u", "<TITLE class=a> A &amp; B </TITLE><p>x"), (2, "u2", "<p>none"), (3, None, ""), (4, "u4", None)]
    got = {r.n: r.page_title for r in page_titles(spark.createDataFrame([(*r, "z") for r in rows], "n int, url string, html string, page_title string"), ["n"]).collect()}
    assert got == {1: "A & B", 2: "u2", 3: ""}


def test_seed_counts(spark):
    chunks = spark.createDataFrame([(1, "a", "u1", "s"), (2, "b", "u2", "s"), (3, "b", "u2", "s"), (4, "c", "u3", "s"), (5, "d", "", "s"), (6, None, "u1", None)], "chunk_no long, chunk_id string, source_url string, service string")
    done = spark.createDataFrame([("a",), ("b",), ("d",), ("b",), (None,)], "chunk_id string")
    queue = spark.createDataFrame([("u1",), ("u9",), ("u1",)], "url string")
    assert tuple(seed_counts(chunks, done, queue).first()) == (2, 1, 1, 1)
    assert tuple(seed_counts(chunks, done, queue, overwrite=True).first()) == (2, 1, 2, 0)
    assert tuple(seed_counts(chunks.limit(0), done, queue).first()) == (0, 0, 0, 0)


def test_a_failed_sitemap_stops_discovery(spark):
    found = spark.createDataFrame([("u1", "s")], "url string, service string")
    queue = spark.createDataFrame([("u2", "s", ["a"], "", "", "", "")], "url string, service string, chunk_ids array<string>, next_check string, last_checked string, last_modified string, etag string")
    vectors = spark.createDataFrame([("a",)], "key string")
    failed = spark.createDataFrame([("s", None)], "service string, error string")
    with pytest.raises(Exception, match="a sitemap failed"):
        discover(found, failed, queue, vectors)
    q, v = discover(found, failed.limit(0), queue, vectors)
    assert [r.url for r in q.collect()] == ["u1"] and v.count() == 0
