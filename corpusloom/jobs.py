"""The pipeline's jobs: each reads tables, returns or writes new states, and can be run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.crawl import chosen_services, crawl, crawl_counts, crawl_urls
from .operators.dedupe import keep_last
from .operators.extract import page_chunks
from .operators.queue import apply_discovery, apply_refresh, diff, orphaned_ids, outcome, overdue, page_diff, url_map
from .operators.tables import delete_keys, insert_if_absent, upsert
from .providers import Embedder, embedded
from .session import materialise
from .sources.versioned import VersionedTable


def scrape(sitemaps: DataFrame, services: DataFrame, cached: DataFrame, fetched: DataFrame, wanted: str | None = "all") -> tuple[DataFrame, DataFrame]:
    """(counts per service, chunks) of a crawl: sitemaps to URLs, pages from the cache or as fetched, sections to chunks."""
    urls = materialise(crawl_urls(sitemaps, chosen_services(services, wanted)), "crawl-urls")
    pages, chunks = crawl(urls, cached, fetched)
    return crawl_counts(pages), chunks


def build(chunks: DataFrame, vectors: VersionedTable, texts: VersionedTable, embedder: Embedder) -> int:
    """Embed the chunks that have no vector yet, once per id with its last text, and write vectors and texts.

    Duplicates go before the model is called. Returns the number of new vectors.
    """
    last = keep_last(chunks.filter("chunk_id <> '' AND text IS NOT NULL").select("chunk_id", "chunk_no", "text"), ["chunk_id"], "chunk_no")
    have = vectors.read()
    pending = last if have is None else last.join(have.select(F.col("key").alias("chunk_id")), "chunk_id", "left_anti")
    new = materialise(embedded(pending, embedder, "chunk_id", "text"), "new-vectors")
    vectors.replace(new if have is None else upsert(have, new, ["key"]))
    old = texts.read()
    text = last.select("chunk_id", "text")
    texts.replace(text if old is None else upsert(old, text, ["chunk_id"]))
    return new.count()


def seed(chunks: DataFrame, ingested: DataFrame, queue: DataFrame, overwrite: bool = False) -> DataFrame:
    """Queue (url, service, chunk_ids) with the ingested chunks' URLs; rows that are there stay unless ``overwrite``."""
    new = url_map(chunks, ingested)
    cols = ["url", "service", "chunk_ids"]
    return (upsert if overwrite else insert_if_absent)(queue.select(*cols), new.select(*cols), ["url"])


def seed_counts(chunks: DataFrame, ingested: DataFrame, queue: DataFrame, overwrite: bool = False) -> DataFrame:
    """One row: ids with a URL that are included or excluded (not ingested), URLs written, skipped and so kept as they are."""
    ids = chunks.filter("coalesce(source_url, '') <> '' AND coalesce(chunk_id, '') <> ''").groupBy("chunk_id").agg(F.lit(1).alias("one"))
    j = ids.join(ingested.select("chunk_id").distinct().withColumn("v", F.lit(1)), "chunk_id", "left")
    included = j.agg(F.count("v").alias("included"), F.count_if(F.col("v").isNull()).alias("excluded"))
    there = url_map(chunks, ingested).select("url").join(queue.select("url").distinct().withColumn("q", F.lit(1)), "url", "left")
    skipped = F.lit(0) if overwrite else F.count("q")
    urls = there.agg((F.count(F.lit(1)) - skipped).alias("written"), skipped.cast("bigint").alias("skipped"))
    return included.withColumn("written", urls.select("written").scalar()).withColumn("skipped", urls.select("skipped").scalar())


def discover(found: DataFrame, failures: DataFrame, queue: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, vectors) after a scan of all sitemaps. ``failures`` has a row (service, error) per sitemap that failed:
    with any, nothing is changed."""
    if failures.limit(1).count():
        raise RuntimeError("a sitemap failed: nothing is changed")
    status = diff(found, queue)
    gone = orphaned_ids(queue, status.filter("status = 'removed'")).withColumnRenamed("chunk_id", "key")
    return apply_discovery(queue, status, found), delete_keys(vectors, gone, ["key"])


def refresh(queue: DataFrame, fetches: DataFrame, vectors: DataFrame, embedder: Embedder, now: str, batch: int = 50) -> dict[str, DataFrame]:
    """One refresh batch: the most overdue URLs, their last fetch, new chunks, and what follows for the tables.

    Only ids that were embedded are recorded, and a vector goes only when no URL refers to it any more. ``texts`` has the
    text of every chunk of the batch, to be written over what is there.
    """
    at = F.lit(now).cast("timestamp_ntz")
    due = materialise(overdue(queue, _iso(now), batch).select("url"), "due")
    last = keep_last(fetches.join(due, "url", "left_semi"), ["url"], "fetch_no")
    chunks = materialise(page_chunks(last.filter("status = 200"), ["url"]), "refresh-chunks")
    known = vectors.select(F.col("key").alias("chunk_id"))
    new = embedded(chunks.join(known, "chunk_id", "left_anti").dropDuplicates(["chunk_id"]), embedder, "chunk_id", "chunk_text")
    ids = chunks.groupBy("url").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    fetched = last.select("url", "status", "last_modified", "etag").join(ids, "url", "left")
    after = apply_refresh(queue, fetched, at)
    changed = fetched.filter("status = 200").select("url", "chunk_ids")
    stale = page_diff(queue.join(changed.select("url"), "url", "left_semi"), changed).select(F.explode("stale").alias("key"))
    kept = after.select(F.explode("chunk_ids").alias("key"))
    stats = last.groupBy(outcome(F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    gone = stale.distinct().join(kept, "key", "left_anti")
    texts = chunks.groupBy("chunk_id").agg(F.min("chunk_text").alias("text"))
    return {"queue": after, "vectors": delete_keys(vectors.select("key", "v"), gone, ["key"]).unionByName(new), "texts": texts, "stats": stats}


def _iso(now: str) -> str:
    return now.replace(" ", "T") + "+00:00"
