"""Read-through page cache: cached HTML first, fetched HTML where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import cache_name
from ..operators.dedupe import keep_last


def last_pages(fetches: DataFrame) -> DataFrame:
    """url, html, last_modified, etag, fetch_no of the last fetch with status 200 and a page, for each URL."""
    ok = fetches.filter("status = 200 AND html IS NOT NULL AND url IS NOT NULL").select("url", "html", "last_modified", "etag", "fetch_no")
    return keep_last(ok, ["url"], "fetch_no")


def read_through(urls: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """url, cache_file, origin ('cache', 'fetch', 'none'), html for each URL."""
    j = urls.select("url").distinct().join(cached.select("url", F.col("html").alias("_c")), "url", "left").join(fetched.select("url", F.col("html").alias("_f")), "url", "left")
    origin = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_f").isNotNull(), "fetch").otherwise("none")
    return j.select("url", cache_name(F.col("url")).alias("cache_file"), origin.alias("origin"), F.coalesce("_c", "_f").alias("html"))
