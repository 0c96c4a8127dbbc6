"""A crawl: which services, which of their URLs, what became of each page, and the chunks.

Defined results
  * service names are trimmed and lower-cased; ``all`` and null stand for all services, and an unknown name is an error;
  * a URL that several sitemaps of a service list counts once; URLs out of scope or excluded are not crawled;
  * a page without html is an error, one whose text is too short for a chunk is skipped, any other is processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import materialise
from ..sources.pages import read_through
from ..sources.sitemaps import sitemap_urls
from .extract import page_chunks
from .tables import fail_if_any


def chosen_services(services: DataFrame, wanted: str | None = "all") -> DataFrame:
    """The rows of ``services`` (one per name) that a comma list names; computing it fails if it names an unknown one."""
    names = sorted({n.strip().lower() for n in (wanted or "all").split(",")} - {""})
    if not names:
        raise ValueError("no service is named")
    if names == ["all"]:
        return services
    asked = services.sparkSession.createDataFrame([(n,) for n in names], "service string")
    found = asked.join(services.withColumn("_known", F.lit(True)), "service", "left")
    return fail_if_any(found, "_known IS NULL", F.concat(F.lit("unknown service: "), F.col("service"))).drop("_known")


def reachable(services: DataFrame, probes: DataFrame) -> DataFrame:
    """Services whose sitemap answered 200. ``probes`` has service and status; of several the last by ``probe_no`` counts."""
    last = probes.groupBy("service").agg(F.max_by("status", "probe_no").alias("status"))
    return services.join(last.filter("status = 200"), "service", "left_semi")


def crawl_urls(sitemaps: DataFrame, services: DataFrame, xml: str = "xml") -> DataFrame:
    """service, url of every URL to crawl. ``sitemaps`` has service and the document, ``services`` the service's prefix."""
    found = sitemap_urls(sitemaps, ["service"], xml).join(services.select("service", "prefix"), "service")
    url = F.col("url")
    return found.filter(U.in_scope(url, F.col("prefix")) & ~U.crawl_excluded(url, F.col("service"))).select("service", "url").distinct()


def crawl(urls: DataFrame, cached: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, chunks): what became of each (service, url), and the chunks of the processed ones.

    Pages are parsed once per URL, whichever services list it.
    """
    html = materialise(read_through(urls, cached, fetched).select("url", "origin", "html"), "crawl-html")
    chunks = materialise(page_chunks(html, ["url"]), "crawl-chunks")
    counts = chunks.groupBy("url").agg(F.count(F.lit(1)).alias("chunks"))
    outcome = F.when(F.col("origin") == "none", "error").when(F.col("chunks").isNull(), "skipped").otherwise("processed")
    pages = urls.join(html.select("url", "origin"), "url").join(counts, "url", "left").select("service", "url", "origin", outcome.alias("outcome"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return pages, urls.join(chunks, "url")


def crawl_counts(pages: DataFrame) -> DataFrame:
    """service, total, skipped, errors, processed, chunks."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    total = F.count(F.lit(1))
    return pages.groupBy("service").agg(
        total.alias("total"), n("skipped").alias("skipped"), n("error").alias("errors"), (total - n("skipped") - n("error")).alias("processed"), F.sum("chunks").alias("chunks")
    )
