"""Sitemap documents: reading the URLs of any namespace and depth, and writing them in files of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

URLS_PER_FILE = 1000


def sitemap_urls(df: DataFrame, ids: list[str], xml: str = "xml") -> DataFrame:
    """ids, url of each ``loc``, trimmed; order and repeats are kept, blank ones are dropped, null documents have none."""
    locs = F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()"))
    return df.filter(F.col(xml).isNotNull()).select(*ids, F.explode(locs).alias("url")).withColumn("url", T.strip(F.col("url"))).filter("url <> ''")


def sitemap_files(urls: DataFrame, service: str = "service", url: str = "url") -> DataFrame:
    """service, part, xml: documents of about URLS_PER_FILE different URLs each, so that none grows with a service."""
    urls = urls.select(service, url).filter(F.col(url).isNotNull()).distinct()
    parts = urls.groupBy(service).agg(F.ceil(F.count(F.lit(1)) / URLS_PER_FILE).cast("int").alias("_parts"))
    j = urls.join(parts, service).select(F.col(service).alias("service"), F.pmod(F.xxhash64(url), F.col("_parts")).cast("int").alias("part"), F.col(url).alias("url"))
    esc = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>"), esc, F.lit("</loc></url>")))), "")
    return j.groupBy("service", "part").agg(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>")).alias("xml"))
