"""URL rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pages that a crawl leaves out, as case-insensitive patterns, and more of them by service.
CRAWL_EXCLUDE = ("/api/", "-api-reference", "doc-history", "document-history", "release-notes", "release-history", r"/index\.html$")
CRAWL_EXCLUDE_BY_SERVICE = {"vmfleet": ("instance-types", "instance_types", "/vmfleet/.*pricing")}
#: What discovery leaves out, as case-sensitive substrings.
DISCOVERY_EXCLUDE = ("doc-history", "document-history", "release-notes", "release-history", "/index.html")
DISCOVERY_EXCLUDE_BY_SERVICE = {"vmfleet": ("instance-types", "instance_types")}


def page(url: Column) -> Column:
    """The URL up to its query or fragment."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def in_scope(url: Column, prefix: Column) -> Column:
    return url.startswith(prefix) & url.endswith(".html")


def crawl_excluded(url: Column, service: Column) -> Column:
    out = url.rlike("(?i)(?:" + "|".join(CRAWL_EXCLUDE) + ")")
    for s, patterns in CRAWL_EXCLUDE_BY_SERVICE.items():
        out = out | ((service == s) & url.rlike("(?i)(?:" + "|".join(patterns) + ")"))
    return F.coalesce(out, F.lit(False))


def discovery_excluded(url: Column, service: Column) -> Column:
    def any_of(parts: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | url.contains(p)
        return hit

    out = any_of(DISCOVERY_EXCLUDE)
    for s, parts in DISCOVERY_EXCLUDE_BY_SERVICE.items():
        out = out | ((service == s) & any_of(parts))
    return F.coalesce(out, F.lit(False))


def cache_name(url: Column) -> Column:
    """Last path segment without trailing slashes, with ``.html`` added where it is missing."""
    last = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    return F.when(last.endswith(".html"), last).otherwise(F.concat(last, F.lit(".html")))
