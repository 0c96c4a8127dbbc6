"""The URL queue: seeding, discovery, choice of what is due, and refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import top_per_group
from .tables import delete_keys, upsert

REFRESH_DAYS = 35


def url_map(chunks: DataFrame, ingested: DataFrame) -> DataFrame:
    """url, service, chunk_ids: per URL the ids of its ingested chunks and its last service by chunk_no.

    URLs and ids that are null or empty are skipped; a URL without an ingested chunk is left out.
    """
    rows = chunks.filter("coalesce(source_url, '') <> '' AND coalesce(chunk_id, '') <> ''").join(ingested.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return rows.groupBy(F.col("source_url").alias("url")).agg(F.max_by("service", "chunk_no").alias("service"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def latest(snapshots: DataFrame, back: int = 0) -> DataFrame:
    """The queue as the newest snapshot delivered it, or the one ``back`` before: per trimmed url the row with the highest load_no."""
    from ..functions import text as T
    from .dedupe import keep_last

    # One number, read first from the one column, so that the filter reaches the scan as a literal.
    number = snapshots.agg(F.max("snapshot_no")).first()[0]
    for _ in range(back):
        number = snapshots.filter(F.col("snapshot_no") < F.lit(number)).agg(F.max("snapshot_no")).first()[0]
    rows = snapshots.filter((F.col("snapshot_no") == F.lit(number)) & F.col("url").isNotNull()).withColumn("url", T.strip(F.col("url")))
    return keep_last(rows, ["url"], "load_no")


def diff(found: DataFrame, queue: DataFrame) -> DataFrame:
    """url, status in ('new', 'removed', 'kept') of two URL sets, in one full outer join."""
    a = found.select("url").distinct().withColumn("_f", F.lit(True))
    b = queue.select("url").distinct().withColumn("_q", F.lit(True))
    return a.join(b, "url", "full_outer").select("url", F.when(F.col("_q").isNull(), "new").when(F.col("_f").isNull(), "removed").otherwise("kept").alias("status"))


def orphaned_ids(queue: DataFrame, removed: DataFrame) -> DataFrame:
    """chunk_id of the removed URLs that no remaining URL refers to."""
    ids = queue.select("url", F.explode("chunk_ids").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    gone = ids.join(removed.select("url"), "url", "left_semi").select("chunk_id").distinct()
    kept = ids.join(removed.select("url"), "url", "left_anti").select("chunk_id").distinct()
    return gone.join(kept, "chunk_id", "left_anti")


def overdue_per_service(queue: DataFrame, now: str, k: int) -> DataFrame:
    """Per service the k rows with the smallest next_check up to ``now`` ('' and null are unknown and never due)."""
    due = queue.filter((F.col("next_check") <= now) & (F.col("next_check") != ""))
    return top_per_group(due, ["service"], [F.col("next_check"), F.col("url")], k)


def overdue(queue: DataFrame, now: str, k: int) -> DataFrame:
    """The k most overdue rows: the best of each service's best."""
    return overdue_per_service(queue, now, k).orderBy("next_check", "url").limit(k)


def outcome(status: Column) -> Column:
    return F.when(status == 200, "changed").when(status == 304, "unchanged").when(status == 0, "error").otherwise("skipped")


def page_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """url, stale, added (sorted id arrays) of two tables (url, chunk_ids); a URL may be in one of them only."""
    none = F.array().cast("array<string>")
    j = old.select("url", F.col("chunk_ids").alias("o")).join(new.select("url", F.col("chunk_ids").alias("n")), "url", "full_outer")
    o, n = F.coalesce("o", none), F.coalesce("n", none)
    return j.select("url", F.array_sort(F.array_except(o, n)).alias("stale"), F.array_sort(F.array_except(n, o)).alias("added"))


def refreshed(queue: DataFrame, fetched: DataFrame, now: Column, days: int = REFRESH_DAYS) -> DataFrame:
    """New state of the fetched URLs (url, status, chunk_ids, last_modified, etag: one row each).

    200 replaces chunk ids, validators and schedule, an empty id set becomes null; 0 leaves a row untouched; any other
    status moves the schedule only. URLs that are not in the queue are ignored.
    """
    f = fetched.select("url", "status", F.col("chunk_ids").alias("_ids"), F.col("last_modified").alias("_lm"), F.col("etag").alias("_et"))
    j = queue.join(f, "url")
    full, move = F.col("status") == 200, F.col("status") != 0
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return j.select(
        "url",
        "service",
        F.when(full, F.when(F.size(F.coalesce("_ids", F.array().cast("array<string>"))) > 0, F.array_sort("_ids"))).otherwise(F.col("chunk_ids")).alias("chunk_ids"),
        F.when(move, iso(now + F.expr(f"INTERVAL {days} DAYS"))).otherwise(F.col("next_check")).alias("next_check"),
        F.when(move, iso(now)).otherwise(F.col("last_checked")).alias("last_checked"),
        F.when(full, F.col("_lm")).otherwise(F.col("last_modified")).alias("last_modified"),
        F.when(full, F.col("_et")).otherwise(F.col("etag")).alias("etag"),
    )


def apply_refresh(queue: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    cols = ["url", "service", "chunk_ids", "next_check", "last_checked", "last_modified", "etag"]
    return upsert(queue.select(*cols), refreshed(queue, fetched, now).select(*cols), ["url"])


def apply_discovery(queue: DataFrame, status: DataFrame, found: DataFrame) -> DataFrame:
    """Queue without removed URLs and with new ones: no chunk ids yet and nothing checked."""
    kept = delete_keys(queue, status.filter("status = 'removed'"), ["url"])
    new = found.join(status.filter("status = 'new'"), "url", "left_semi").groupBy("url").agg(F.max("service").alias("service"))
    blank = new.select("url", "service", F.lit(None).cast("array<string>").alias("chunk_ids"), *[F.lit("").alias(c) for c in ("next_check", "last_checked", "last_modified", "etag")])
    return kept.select(*blank.columns).unionByName(blank)
