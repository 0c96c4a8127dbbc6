"""Changes between consecutive full snapshots of a keyed table.

Every delivered row is reduced to (snapshot, key, row hash). Runs of consecutive snapshots in which a key keeps its
hash form validity intervals (gaps and islands); the starts, ends and adjacencies of a key's intervals are the change
events.

Defined results
  * rows with a null key or null snapshot number are left out; keys are trimmed of white space, an empty key counts;
  * of several rows of one key in one snapshot the one with the highest order column counts (a null order is lowest);
  * null and empty sets are equal, element order and repeats do not matter, null elements are dropped;
  * the first snapshot has no events; an empty table has none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def current_rows(df: DataFrame, snapshot: str, key: str, order: str, items: str) -> DataFrame:
    """One row per snapshot and key: snap, key, row_hash. The maximum combines map-side, so hot keys do not gather."""
    slim = df.select(
        F.col(snapshot).cast("int").alias("snap"),
        T.strip(F.col(key)).alias("key"),
        F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**62))).alias("ord"),
        F.md5(
            F.array_join(
                F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x: x.isNotNull()))),
                "\x1f",
            )
        ).alias("row_hash"),
    ).filter("snap IS NOT NULL AND key IS NOT NULL")
    return slim.groupBy("snap", "key").agg(F.max(F.struct("ord", "row_hash"))["row_hash"].alias("row_hash"))


def validity_intervals(rows: DataFrame) -> DataFrame:
    """key, row_hash, first_idx, last_idx: the islands of equal hash over consecutive snapshot positions.

    Positions come from a dense numbering of the snapshots that occur; there are as many rows in that small table as
    snapshots, never as many as keys.
    """
    return (
        rows.withColumn("brk", F.when((F.col("idx") - 1 == F.lag("idx").over(_by_key())) & (F.col("row_hash") == F.lag("row_hash").over(_by_key())), 0).otherwise(1))
        .withColumn("island", F.sum("brk").over(_by_key()))
        .groupBy("key", "island")
        .agg(F.first("row_hash").alias("row_hash"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    )


def _by_key():
    return Window.partitionBy("key").orderBy("idx")


def snapshot_changes(df: DataFrame, snapshot: str = "snapshot_no", key: str = "url", order: str = "load_no", items: str = "chunk_ids") -> DataFrame:
    """snapshot_no, key, kind in ('added', 'removed', 'changed') for each snapshot against the one before."""
    rows = current_rows(df, snapshot, key, order, items)
    numbers = df.select(F.col(snapshot).cast("int").alias("snap")).filter("snap IS NOT NULL").distinct()
    dense = numbers.select("snap", (F.dense_rank().over(Window.orderBy("snap")) - 1).alias("idx"))  # one row per snapshot
    spans = validity_intervals(rows.join(dense, "snap"))
    w = Window.partitionBy("key").orderBy("first_idx")
    ev = spans.select(
        "key",
        F.when(F.col("first_idx") > 0, F.struct(F.col("first_idx").alias("idx"), F.when(F.lag("last_idx").over(w) == F.col("first_idx") - 1, "changed").otherwise("added").alias("kind"))).alias("start"),
        F.when(F.coalesce(F.lead("first_idx").over(w) != F.col("last_idx") + 1, F.lit(True)), F.struct((F.col("last_idx") + 1).alias("idx"), F.lit("removed").alias("kind"))).alias("end"),
    )
    events = ev.select("key", F.explode(F.array_compact(F.array("start", "end"))).alias("e")).select("key", "e.idx", "e.kind")
    # An interval open at the last snapshot has no end: position last+1 does not exist, so the join drops it.
    return events.join(dense, "idx").select(F.col("snap").alias("snapshot_no"), "key", "kind")
