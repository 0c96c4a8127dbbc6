"""Refresh as a stream: fetch results arrive as files, the newest state per URL is kept in a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_last
from ..operators.queue import outcome
from ..operators.tables import upsert
from ..sources.versioned import VersionedTable

FETCH_DDL = "fetch_no bigint, url string, status int, html string, last_modified string, etag string, fetched_at timestamp_ntz"


def read_fetches(spark: SparkSession, data_dir: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(FETCH_DDL).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(data_dir)


def latest_state(fetches: DataFrame) -> DataFrame:
    """url, fetch_no, outcome, etag: the newest fetch of each URL that reached a server, by fetch_no."""
    rows = fetches.filter("url IS NOT NULL AND status <> 0").select("url", "fetch_no", outcome(F.col("status")).alias("outcome"), "etag")
    return keep_last(rows, ["url"], "fetch_no")


def run_refresh(stream: DataFrame, table: VersionedTable, checkpoint: str) -> None:
    """Merge every micro-batch into ``table`` until no input is left. Replaying a batch gives the same state."""

    def merge(batch: DataFrame, _: int) -> None:
        new = latest_state(batch)
        old = table.read()
        if old is not None:
            new = keep_last(new.unionByName(old.join(new.select("url"), "url", "left_semi")), ["url"], "fetch_no")
            new = upsert(old, new, ["url"])
        table.replace(new)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window and key; windows close once the watermark has passed them, later rows are dropped."""
    rows = stream.select(F.col(time).cast("timestamp").alias("t"), F.col(key).alias("k")).withWatermark("t", late)
    return rows.groupBy(F.window("t", window).alias("w"), "k").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("k").alias(key), "n")
