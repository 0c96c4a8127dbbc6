"""Progress and failure files of an ingest: JSON documents with a key list and with a map of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS_DDL = "ingested_chunk_ids array<string>, count bigint, updated_at string"
FAILED_DDL = "failed map<string, string>, count bigint, updated_at string"
#: Keys of one document: a progress set is as many documents as it needs.
KEYS_PER_FILE = 50_000


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def _grouped(df: DataFrame, key: str) -> DataFrame:
    n = max(1, -(-df.count() // KEYS_PER_FILE))
    return df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("_part")


def write_progress(ids: DataFrame, path: str, updated_at: str, key: str = "chunk_id") -> None:
    g = _grouped(ids.select(key).filter(F.col(key).isNotNull()).distinct(), key).agg(F.array_sort(F.collect_list(key)).alias("ingested_chunk_ids"))
    g.select("ingested_chunk_ids", F.size("ingested_chunk_ids").cast("bigint").alias("count"), F.lit(updated_at).alias("updated_at")).write.json(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id of every ingested chunk, each once; none where there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "chunk_id string")
    return spark.read.schema(PROGRESS_DDL).json(path).select(F.explode("ingested_chunk_ids").alias("chunk_id")).distinct()


def write_failed(failed: DataFrame, path: str, updated_at: str) -> None:
    """failed: chunk_id (each once), message."""
    g = _grouped(failed.filter("chunk_id IS NOT NULL"), "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", F.coalesce("message", F.lit("")).alias("message")))).alias("failed"))
    g.select("failed", F.size("failed").cast("bigint").alias("count"), F.lit(updated_at).alias("updated_at")).write.json(path)


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, stage ('embed' or 'put'), message."""
    if not exists(spark, path):
        return spark.createDataFrame([], "chunk_id string, stage string, message string")
    rows = spark.read.schema(FAILED_DDL).json(path).select(F.explode("failed").alias("chunk_id", "message"))
    return rows.select("chunk_id", F.when(F.col("message").startswith("embed:"), "embed").otherwise("put").alias("stage"), "message")
