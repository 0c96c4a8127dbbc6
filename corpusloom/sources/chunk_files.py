"""Chunk files: JSON documents with run metadata and an array of chunks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

CHUNK_FIELDS = ("chunk_id", "service", "source_url", "page_title", "heading", "text", "chunk_hash")
CHUNK = t.StructType([*[t.StructField(n, t.StringType()) for n in CHUNK_FIELDS], t.StructField("token_count", t.IntegerType())])
FILE = t.StructType(
    [
        t.StructField("metadata", t.StructType([t.StructField("services", t.ArrayType(t.StringType())), t.StructField("total_chunks", t.LongType()), t.StructField("status", t.StringType())])),
        t.StructField("chunks", t.ArrayType(CHUNK)),
    ]
)
CHUNKS_PER_FILE = 1000


def write_chunk_files(chunks: DataFrame, path: str, per_file: int = CHUNKS_PER_FILE) -> None:
    """Documents of about ``per_file`` chunks, one per line, null fields left out."""
    n = max(1, -(-chunks.count() // per_file))
    parts = chunks.select(F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("part"), F.struct(*CHUNK_FIELDS, "token_count").alias("c"))
    docs = parts.groupBy("part").agg(F.collect_list("c").alias("chunks"))
    meta = F.struct(F.array_sort(F.array_distinct(F.array_compact(F.col("chunks.service")))).alias("services"), F.size("chunks").cast("bigint").alias("total_chunks"), F.lit("complete").alias("status"))
    docs.select(meta.alias("metadata"), "chunks").write.json(path)


def read_chunk_files(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """All chunks of all files; missing paths are skipped, a document without chunks has none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], CHUNK)
    docs = spark.read.schema(FILE).option("multiLine", multi_line).json(there)
    return docs.select(F.explode("chunks").alias("c")).select("c.*")


def fresh_path(base: str, label: str) -> str:
    return os.path.join(base, "corpusloom", f"{label}-{uuid.uuid4().hex}")
