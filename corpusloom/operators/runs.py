"""Runs in ordered logs, and totals reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs_of(df: DataFrame, flag: str, keys: list[str], order: str, least: int, block: int = 100_000) -> DataFrame:
    """keys, first, last, length of each run of at least ``least`` consecutive rows of a key whose flag is true.

    A key's log is cut into blocks of ``block`` numbers of ``order``, which is unique in a key, so that no window holds
    more rows than that; runs that touch a border are joined afterwards, two rows for each block at most.
    """
    df = df.select(*keys, F.col(order).alias("_o"), F.coalesce(F.col(flag), F.lit(False)).alias("_f")).withColumn("_b", F.floor(F.col("_o") / block))
    inside, by_flag = Window.partitionBy(*keys, "_b").orderBy("_o"), Window.partitionBy(*keys, "_b", "_f").orderBy("_o")
    r = df.withColumn("_at", F.row_number().over(inside)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_b")))
    r = r.withColumn("_island", F.col("_at") - F.row_number().over(by_flag))
    # Every island, also of rows without the flag: those of one block show where the key's next block follows.
    g = r.groupBy(*keys, "_b", "_f", "_island").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count(F.lit(1)).alias("length"), F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.max("_n").alias("_n"))
    border = (F.col("_from") == 1) | (F.col("_to") == F.col("_n"))
    within = g.filter(~border & F.col("_f")).select(*keys, "first", "last", "length")
    w = Window.partitionBy(*keys).orderBy("first")
    # Neighbours at a border have the same flag and nothing between them, or a new run begins.
    new = F.lag("_f").over(w).isNull() | (F.lag("_f").over(w) != F.col("_f")) | (F.col("_from") != 1) | (F.lag("_to").over(w) != F.lag("_n").over(w))
    joined = g.filter(border).withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(w)).filter("_f")
    joined = joined.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length")).drop("_run")
    return within.unionByName(joined).filter(F.col("length") >= least)


def with_total(df: DataFrame, key: str, total: str = "TOTAL", **aggregates) -> DataFrame:
    """Aggregates per key and one more row for all keys together, by rollup."""
    r = df.rollup(key).agg(F.grouping(key).alias("_g"), *[a.alias(n) for n, a in aggregates.items()])
    return r.withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key))).drop("_g")
