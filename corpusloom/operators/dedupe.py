"""One row per key: the first or last in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key (a null order is lowest). max_by combines map-side, so the rows of
    a hot key do not gather in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def keep_first_ranked(df: DataFrame, key: str, rank: str) -> DataFrame:
    """First row of each key in rank order; rows with an empty or null key are left out."""
    w = Window.partitionBy(key).orderBy(rank)
    return df.filter((F.col(key).isNotNull()) & (F.col(key) != "")).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k per group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")
