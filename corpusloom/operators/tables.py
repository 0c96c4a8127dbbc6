"""Keyed-table changes as joins. Each returns the new state; nothing is read back or changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of their key. The source has one row per key (see dedupe.keep_last)."""
    return target.join(source, keys, "left_anti").unionByName(source)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows stay as they are; source rows come in where the key is new."""
    return target.unionByName(source.join(target, keys, "left_anti"))


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone, keys, "left_anti")


def fail_if_any(df: DataFrame, bad: str, message: str | Column) -> DataFrame:
    """``df`` unchanged, or an error when it is computed and a row meets ``bad``: all or nothing."""
    return df.filter(F.when(F.expr(bad), F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("boolean")).otherwise(F.lit(True)))
