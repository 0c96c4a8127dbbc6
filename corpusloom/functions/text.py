"""Text functions as Column expressions; white space means Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s under (?U) plus the four information separators: the characters Python's str.split() splits on.
WS = r"(?U)[\s\x1c-\x1f]+"
# Where squeezing changes anything: white space other than one plain space between words.
_RAGGED_WS = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_WS, "")


def squash(c: Column) -> Column:
    """Every run of white space becomes one space; none at either end."""
    return F.btrim(F.regexp_replace(c, _RAGGED_WS, " "))


def words(c: Column) -> Column:
    """White-space separated words; an empty array for null or blank text."""
    flat = squash(F.coalesce(c, F.lit("")))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(squash(c), F.lit("")) == ""


def token_estimate(c: Column) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(c) / 4).cast("int")


def content_id(c: Column) -> Column:
    """Hex MD5 of the UTF-8 bytes."""
    return F.md5(c)


def duration(seconds: Column) -> Column:
    """``Xh Ym`` from an hour on, ``Xm`` from a minute on, else ``Xs``."""
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )
