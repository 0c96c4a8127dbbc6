"""Sections to overlapping, content-addressed chunks.

A section within the limit is one chunk, heading prefix and line breaks included. A longer one is cut into windows of
words: as many words as fit, at least one; the next window starts an estimated ``overlap`` characters before the end of
this one, at most a quarter of its words. Windows go on until one starts past the last word, so the tail of a section is
repeated in ever smaller windows; ``drop_contained_tails`` leaves those out.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT, OVERLAP = 2048, 200


def windows(words: list[str], room: int, overlap: int = OVERLAP, drop_contained_tails: bool = False) -> Iterator[tuple[int, int]]:
    """(start, count) of each window; a window's words take their lengths plus one each."""
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    start = 0
    while start < len(words):
        count = max(1, bisect_right(ends, ends[start] + room) - 1 - start)
        yield start, count
        if drop_contained_tails and start + count >= len(words):
            return
        per_word = max(1, (ends[start + count] - ends[start]) // count)
        start += max(1, count - min(overlap // per_word, count // 4))


def chunk_sections(df: DataFrame, ids: list[str], heading: str = "heading", text: str = "text", limit: int = LIMIT, drop_contained_tails: bool = False) -> DataFrame:
    """ids, k (1-based), start_word, n_words, chunk_text, chunk_id, token_count for each chunk of each section.

    Null or empty texts have no chunks; a null heading counts as empty. Only sections over the limit go through Python.
    For a section that fits, start_word is 0 and n_words the number of its words.
    """
    s = df.select(*ids, F.concat(F.coalesce(F.col(heading), F.lit("")), F.lit("\n\n")).alias("prefix"), F.col(text).alias("body")).filter("body <> ''")
    fits = F.length("body") <= F.lit(limit) - F.length("prefix")
    short = s.filter(fits).select(*ids, F.lit(1).alias("k"), F.lit(0).alias("start_word"), F.size(T.words(F.col("body"))).alias("n_words"), F.concat("prefix", "body").alias("chunk_text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                words = row.body.split()
                spans = list(windows(words, limit - len(row.prefix), drop_contained_tails=drop_contained_tails))
                if not spans:
                    continue
                out = {c: [getattr(row, c)] * len(spans) for c in ids}
                out |= {"k": range(1, len(spans) + 1), "start_word": [a for a, _ in spans], "n_words": [n for _, n in spans]}
                out["chunk_text"] = [row.prefix + " ".join(words[a : a + n]) for a, n in spans]
                yield pd.DataFrame(out)

    long = s.filter(~fits).mapInPandas(cut, short.schema)
    chunks = short.unionByName(long)
    return chunks.withColumn("chunk_id", T.content_id(F.col("chunk_text"))).withColumn("token_count", T.token_estimate(F.col("chunk_text")))
