"""Cutting oversized texts into pieces under a limit, at natural boundaries, with overlap.

A recursive separator hierarchy (section, paragraph, sentence, word, character) breaks the body into atoms that fit;
atoms are then packed greedily up to the limit, and each piece starts with trailing atoms of the one before it.

Defined results
  * only texts longer than the limit are cut; others are one piece, unchanged; null texts have no piece, empty ones one;
  * every piece starts with the heading prefix: the heading and an empty line where the text starts with them, else the
    first paragraph if it is a single line that ends in an empty line, else nothing; a prefix that would leave less than an
    eighth of the limit is cut where it does, and the rest of it counts as body;
  * sections end before a heading line (``#`` marks), at two or more empty lines and at form feeds;
  * body_start/body_end are offsets of code points in the text: pieces tile the body, each begins at most ``overlap``
    before the end of the one before it and ends after it, so that no body text is lost;
  * null headings count as empty; repeated rows are cut alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2048, 200
#: Coarse to fine. Each matches the end of an atom, so that joining atoms gives the text again.
_SEPARATORS = tuple(
    re.compile(p)
    for p in (
        r"(?:\r?\n[^\S\n]*){3,}|\f|\n(?=#{1,6} )",
        r"(?:\r?\n[^\S\n]*){2,}",
        r"\n",
        r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』）]*",
        r"\s+",
    )
)


def atoms(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of at most ``limit`` characters that tile text[start:end]; finer separators only where needed."""
    if end - start <= limit:
        yield start, end
        return
    if level == len(_SEPARATORS):
        for s in range(start, end, limit):
            yield s, min(s + limit, end)
        return
    at = start
    for m in _SEPARATORS[level].finditer(text, start, end):
        yield from atoms(text, at, m.end(), limit, level + 1)
        at = m.end()
    if at < end:
        yield from atoms(text, at, end, limit, level + 1)


def pieces(text: str, start: int, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy packing of the atoms of text[start:]: (begin, end) with end - begin <= limit."""
    spans: list[tuple[int, int]] = []
    fresh = False
    for a, b in atoms(text, start, len(text), limit):
        if spans and b - spans[0][0] > limit:
            yield spans[0][0], spans[-1][1]
            fresh = False
            last_end = spans[-1][1]
            room = min(overlap, limit - (b - a))
            back = [s for s in spans if last_end - s[0] <= room and s[0] > spans[0][0]]
            if back:
                spans = back
            elif room > 0 and (w := _word_start(text, max(last_end - room, spans[0][0] + 1), last_end)) is not None:
                spans = [(w, last_end)]
            else:
                spans = []
        spans.append((a, b))
        fresh = True
    if fresh:
        yield spans[0][0], spans[-1][1]


def _word_start(text: str, low: int, high: int) -> int | None:
    m = re.compile(r"\s\S").search(text, low - 1, high)
    return m.start() + 1 if m else None


def prefix_length(text: str, heading: str, limit: int) -> int:
    p = heading + "\n\n"
    if text.startswith(p):
        n = len(p)
    else:
        m = re.match(r"[^\n]*\n[^\S\n]*\n", text)
        n = m.end() if m else 0
    return min(n, limit - limit // 8)


def split_long(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "chunk_no", text: str = "text", heading: str = "heading") -> DataFrame:
    """id, piece_no, piece, body_start, body_end for the rows over the limit. Only those rows reach Python."""
    long = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(heading), F.lit("")).alias("heading"), F.col(text).alias("text")).filter(F.length("text") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, h, t in zip(pdf["id"], pdf["heading"], pdf["text"]):
                n = prefix_length(t, h, limit)
                spans = list(pieces(t, n, limit - n, min(overlap, (limit - n) // 4)))
                yield pd.DataFrame(
                    {
                        "id": pd.array([i] * len(spans), dtype="Int64"),
                        "piece_no": range(1, len(spans) + 1),
                        "piece": [t[:n] + t[a:b] for a, b in spans],
                        "body_start": [a for a, _ in spans],
                        "body_end": [b for _, b in spans],
                    }
                )

    return long.mapInPandas(cut, "id bigint, piece_no int, piece string, body_start bigint, body_end bigint")


def split_texts(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "chunk_no", text: str = "text", heading: str = "heading") -> DataFrame:
    """Pieces of every row: texts within the limit stay in the JVM as one piece."""
    short = df.filter(F.length(text) <= limit).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.lit(1).alias("piece_no"),
        F.col(text).alias("piece"),
        F.lit(0).cast("bigint").alias("body_start"),
        F.length(text).cast("bigint").alias("body_end"),
    )
    return short.unionByName(split_long(df, limit, overlap, id_col, text, heading))
