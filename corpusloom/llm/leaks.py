"""Evaluation passages inside training documents, found by greedy string tiling.

1. Seeds: every run of ``seed`` words of an item (all its words if it has fewer) is hashed. Documents are hashed word by
   word in the JVM and window by window in Arrow batches; only windows whose hash is set in a bitmap of the item seeds
   leave the scan. The bitmap has 16 bits a seed, between 2 and 64 MB; beyond some 32 million seeds it fills up and lets more windows through to the exact match, an equi-join on the seed hash.
2. A pair that holds a passage, or enough of an item in any order, shares so many of its seeds that one is left when the
   item's most frequent ones are put aside. Pairs meet on those others only, which loses none and keeps stock phrases
   from joining everything.
3. Texts are cut down to the documents of those pairs before they are shuffled, while these are up to a million ids.
4. Greedy string tiling of the pair's real words: the longest non-overlapping common runs, found with a running
   Karp-Rabin hash and checked word by word, are marked until none reaches the minimum. The tiles give the longest
   passage and the share of the item they cover together, whatever their order.

Defined results
  * words are longest runs of letters and digits, lower-cased; null texts and texts without words have no matches;
  * an item counts as leaked into a document that holds ``passage`` consecutive words of it, or all of an item with
    fewer words;
  * rows with one id give a pair once, with the best of their tilings; rows with a null id are left out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

PASSAGE, SEED, COVERAGE = 13, 5, 0.7
#: Bits of the seed bitmap, at least and at most (2 and 64 MB), and the slices that are filled each in a task.
_LEAST_BITS, _MOST_BITS, _SLICES = 1 << 24, 1 << 29, 256
#: Ids of documents to tile that are broadcast to cut the texts down; with more, the texts are joined by a shuffle.
MAX_SENT_IDS = 1_000_000
#: Starts of common runs looked at together.
_STARTS = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def window_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of ``width`` word hashes, modulo 2^64, with a final mix."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        h = h * _MULT + flat[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_SEEDS = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("width", pa.int32()), ("words", pa.int32()), ("h", pa.int64())])
_SEED_DDL = "id bigint, pos int, width int, words int, h bigint"


def _windows(batch: pa.RecordBatch, widths: list[int], own_width: int | None, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Seeds of a batch of (id, hashes). own_width: only the width min(own_width, words) of each row."""
    lists = batch.column("hashes")
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    row_of = np.repeat(np.arange(len(ids)), np.diff(offsets))
    flat = flat[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    for w in widths:
        h = window_hashes(flat, w)
        at = np.arange(len(h))
        keep = at + w <= offsets[row_of[: len(h)] + 1]
        if own_width is not None:
            keep &= np.minimum(length[row_of[: len(h)]], own_width) == w
        if bits is not None:
            slot = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
            keep &= (bits[slot >> 3] >> (slot & 7) & 1).astype(bool)
        k = np.flatnonzero(keep)
        rows = row_of[k]
        yield pa.record_batch(
            [pa.array(ids[rows], pa.int64()), pa.array((k - offsets[rows]).astype(np.int32)), pa.array(np.full(len(k), w, np.int32)), pa.array(length[rows].astype(np.int32)), pa.array(h[k].view(np.int64))],
            schema=_SEEDS,
        )


def _hashed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), word_hashes(F.col(text)).alias("hashes")).filter("id IS NOT NULL AND size(hashes) > 0")


def item_seeds(items: DataFrame, id_col: str, text: str, seed: int) -> DataFrame:
    """id, pos, width, h, words: every seed of every item."""

    def run(batches):
        for b in batches:
            yield from _windows(b, list(range(1, seed + 1)), seed, None)

    return _hashed(items, id_col, text).mapInArrow(run, _SEED_DDL)


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """One bit per slot of the seed hashes. Each slice is filled in a task of its own."""
    bits = _LEAST_BITS
    n = seeds.count()
    while bits < min(16 * n, _MOST_BITS):
        bits *= 2
    size = bits // _SLICES
    slots = seeds.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.zeros(size, dtype=bool)
        at[pdf["slot"].to_numpy() % size] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(at, bitorder="little").tobytes()]})

    total = np.zeros(bits >> 3, dtype=np.uint8)
    slices = slots.groupBy(F.floor(F.col("slot") / size).cast("int").alias("slice")).applyInPandas(fill, "slice int, bits binary")
    for row in slices.toLocalIterator():
        total[row["slice"] * size // 8 : (row["slice"] + 1) * size // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return total


def _common_runs(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in x, start in y, length) of the longest runs on each diagonal that x and y share, of ``least`` at least.

    Windows with equal Karp-Rabin hashes are compared word by word and joined along their diagonal, a bounded number at a time.
    """
    hx, hy = window_hashes(x, least), window_hashes(y, least)
    order = np.argsort(hx, kind="stable")
    low, high = (np.searchsorted(hx[order], hy, side) for side in ("left", "right"))
    at = np.flatnonzero(high > low)
    n = (high - low)[at]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // _STARTS)) + 1
    runs = [np.zeros((0, 3), np.int64)]
    for j, k in zip(np.split(at, cuts), np.split(n, cuts)):
        ends = np.cumsum(k)
        if not len(ends):
            continue
        i = order[np.repeat(low[j] - (ends - k), k) + np.arange(ends[-1])]
        j = np.repeat(j, k)
        same = np.ones(len(i), dtype=bool)
        for w in range(least):
            same &= x[i + w] == y[j + w]
        i, j = i[same], j[same]
        runs.append(_joined(j - i, i, np.ones(len(i), np.int64), len(x)))
    d, i, k = _joined(*np.concatenate(runs).T, len(x)).T
    return i, i + d, k + least - 1


def _joined(d: np.ndarray, i: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Rows (diagonal, start, starts) with neighbours along a diagonal made one."""
    order = np.argsort(d * width + i, kind="stable")
    d, i, n = d[order], i[order], n[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + n[:-1])
    starts = np.flatnonzero(new)
    return np.stack([d[new], i[new], np.add.reduceat(n, starts) if len(starts) else n], axis=1)


def tiles(a: np.ndarray | list, b: np.ndarray | list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of the longest non-overlapping common runs, longest first.

    Common runs are taken by length, then by place in b; of one that is marked in part, the rest of ``least`` words or
    more waits for its turn. It ends when no run or no ``least`` unmarked words are left. Words are numbers, as 64-bit
    hashes, or strings.
    """
    if not len(a) or not len(b):
        return []
    x, y = np.asarray(a), np.asarray(b)
    if x.dtype != np.int64:
        x, y = np.split(np.unique(np.concatenate([x, y]), return_inverse=True)[1].astype(np.int64), [len(x)])
    i, j, n = _common_runs(x.view(np.uint64), y.view(np.uint64), least)
    if not len(i):
        return []
    order = np.lexsort((i, j, -n))
    free_x, free_y = np.ones(len(x), dtype=bool), np.ones(len(y), dtype=bool)
    out: list[tuple[int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []  # (-length, start in b, start in a) of parts of runs
    k, left = 0, min(len(x), len(y))
    while left >= least and (k < len(order) or waiting):
        following = (-int(n[order[k]]), int(j[order[k]]), int(i[order[k]])) if k < len(order) else None
        if waiting and (following is None or waiting[0] < following):
            size, at_b, at_a = heapq.heappop(waiting)
        else:
            (size, at_b, at_a), k = following, k + 1
        size = -size
        free = free_x[at_a : at_a + size] & free_y[at_b : at_b + size]
        if free.all():
            free_x[at_a : at_a + size] = free_y[at_b : at_b + size] = False
            out.append((at_a, at_b, size))
            left -= size
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= least:
                heapq.heappush(waiting, (s - e, at_b + s, at_a + s))
    return out


def leaks(
    docs: DataFrame,
    items: DataFrame,
    passage: int = PASSAGE,
    seed: int = SEED,
    coverage: float = COVERAGE,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    doc_text: str = "text",
    item_text: str = "text",
) -> DataFrame:
    """item, doc, words (of the item), longest (tile), covered (words of the item in tiles), exact.

    ``exact``: the longest tile has ``passage`` words or the whole item. Pairs whose tiles cover ``coverage`` of the
    item come out too, with exact false: an item whose sentences were reordered.
    """
    seeds = materialise(item_seeds(items, item_id, item_text, seed), "leak-seeds")
    widths = sorted(r[0] for r in seeds.select("width").distinct().collect())  # at most ``seed`` numbers
    bits = docs.sparkSession.sparkContext.broadcast(seed_bitmap(seeds))

    def scan(batches):
        for b in batches:
            yield from _windows(b, widths, None, bits.value)

    hits = materialise(_hashed(docs, doc_id, doc_text).mapInArrow(scan, _SEED_DDL).select(F.col("id").alias("doc"), "width", "h").distinct(), "leak-hits")
    # A pair worth tiling shares at least ``need`` seeds: enough for a passage, or to cover the share asked for. Then it
    # shares one that is not among the item's need - 1 most frequent, so those join nothing.
    usual = hits.groupBy("width", "h").agg(F.count(F.lit(1)).alias("n"))
    need = F.least(F.least(F.lit(passage), F.col("words")) - F.col("width") + 1, F.ceil(F.lit(coverage) * F.col("words") / F.col("width")))
    rare = seeds.join(usual, ["width", "h"]).withColumn("at", F.row_number().over(Window.partitionBy("id", "words").orderBy(F.desc("n"), "h", "pos"))).filter(F.col("at") >= need)
    pairs = hits.join(rare.select("width", "h", F.col("id").alias("item")).distinct(), ["width", "h"]).select("doc", "item").distinct()
    pairs = materialise(pairs, "leak-pairs")
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(doc_text).alias("dt"))
    wanted = pairs.select("doc").distinct()
    if wanted.limit(MAX_SENT_IDS + 1).count() <= MAX_SENT_IDS:
        texts = texts.join(F.broadcast(wanted), "doc", "left_semi")
    asked = pairs.join(items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("it")), "item")
    both = texts.join(asked, "doc").select("doc", "item", word_hashes(F.col("dt")).alias("dw"), word_hashes(F.col("it")).alias("iw"))

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, i, dw, iw in zip(pdf["doc"], pdf["item"], pdf["dw"], pdf["iw"]):
                t = tiles(iw, dw, min(seed, len(iw)))
                longest, covered = max((n for *_, n in t), default=0), sum(n for *_, n in t)
                rows.append((i, d, len(iw), longest, covered, longest >= min(passage, len(iw))))
            yield pd.DataFrame(rows, columns=["item", "doc", "words", "longest", "covered", "exact"])

    tiled = both.mapInPandas(tile, "item bigint, doc bigint, words int, longest int, covered int, exact boolean")
    best = tiled.groupBy("item", "doc").agg(F.max("words").alias("words"), F.max("longest").alias("longest"), F.max("covered").alias("covered"), F.bool_or("exact").alias("exact"))
    return best.filter(F.col("exact") | (F.col("covered") >= coverage * F.col("words")))
