"""Packing documents into containers of fixed capacity by the sum-of-squares rule.

Documents are spread over shards by a hash of their id. In a shard each document goes to the fill level that minimises
the sum over levels of squared counts of partly filled containers; the counts live in one array of ``capacity`` levels,
so a shard's state has a fixed size whatever it holds. Only documents over the capacity are cut: into full containers and
one rest, which is packed like a document.

Defined results
  * a token is a longest run of letters, digits and underscores, or of other characters that are not white space;
  * null and blank texts have no tokens: they take no room and share container 0 of their shard;
  * repeated rows are packed separately; an empty table gives none; the tables' own token counts are not used;
  * a shard is packed in the order of a hash of the id, so the result does not depend on how the rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
#: Documents of one shard, on average. Each shard leaves some containers partly filled, one or two of them on the test
#: tables, so more rows mean more shards of the same size and the same share of loss.
SHARD_ROWS = 40_000
_TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]+"

_OUT = "id bigint, part_no int, container string, first_token bigint, n_tokens bigint"


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(_TOKEN)), F.lit(0)).cast("bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (0 < size <= capacity), placed one after the other."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[h]: open containers filled to h
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        top = capacity - s
        best, level = 2 * count[s] + 1 if s < capacity else 0, 0  # a new container
        if top > 0:
            # Moving one container from h to h+s changes the sum by 2(count[h+s] - count[h] + 1); level `capacity` is closed.
            gain = count[1 + s : capacity + 1] - count[1 : top + 1]
            gain = np.where(count[1 : top + 1] > 0, 2 * gain + 2, np.iinfo(np.int64).max)
            gain[top - 1] = -2 * count[top] + 1 if count[top] else np.iinfo(np.int64).max
            h = int(gain.argmin()) + 1
            if gain[h - 1] <= best:
                level = h
        if level:
            b = at[level].pop()
            count[level] -= 1
        else:
            b, made = made, made + 1
        out[i] = b
        if level + s < capacity:
            count[level + s] += 1
            at[level + s].append(b)
    return out


def pack(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, part_no, container, first_token, n_tokens: where each document, or each part of one over the capacity, goes."""
    shards = max(1, -(-df.count() // shard_rows))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), token_count(F.col(text)).alias("n"))
    # Repeats of one id are counted map-side and numbered again, so that they spread over the shards like other rows.
    docs = docs.groupBy("id", "n").agg(F.count(F.lit(1)).alias("copies")).select("id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    docs = docs.select("id", "n", F.pmod(F.xxhash64("id", "n", "copy"), F.lit(shards)).cast("int").alias("shard"))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (shard,) = key
        ids = pdf["id"].fillna(-1).to_numpy(dtype=np.int64)
        pdf = pdf.iloc[np.lexsort((pdf["n"], ids, pd.util.hash_array(ids)))]
        n = pdf["n"].to_numpy()
        whole, tail = n // capacity, n % capacity
        order = np.flatnonzero(tail)
        box = np.zeros(len(n), dtype=np.int64)
        box[order] = sum_of_squares(tail[order], capacity) + 1
        used = int(box.max(initial=0)) + 1
        # One full container for each whole capacity's worth of a document, then its rest.
        doc = np.repeat(np.arange(len(n)), whole)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
        has_tail = (tail > 0) | (n == 0)
        rows = np.concatenate([doc, np.flatnonzero(has_tail)])
        part_no = np.concatenate([part, whole[has_tail]])
        number = np.concatenate([used + np.arange(len(doc)), box[has_tail]])
        size = np.concatenate([np.full(len(doc), capacity), tail[has_tail]])
        return pd.DataFrame(
            {
                "id": pdf["id"].to_numpy()[rows] if len(rows) else pd.array([], dtype="Int64"),
                "part_no": (part_no + 1).astype("int32"),
                "container": [f"{shard}-{b}" for b in number],
                "first_token": part_no * capacity,
                "n_tokens": size,
            }
        )

    # As many partitions as shards, named so that they are not merged into one task.
    return docs.repartition(shards, "shard").groupBy("shard").applyInPandas(place, _OUT)
