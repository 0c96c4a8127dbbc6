"""Filtered cosine retrieval, ordered context and per-page sources.

The queries are a stated set, shipped in blocks of bounded size; stored vectors stream past each and every task keeps the
best k per query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Queries shipped to every task at a time; more are asked in as many passes over the stored vectors as it takes.
QUERY_BLOCK = 10_000


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays, in doubles. For few rows; batches go through ``top_k``."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _ask(vectors: DataFrame, rows: list, k: int, label: bool, schema: str) -> DataFrame:
    groups: dict[int, list] = {}
    for r in rows:
        q = np.array([np.nan if x is None else x for x in r["qv"] or []], dtype=np.float64)
        n = np.linalg.norm(q)
        if len(q) and n > 0 and np.isfinite(n):
            groups.setdefault(len(q), []).append((r["qid"], q / n, r["qlabel"] if label else None))
    asked = {dim: (np.array([a for a, *_ in g], dtype=np.int64), np.stack([q for _, q, _ in g]), pd.Series([w for *_, w in g], dtype=object)) for dim, g in groups.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            size = pdf["v"].map(lambda v: 0 if v is None else len(v))
            for dim, (qids, q, labels) in shared.value.items():
                part = pdf[size == dim]
                if part.empty:
                    continue
                x = np.array([[np.nan if e is None else e for e in v] for v in part["v"]], dtype=np.float64)
                norm = np.linalg.norm(x, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                part, x = part[good], x[good] / norm[good, None]
                if part.empty:
                    continue
                found = [] if best is None else [best]
                step = max(1, 4_000_000 // len(x))
                for s in range(0, len(q), step):
                    score = q[s : s + step] @ x.T
                    if label:
                        of = labels.iloc[s : s + step]
                        unseen = of.notna().to_numpy()[:, None] & (of.to_numpy()[:, None] != part["label"].to_numpy(dtype=object)[None, :])
                        score[unseen] = -np.inf
                    # Everything tied with the k-th stays.
                    cut = np.partition(score, len(x) - k, axis=1)[:, len(x) - k, None] if len(x) > k else -np.inf
                    qi, vi = np.nonzero((score >= cut) & (score > -np.inf))
                    found.append(pd.DataFrame({"qid": qids[s + qi], "key": part["key"].to_numpy(dtype=object)[vi], "distance": 1 - score[qi, vi]}))
                best = pd.concat(found).sort_values(["qid", "distance", "key"]).groupby("qid").head(k)
        if best is not None:
            yield best

    return vectors.mapInPandas(nearest, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "key", vector: str = "v", label: str | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, key, distance, rank: the k nearest stored vectors of each query, ties by key.

    ``queries`` has qid (one row each), qv and, with ``label``, qlabel: a query with a label sees only vectors of that
    label, one with a null label all of them. Null, empty, zero and NaN vectors and those of another length than the query
    are not found. Queries are shipped in blocks of about ``block``, by a hash of qid.
    """
    schema = f"qid bigint, key {dict(vectors.dtypes)[key]}, distance double"
    slim = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"), *([F.col(label).alias("label")] if label else []))
    blocks = max(1, -(-queries.count() // block))
    parts = (queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n) if blocks > 1 else queries for n in range(blocks))
    found = reduce(DataFrame.unionByName, (_ask(slim, p.collect(), k, label is not None, schema) for p in parts))
    w = Window.partitionBy("qid").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_text(hits: DataFrame, texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """Hits with their texts, '' where there is none. Hits are k per query; Spark broadcasts them if they are small."""
    return hits.join(texts.select(F.col(key), F.col(text).alias("text")), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def context(hits: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """qid, context, n_blocks: the non-blank texts of each query's hits as numbered blocks in rank order.

    The number of a block is the hit's rank, also where hits without text are left out.
    """
    block = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.upper(F.coalesce("service", F.lit(""))), F.lit(" — "), F.coalesce("heading", F.lit("")),
        F.lit("\nURL: "), F.coalesce("source_url", F.lit("")), F.lit("\n\n"), T.strip(F.col("text")),
    )
    kept = hits.filter(~T.is_blank(F.col("text"))).select("qid", "rank", block.alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return kept.groupBy("qid").agg(blocks.alias("blocks")).select("qid", F.array_join("blocks", separator).alias("context"), F.size("blocks").alias("n_blocks"))


def sources(hits: DataFrame) -> DataFrame:
    """qid, n, rank, service, heading, source_url, distance, similarity: the first hit of each page, renumbered."""
    w = Window.partitionBy("qid", "source_url").orderBy("rank")
    first = hits.filter(F.coalesce(F.col("source_url"), F.lit("")) != "").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return first.select("qid", n.alias("n"), "rank", *[F.coalesce(c, F.lit("")).alias(c) for c in ("service", "heading", "source_url")], F.round("distance", 4).alias("distance"), F.round(1 - F.col("distance"), 4).alias("similarity"))
