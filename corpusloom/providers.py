"""Embedding and generation as providers, so that everything else runs offline."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompt: str, max_tokens: int) -> str: ...


class HashEmbedder:
    """Feature hashing of words into ``dim`` signed buckets: deterministic, needs no model."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            words = t.lower().split()
            if words:
                h = pd.util.hash_array(np.array(words, dtype=object))
                np.add.at(out[i], (h % self.dim).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embedded(df: DataFrame, embedder: Embedder, key: str, text: str) -> DataFrame:
    """key, v: one vector per row with a text, in Arrow batches. Give it distinct keys: each row costs a model call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "v": list(embedder(pdf["text"].tolist()))})

    slim = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL")
    return slim.mapInPandas(run, "key string, v array<float>")
