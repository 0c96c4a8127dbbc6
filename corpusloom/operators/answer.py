"""Prompts from contexts, answers from a generator, and responses as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..providers import Generator

GUIDELINES = (
    "Answer from the excerpts below only; say so if they do not answer the question.",
    "Cite excerpts as [Source N], all that contribute.",
    "Be brief and cover the key points; use lists where they help.",
)
NO_HITS = "No relevant documentation was found. Try other words or another service."
NO_TEXT = "The relevant documentation could not be read. Please try again."


def prompt(context: Column, question: Column) -> Column:
    """Null without a context: nothing is generated then."""
    rules = "\n".join(f"- {g}" for g in GUIDELINES)
    text = F.concat(F.lit(f"Guidelines:\n{rules}\n\nDocumentation:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))
    return F.when(F.coalesce(context, F.lit("")) != "", text)


def answered(df: DataFrame, generator: Generator, max_tokens: int = 1024) -> DataFrame:
    """qid, answer for rows of (qid, n_hits, prompt); canned answers without hits or without any text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf["qid"], "answer": [generator(p, max_tokens) for p in pdf["prompt"]]})

    ready = df.filter("prompt IS NOT NULL").select("qid", "prompt").mapInPandas(run, "qid bigint, answer string")
    canned = df.filter("prompt IS NULL").select("qid", F.when(F.col("n_hits") > 0, NO_TEXT).otherwise(NO_HITS).alias("answer"))
    return ready.unionByName(canned)


def responses(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, body: JSON with the answer and its sources in order; a question has k sources at most."""
    item = F.struct("n", "service", "heading", "source_url", "distance", "rank")
    listed = sources.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("sources"))
    j = answers.join(listed, "qid", "left")
    none = F.from_json(F.lit("[]"), "array<struct<n int, service string, heading string, source_url string, distance double, rank int>>")
    return j.select("qid", F.to_json(F.struct("answer", F.transform(F.coalesce("sources", none), lambda s: s.dropFields("n")).alias("sources"))).alias("body"))
