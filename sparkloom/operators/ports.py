"""Where models are plugged in: encoders, pair scorers, generators. A port takes and gives pandas Series in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def encode(load: Callable[[], Callable[[pd.Series], pd.Series]]) -> Callable[[Column], Column]:
    """load() is called once a task and gives texts -> lists of float."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    return run


def score_pairs(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]) -> Callable[[Column, Column], Column]:
    """load() gives (first, second) -> scores. Reranking passes (query, text); scoring expansions passes (text, question)."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for first, second in batches:
            yield model(first.fillna(""), second.fillna(""))

    return run


def generate(df: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], prompt: str, answer: str) -> DataFrame:
    """df with ``answer`` made from the column ``prompt``."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for prompts in batches:
            yield model(prompts)

    return df.withColumn(answer, run(F.col(prompt)))


def overlap_scorer():
    """An offline pair scorer: the share of the first text's distinct words that the second holds."""

    def score(first: pd.Series, second: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            x, y = set(a.lower().split()), set(b.lower().split())
            return len(x & y) / max(len(x), 1)

        return pd.Series([one(a, b) for a, b in zip(first, second, strict=True)], dtype=float)

    return score


def first_sentence_asker():
    """An offline generator: the first six words as a question."""
    return lambda prompts: prompts.fillna("").map(lambda p: " ".join(p.split()[:6]).rstrip(".,;:") + "?")
