"""Pluggable functions: embedding, lemmas, answers, concepts; with plain defaults."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """A repeatable stand-in for a model: signed counts of hashed words, normalised."""
    v = np.zeros(size)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % size] += 1 if h & 1024 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(text: str | Column, model: Callable[[str], list[float]] = hashed_vector) -> Column:
    """array<float> of each text by a model that is called batch by batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(model)

    return run(text)


def lemmatise(words: Column, analyser: Callable[[str], str] | None = None) -> Column:
    """Lemmas of an array of words: the analyser's, or suffix stripping in column functions."""
    if analyser is None:
        from stacklore.functions.text import strip_suffix

        return F.transform(words, strip_suffix)

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ws: [analyser(w) for w in ws])

    return run(words)


def answer_all(cases: DataFrame, answer: Callable[[str], str], judge: Callable[[str, str], float]) -> DataFrame:
    """id, answer, score of each case (id, question)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [answer(q) for q in b["question"]]
            yield pd.DataFrame({"id": b["id"], "answer": out, "score": [float(judge(q, a)) for q, a in zip(b["question"], out)]})

    return cases.select("id", "question").mapInPandas(run, "id long, answer string, score double")


def extract_concepts(chunks: DataFrame, extractor: Callable[[str], list[tuple[str, str, str]]]) -> DataFrame:
    """id, src, rel_type, dst rows that an extractor finds in each chunk's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b["id"], b["text"]) for r in extractor(t or "")]
            yield pd.DataFrame(rows, columns=["id", "src", "rel_type", "dst"])

    return chunks.select("id", "text").mapInPandas(run, "id long, src string, rel_type string, dst string")
