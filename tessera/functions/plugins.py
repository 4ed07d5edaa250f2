"""Plug-ins: encoders, tokenizers, generators. Each has a default that needs no network and gives the same result every time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a question is prefixed with for an asymmetric encoder; passages are encoded as they are.
TASK = "Given a question about a report, retrieve the passages that answer it"


def question(text: str, task: str = TASK) -> str:
    return f"Instruct: {task}\nQuery: {text}"


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of word counts, each word at a place and sign given by its CRC."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return encode


def encoded(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "embedding", batch: int = 16) -> DataFrame:
    """``df`` with a vector of each text. ``encoder()`` is called once a Python worker's task, so a model is loaded once and not for each batch."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch]).tolist()])

    return df.withColumn(name, encode(F.col(text)))


def regex_tokenizer(pattern: str, least: int = 2, stop: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """A tokenizer in the form that the index takes: lower-cased matches of at least ``least`` characters that aren't stop words."""

    def tokenize(text: Column) -> Column:
        found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
        return F.filter(found, lambda x: (F.length(x) >= least) & ~x.isin(*stop) if stop else F.length(x) >= least)

    return tokenize


def quoting_generator(question: str, context: str) -> Iterator[str]:
    """The default generator: the passage lines that share a word with the question, as tokens."""
    words = {w for w in question.lower().split() if len(w) > 2}
    lines = [x for x in context.split("\n") if words & set(x.lower().split())]
    yield from (lines[0] if lines else "nothing relevant").split(" ")


def circle(n: int, radius: float = 0.35) -> list[tuple[float, float]]:
    """Places for too few points to lay out: evenly on a circle."""
    return [(0.5 + radius * float(np.cos(2 * np.pi * k / max(n, 1))), 0.5 + radius * float(np.sin(2 * np.pi * k / max(n, 1)))) for k in range(n)]
