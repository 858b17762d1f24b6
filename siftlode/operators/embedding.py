"""Embedding texts: a protocol, a deterministic hashing embedder, and checks of what an embedder returns."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlode.functions.text import embedding_text, words_of


class Embedder(Protocol):
    """Anything that turns texts into vectors of one length."""

    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Words hashed to signed positions, length one. Needs no model and no network."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            for w in words_of(t):
                h = hashlib.md5(w.encode()).hexdigest()
                out[i, int(h[:8], 16) % self.dimension] += 1 if h[8] >= "8" else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()


class EmbeddingError(RuntimeError):
    pass


class Retrying:
    """An embedder that asks another again when it fails for a passing reason: too many requests or a server's error.

    An error counts as passing if it has such a ``status``; others are raised at once.
    """

    def __init__(self, inner: Embedder, waits: tuple[float, ...] = (1, 2, 4), sleep: Callable[[float], None] = time.sleep):
        self.inner, self.waits, self.sleep, self.dimension = inner, waits, sleep, inner.dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        for wait in (*self.waits, None):
            try:
                return self.inner.embed_batch(texts)
            except Exception as e:
                status = getattr(e, "status", None)
                if wait is None or not (status == 429 or isinstance(status, int) and 500 <= status < 600):
                    raise
                self.sleep(wait)
        raise AssertionError


def detected_dimension(embedder: Embedder) -> int:
    """The length of what an embedder returns for a short text."""
    return len(embedder.embed_batch(["test"])[0])


def checked(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """The vectors of a batch; an error if their number or any length is wrong, so that the whole write fails."""
    got = embedder.embed_batch(texts)
    if not isinstance(got, list) or len(got) != len(texts):
        raise EmbeddingError(f"embedder returned {len(got) if isinstance(got, list) else type(got).__name__} embeddings for {len(texts)} chunks")
    if any(v is None or len(v) != embedder.dimension for v in got):
        raise EmbeddingError("embedder returned an empty or wrongly sized embedding")
    return got


def embed(embedder: Embedder, text: Column, batch: int = 100) -> Column:
    """A vector column; batches of ``batch`` texts go to the embedder from vectorised Python tasks."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(s: pd.Series) -> pd.Series:
        texts = s.tolist()
        return pd.Series([v for k in range(0, len(texts), batch) for v in checked(embedder, texts[k : k + batch])])

    return run(embedding_text(text))


def with_vectors(chunks: DataFrame, embedder: Embedder, content_col: str = "content") -> DataFrame:
    return chunks.withColumn("vector", embed(embedder, F.col(content_col)))
