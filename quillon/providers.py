"""Models behind interfaces, with deterministic stand-ins that need none.

A provider is created once in every Python worker and called with batches.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx


class EmbeddingProvider(ABC):
    name: str
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """One unit row for each text."""


class PairScorer(ABC):
    @abstractmethod
    def score(self, queries: list[str], texts: list[str]) -> np.ndarray:
        """A relevance for each pair."""


class GenerationProvider(ABC):
    @abstractmethod
    def generate(self, prompts: list[str]) -> list[str]:
        """An answer for each prompt."""


class HashedEmbedding(EmbeddingProvider):
    """Signed hashing of words into a fixed number of dimensions."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.name = dimension, f"hashed-{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


class LengthEmbedding(EmbeddingProvider):
    """One direction for each length of a text, counted round; for tests of plans whose results other engines compute too."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.name = dimension, f"length-{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        out[np.arange(len(texts)), [len(t) % self.dimension for t in texts]] = 1.0
        return out


class OverlapScorer(PairScorer):
    """Share of the query's words that stand in the text."""

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray:
        pairs = [(set(q.lower().split()), set(t.lower().split())) for q, t in zip(queries, texts)]
        return np.array([len(q & t) / len(q) if q else 0.0 for q, t in pairs])


class FirstSentence(GenerationProvider):
    """Answers with the first sentence of the prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.strip().split(". ")[0][:400] for p in prompts]


class CountingQuestion(GenerationProvider):
    """Asks about the length of what it is given; of every seventh length it has no question."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"O que dizem os {len(p)} sinais?" if len(p) % 7 else "" for p in prompts]


def embed(texts: DataFrame, provider: EmbeddingProvider, text: str = "text", cache: DataFrame | None = None) -> DataFrame:
    """The rows with ``embedding``; vectors that a cache (text_sha256, embedding) holds are not computed.

    Distinct texts are computed once. Null texts have a null vector.
    """
    keyed = texts.withColumn("text_sha256", F.when(F.col(text).isNotNull(), tx.embedding_key(F.lit(provider.name), F.col(text))))
    wanted = keyed.where(F.col(text).isNotNull()).select("text_sha256", F.col(text).alias("t")).dropDuplicates(["text_sha256"])
    known = cache.select("text_sha256", "embedding").dropDuplicates(["text_sha256"]) if cache is not None else None
    missing = wanted.join(known.select("text_sha256"), "text_sha256", "left_anti") if known is not None else wanted

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(provider.embed(s.tolist()).astype(np.float32)))

    fresh = missing.select("text_sha256", vectors("t").alias("embedding"))
    every = fresh.unionByName(known) if known is not None else fresh
    return keyed.where(F.col(text).isNotNull()).join(every, "text_sha256", "left").unionByName(keyed.where(F.col(text).isNull()), allowMissingColumns=True)


def pair_score(provider: PairScorer, query: Column, text: Column) -> Column:
    """The provider's score of each pair; null texts and queries count as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(provider.score(q.fillna("").tolist(), t.fillna("").tolist()))

    return score(query, text)


def generate(provider: GenerationProvider, prompt: Column, safe: bool = False) -> Column:
    """The provider's answer to each prompt; null prompts count as empty.

    If ``safe``, a prompt on which the provider fails has a null answer and the others keep theirs.
    """

    def one(text: str) -> str | None:
        try:
            return provider.generate([text])[0]
        except Exception:  # noqa: BLE001 - whatever a model raises
            return None

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in batches:
            texts = p.fillna("").tolist()
            yield pd.Series([one(t) for t in texts] if safe else provider.generate(texts), dtype=object)

    return answer(prompt)
