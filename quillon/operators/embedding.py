"""Embeddings by a pluggable model, for texts that have none yet."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class FakeEmbedder:
    """Unit vectors from the hash of the text, in half precision."""

    def __init__(self, dim: int = 16) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        x = np.stack([np.random.default_rng(int(hashlib.sha256(t.encode()).hexdigest()[:12], 16)).normal(size=self.dim) for t in texts])
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)


class RetryingEmbedder:
    """Asks again where the provider fails, `tries` times with `wait` seconds between; after that it halts: that text and all later ones of the task have no vector."""

    def __init__(self, provider: EmbeddingProvider, tries: int = 5, wait: float = 60.0) -> None:
        self.provider, self.tries, self.wait = provider, tries, wait
        self.halted = False

    def embed(self, texts: list[str]) -> np.ndarray | None:
        for attempt in range(0 if self.halted else self.tries):
            try:
                return self.provider.embed(texts)
            except Exception:  # noqa: BLE001
                if attempt + 1 < self.tries:
                    time.sleep(self.wait)
        self.halted = True
        return None


def sweep(texts: DataFrame, column: str, instructions: dict[str, str], provider: EmbeddingProvider, kind: str = "Query") -> DataFrame:
    """(instruction, column, embedding): each distinct text under each instruction; equal texts are embedded once."""
    rows = None
    for name, instruction in instructions.items():
        told = instructed(texts.where(F.col(column).isNotNull()).select(F.col(column).alias("told"), F.col(column).alias("plain")).distinct(), "told", instruction, kind).withColumn("instruction", F.lit(name))
        rows = told if rows is None else rows.unionByName(told)
    return rows.join(embed_missing(rows, "told", None, provider), "told").select("instruction", F.col("plain").alias(column), "embedding")


def instructed(texts: DataFrame, column: str, instruction: str, kind: str = "Query") -> DataFrame:
    """The column with `Instruct: ...` before it; unchanged for an empty instruction."""
    return texts.withColumn(column, F.concat(F.lit(f"Instruct: {instruction}\n{kind}: "), F.col(column))) if instruction else texts


def embed_missing(texts: DataFrame, column: str, known: DataFrame | None, provider: EmbeddingProvider, batch: int = 2000) -> DataFrame:
    """(column, embedding array<float>) of distinct non-null texts that `known` (column, ...) lacks; append it to known.

    Where the provider gives none (it halted), the texts are left out: the next run, with what was appended, goes on there.
    """
    need = texts.where(F.col(column).isNotNull()).select(column).distinct()
    if known is not None:
        need = need.join(known.select(column), column, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                if (vectors := provider.embed(part[column].tolist())) is not None:
                    yield part.assign(embedding=[v.astype(np.float32).tolist() for v in vectors])

    return need.mapInPandas(run, f"`{column}` string, embedding array<float>")
