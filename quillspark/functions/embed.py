"""Embeddings behind a small protocol, applied in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.schema import DIMENSION

#: Words of a text that are embedded; the rest is cut off, as models do.
MOST_WORDS = 512


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of single-precision numbers for each text."""


class HashingEmbedder:
    """Deterministic and without a model: words vote on signed, hashed dimensions; the mean over words, not normalised."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()[:MOST_WORDS]
            for w in words:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
            row /= max(1, len(words))
        return out


def resolve(disabled: bool = False, load: Callable[[], Embedder] | None = None) -> Embedder | None:
    """The embedder that ``load`` gives; none if embedding is off or it cannot be had: search by keyword goes on."""
    if disabled or load is None:
        return None
    try:
        return load()
    except Exception:  # noqa: BLE001  whatever a model's loader raises
        return None


def embedded(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType(), False))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed(texts.fillna("").tolist())))

    return run(text)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the second axis of ``states[text, token, dimension]`` where ``mask[text, token]`` is set."""
    weight = mask[..., None].astype(states.dtype)
    return (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
