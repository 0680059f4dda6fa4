"""Pluggable encoders, expanders and scorers with offline defaults."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    """K4: texts to vectors, a batch at a time. ``is_query`` tells queries from passages."""

    dims: int

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray: ...


class HashingEncoder:
    """Signed hashed counts of words (runs without white space, lower-cased), of unit length; the same text always gives the same vector.

    A word's place is the number of the first eight hex digits of its MD5, modulo ``dims``; the ninth's lowest bit is its sign. Words that cancel each other leave a
    vector without length: their places then hold ``cancelled``."""

    def __init__(self, dims: int = 64, cancelled: float = 0.0):
        self.dims, self.cancelled = dims, cancelled

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        place = lru_cache(100_000)(self._place)
        out, void = np.zeros((len(texts), self.dims)), {}
        for i, text in enumerate(texts):
            counts, met = Counter(text.lower().split()), set()
            for word, n in counts.items():
                at, sign = place(word)
                out[i, at] += sign * n
                met.add(at)
            if not out[i].any():
                void[i] = list(met)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(n == 0, 1, n)
        for i, places in void.items():
            out[i, places] = self.cancelled
        return out

    def _place(self, word: str) -> tuple[int, int]:
        digest = hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()
        return int(digest[:8], 16) % self.dims, 1 if int(digest[8], 16) & 1 else -1


def encode(text: Column, encoder: Encoder, is_query: bool = False) -> Column:
    """K4: vectors of a text column; null counts as empty. Batches go to the encoder as they come from Arrow."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(encoder.encode(batch.tolist(), is_query)))

    return F.transform(run(F.coalesce(text, F.lit(""))), lambda x: F.coalesce(x, F.lit(float("nan"))))  # Arrow takes NaN for null


def project(vec: Column, dims: int, seed: int = 42) -> Column:
    """K6: a seeded random projection to ``dims``, of unit length: one matrix product for the vectors of a batch that have the same size. Null for null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.array([-1 if v is None else len(v) for v in batch])
            out: list = [None] * len(batch)
            for n in np.unique(sizes[sizes >= 0]).tolist():
                if n not in weights:
                    weights[n] = np.random.default_rng(seed).normal(0, 1 / np.sqrt(dims), (n, dims))
                at = np.flatnonzero(sizes == n)
                whole = np.array([np.asarray(batch.iloc[i], float) for i in at]).reshape(len(at), n) @ weights[n]
                length = np.linalg.norm(whole, axis=1, keepdims=True)
                for i, row in zip(at.tolist(), whole / np.where(length == 0, 1, length), strict=True):
                    out[i] = row
            yield pd.Series(out)

    return run(vec)
