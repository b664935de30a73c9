"""Hashed linear models trained on bounded samples, and sampling for them."""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
#: Bytes of features that a sample may bring to the driver.
SAMPLE_BYTES = 128 << 20


@functools.lru_cache(maxsize=1 << 16)
def bucket(word: str, bits: int = BITS) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) * 2654435761 % (1 << 32) >> (32 - bits)


def sample_by_hash(df: DataFrame, size: int, rows: int, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """About `size` of the rows (of which there are `rows`), chosen by a hash of the key: the same ones on every run.

    Never more than 2 * size: where a key repeats that often, those with the smallest hashes and values stand.
    """
    share = min(1.0, size / max(1, rows))
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30))
    chosen = df.where(place < math.ceil(share * (1 << 30)))
    return chosen.orderBy(place, *df.columns).limit(2 * size)


def size_within(size: int, rows: int, total_bytes: int, budget: int = SAMPLE_BYTES) -> int:
    """The size of a sample of which about `budget` bytes at most come to the driver."""
    return min(size, int(budget / max(1, total_bytes) * rows)) if total_bytes > 0 else size


class Logistic:
    """Logistic regression on sparse rows (indices, values), for soft labels, by averaged Adagrad in a fixed order."""

    def __init__(self, size: int, classes: int = 1):
        self.weights, self.bias = np.zeros((classes, size), np.float64), np.zeros(classes)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray | None = None, rounds: int = 6, rate: float = 0.3, l2: float = 1e-5, seed: int = 5) -> Logistic:
        """labels: shares of each class, a row each (a column of probabilities for one class)."""
        labels = labels.reshape(len(rows), -1)
        weights = np.ones(len(rows)) if weights is None else weights
        seen, seen_bias = np.full_like(self.weights, 1e-6), np.full_like(self.bias, 1e-6)
        order = np.random.Generator(np.random.PCG64(seed))
        for _ in range(rounds):
            for i in order.permutation(len(rows)):
                at, value = rows[i]
                slope = (self._shares(self.weights[:, at] @ value + self.bias) - labels[i]) * weights[i]
                g = slope[:, None] * value + l2 * self.weights[:, at]
                seen[:, at] += g * g
                self.weights[:, at] -= rate * g / np.sqrt(seen[:, at])
                seen_bias += slope * slope
                self.bias -= rate * slope / np.sqrt(seen_bias)
        return self

    def _shares(self, z: np.ndarray) -> np.ndarray:
        if len(self.bias) == 1:
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def shares(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The probability of each class (of the one class)."""
        return self._shares(self.weights[:, at] @ value + self.bias)
