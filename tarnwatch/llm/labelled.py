"""Bounded samples of labelled documents, held-out parts, and logistic regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """Rows from which no label is learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def seeded_sample(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows, by a seeded order of ``id``; n bounds what is broadcast or collected."""
    return ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient, size: int, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Minimises from zero by full-batch Adam; ``gradient`` maps weights to their gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
