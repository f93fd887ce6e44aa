"""Vectors as arrays: which rows take part, and reading them in batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, and not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; the same two vectors always give the same number."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def sample(df: DataFrame, size: int) -> np.ndarray:
    """The vectors of the `size` rows whose ids hash lowest."""
    rows = df.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    return matrix(rows.column("embedding").combine_chunks()) if rows.num_rows else np.empty((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means on unit rows: centres (unit length; fewer than k if some stay empty) and each row's centre."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    own = np.argmax(x @ centres.T, axis=1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)
