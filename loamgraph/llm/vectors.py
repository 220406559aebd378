"""Reading vectors: validity, packing into blocks, exact cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(v: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    d = v.cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(d, fine) & F.exists(d, lambda x: x != 0), F.lit(False))


def matrix(lists, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix."""
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that lengths neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which changes no digit: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision: products are added in order, so that equal rows give equal values wherever they stand, in SQL too."""
    a, b = scaled(a), scaled(b)
    dot, p, q = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        dot += x * y
        p += x * x
        q += y * y
    return np.clip(dot / np.sqrt(p * q), -1, 1)


def sample_of(rows: DataFrame, size: int, tag: str, column: str = "embedding") -> np.ndarray:
    """About `size` rows' vectors of one dimension, by a hash of the vector: a bounded sample, empty for an empty table."""
    from .common import by_hash

    total = rows.count()
    got = rows.filter(by_hash(F.xxhash64(column, F.lit(tag)), size, total)).select(column).toArrow().column(0)
    return matrix(got.combine_chunks(), len(got[0])) if len(got) else np.zeros((0, 0))


def dimensions(vectors: DataFrame, column: str = "embedding") -> list[int]:
    """The sizes that vectors have, most rows first: vectors of different sizes are never compared."""
    rows = vectors.groupBy(F.size(column).alias("d")).count().filter("d > 0").collect()
    return [r["d"] for r in sorted(rows, key=lambda r: (-r["count"], r["d"]))]
