"""Distances between rows of vectors, as dense array kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """An Arrow list column as a matrix in double precision; rows must have `dimension` values."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if column.null_count or (lengths != dimension).any():
        raise ValueError(f"vectors of {dimension} values are needed")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def distances(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Rows are vectors, columns queries; smaller is nearer. l2 is squared, cosine is 1 - similarity, dot is 1 - product."""
    product = vectors @ queries.T
    if metric == "dot":
        return 1 - product
    a, b = np.einsum("ij,ij->i", vectors, vectors), np.einsum("ij,ij->i", queries, queries)
    if metric == "cosine":
        norm = np.sqrt(a)[:, None] * np.sqrt(b)[None]
        return 1 - np.divide(product, norm, out=np.zeros_like(product), where=norm > 0)
    if metric != "l2":
        raise ValueError(f"unknown metric {metric}")
    return np.maximum(a[:, None] + b[None] - 2 * product, 0)
