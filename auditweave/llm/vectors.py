"""Vectors that can be compared, as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparable(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id (long), v (doubles): the rows that take part, repeated ids once (the smallest vector).

    Null ids and vectors that are null, empty or zero, or hold null or non-finite components, are left out.
    """
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(finite & F.exists(v, lambda x: x != 0), v).alias("v"))
    return rows.dropna().groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix; shorter vectors end in zeros."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    flat, off = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    off = off - off[0]
    size = np.diff(off)
    width = int(size.max(initial=1))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate((x, np.zeros((len(x), width - x.shape[1]))), 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True).clip(1e-300)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(-1, keepdims=True)).clip(1e-300)
