"""Vectors in array columns: batches as numpy matrices inside Arrow functions, sign codes as packed bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def test_vector(text: Column, width: int) -> Column:
    """A vector that depends on the text alone, for tests without a model."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (F.pmod(F.xxhash64(text, k), F.lit(2001)) / 1000 - 1).cast("float"))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The batch's vectors as doubles, one a row, cut or filled with zeros to the width; null counts as zero."""
    lists = col.cast(pa.large_list(pa.float64()))
    sizes = np.array([n or 0 for n in lists.value_lengths().to_pylist()], dtype=np.int64)
    values = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width)), np.concatenate(([0], np.cumsum(sizes)))
    for k, n in enumerate(np.minimum(sizes, width)):
        out[k, :n] = values[at[k] : at[k] + n]
    return out


def cosines(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every row with every query, in doubles; 0 if either is zero."""
    sizes = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.divide(rows @ queries.T, sizes, out=np.zeros_like(sizes), where=sizes > 0)


def codes(rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """A bit for each dimension strictly above the mean, eight to a byte."""
    return np.packbits(rows > mean, axis=1)


def distances(coded: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Hamming distance of every code with every query's code."""
    return np.stack([np.bitwise_count(coded ^ q).sum(axis=1, dtype=np.int32) for q in queries], axis=1) if len(queries) else np.zeros((len(coded), 0), dtype=np.int32)
