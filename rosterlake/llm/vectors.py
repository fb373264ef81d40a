"""Reading vectors, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: str) -> Column:
    """True for vectors that take part: not NULL, not empty, all components finite, not all zero."""
    component_ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    e = F.col(embedding)
    return F.coalesce(
        (F.size(e) > 0) & F.forall(e, component_ok) & F.exists(e, lambda x: x != 0), F.lit(False)
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without NULLs as double rows, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(column) and lengths.min() == lengths.max() == width:
        return flat.reshape(len(column), width)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out
