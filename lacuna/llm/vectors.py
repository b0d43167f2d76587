"""What the operators on embedding vectors share: which rows take part, and their integer components."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine)


def common_length(rows: DataFrame, column: str, multiple: int = 1) -> int:
    """The length that most rows have (the greater of ties) among positive multiples of `multiple`; 0 if there is none. column holds lengths."""
    counts = rows.where((F.col(column) > 0) & (F.col(column) % multiple == 0)).groupBy(column).count()
    top = counts.orderBy(F.desc("count"), F.desc(column)).first()
    return int(top[column]) if top else 0


def largest(length: int) -> int:
    """Components are held within this, so that neither an inner product nor a squared distance of two vectors leaves 64 bits."""
    return isqrt((1 << 60) // max(1, length))


def integers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """(rows, length) of floor(scale * component), held within largest(length)."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    top = float(largest(length))
    return np.clip(np.floor(np.clip(x, -top, top) * scale), -top, top).astype(np.int64)
