"""Which vectors take part in a search, and their bytes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_column


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Return (id, digest binary, vector binary): the vector as little-endian doubles.

    Vector and digest are null for a vector that is null, empty or zero, or holds null
    or non-finite components. Equal vectors have equal digests (-0.0 counts as 0.0).
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("values"))

    def make():
        def of(batch: list) -> list[list]:
            vectors, digests = [], []
            for v in batch:
                x = None if v is None else np.array(v, dtype="<f8") + 0.0
                fit = x is not None and len(x) and np.isfinite(x).all() and x.any()
                vectors.append(x.tobytes() if fit else None)
                digests.append(hashlib.md5(vectors[-1]).digest() if fit else None)
            return [digests, vectors]

        return of

    return by_column(rows, "values", make, "digest binary, vector binary")


def matrix(vectors, dims: int | None = None) -> np.ndarray:
    """Rows of equal length as a matrix."""
    rows = [np.frombuffer(v, "<f8") for v in vectors]
    return np.stack(rows) if rows else np.empty((0, dims or 0))
