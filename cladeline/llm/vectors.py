"""Vector columns: which rows take part, and their values as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length, the greater of equals; 0 if there is none."""
    top = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return int(top["d"]) if top else 0


def usable(vectors: DataFrame, column: str, d: int, zero: bool) -> DataFrame:
    """vec_id, vector (doubles) of rows with a vec_id and d finite components; all zeros only if ``zero``."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if not zero:
        fine = fine & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) == d) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array, d: int, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(-1, d)
