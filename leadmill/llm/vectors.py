"""What the operators on vectors share: the rows with a usable vector, and dense blocks of them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor infinite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def of_one_length(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length (ties: the longest), and that length; 0 without rows. The lengths are
    counted by Spark, and only the first comes to the driver."""
    most = df.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (df.where(F.size(column) == most["d"]), most["d"]) if most else (df, 0)


def block(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """A list column of vectors of one length as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(matrix).ravel()))
