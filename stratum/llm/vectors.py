"""Vectors as matrices inside tasks, and the small helpers of both searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id and v (array of double) of the rows whose id and vector are given and finite; zero: whether a zero vector counts."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & (F.size(v) > 0))
    return rows if zero else rows.where(F.exists(v, lambda x: x != 0))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of the lists as doubles; shorter lists end in zeros, which adds nothing to an inner product."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    size = np.diff(at)
    if len(size) and (size == width).all():
        return flat[at[0] : at[-1]].reshape(-1, width)
    out = np.zeros((len(size), width))
    for i, n in enumerate(size.tolist()):
        n = min(n, width)
        out[i, :n] = flat[at[i] : at[i] + n]
    return out


def lists(table: pa.Table, column: str) -> pa.ListArray:
    """A column of lists as one array."""
    whole = table.column(column).combine_chunks()
    return whole if not isinstance(whole, pa.ChunkedArray) else whole.chunk(0) if whole.num_chunks else pa.array([], whole.type)


def width(*columns: pa.ListArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max()) for c in columns if len(c)), default=0)


def divisible(by: int, column: str = "vec_id") -> Column:
    return F.col(column) % by == 0


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of found(query_id, vec_id, score)."""
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
