"""Vectors as whole numbers, which sums, distances and products are exact on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(vectors: DataFrame, vector_col: str, scale: int, **carried: str) -> DataFrame:
    """``x`` = floor(scale * component) in double precision for each usable row, with the columns ``carried`` (name = column).

    Vectors that are null or hold null or non-finite components take no part, nor do empty ones and those whose length is
    not the one that most vectors have (of two as common, the shorter). Zero vectors and repeated rows do.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(*(F.col(c).alias(name) for name, c in carried.items()), v.alias("x")).where("x is not null and size(x) > 0")
    rows = rows.where("forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (sizes.d if sizes else 1)).withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))


def about(rows: DataFrame):
    """Row of ``n`` rows, their dimension ``d`` and the largest magnitude ``m`` of a component of ``x``."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("m")).first()


def matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``a @ b.T`` of integers, exact; ``most``: the largest magnitude there is. In doubles while all sums fit their 53 bits."""
    if int(most) ** 2 * a.shape[1] < 1 << 52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
