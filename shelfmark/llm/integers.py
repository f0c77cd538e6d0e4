"""Vectors of integers floor(256 * x), exact in double precision, for the operators that count in whole numbers.

A product or squared distance of two such vectors is exact in doubles as long as
their squared lengths stay under MOST_SQUARE; a longer vector (a length of about
131,000 before scaling) is an error, never a wrong number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
MOST_SQUARE = float(1 << 50)


def whole(vectors: DataFrame, *kept: str, dimensions: int | None = None, embedding: str = "embedding") -> DataFrame:
    """``kept`` columns, ``v`` (array<int>) and its squared length ``square`` of the vectors that take part.

    Null vectors and those that hold a null or non-finite component take no part, nor
    do vectors of another number of dimensions if one is given. An empty vector takes
    part unless ``dimensions`` says otherwise.
    """
    x = F.col(f"`{embedding}`").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    if dimensions is not None:
        good &= F.size(x) == dimensions
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(*[F.col(f"`{c}`") for c in kept], F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return rows.withColumn("v", F.when(F.col("square") < MOST_SQUARE, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit("a vector is too long for exact whole numbers"))))


def padded(v: Column, dimensions: int) -> Column:
    """``v`` filled up with zeros."""
    return F.concat(v, F.array_repeat(F.lit(0), F.lit(dimensions) - F.size(v)))


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)
