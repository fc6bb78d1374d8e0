"""What the operators on embeddings share: usable vectors, batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows of vectors whose components are all there and finite, as array<double>, and their common length.

    A vector that is null, empty or holds a null, NaN or infinite component is dropped, and so is one of another
    length than most usable vectors have (of lengths that are as frequent, the greatest counts): it has no place among
    the others. Without a usable vector the length is 0.
    """
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = vectors.withColumn(column, F.col(column).cast("array<double>")).where(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)
    most = held.groupBy(F.size(column).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return (held.where(F.size(column) == most["dims"]), most["dims"]) if most else (held, 0)


def scaled(column: str, factor: float, most: int, add: int = 0) -> F.Column:
    """array<long> of floor(factor * x) + add, a product beyond +-most held to that bound."""
    return F.transform(column, lambda x: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x * F.lit(float(factor))))) + F.lit(add).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A row for each list of a column of lists of `dims` items."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
