"""Column functions over vectors as arrays, and the half-precision rounding of stored vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .text import col


def prefix(vector, dim: int) -> Column:
    """The first dim elements; a vector of fewer raises."""
    v = col(vector)
    short = F.raise_error(F.concat(F.lit(f"dimension {dim} is more than the native "), F.size(v).cast("string")))
    return F.when(v.isNull(), F.lit(None)).when(F.size(v) < dim, short).otherwise(F.slice(v, 1, dim))


def doubles(vector) -> Column:
    return F.transform(col(vector), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector) -> Column:
    return F.sqrt(dot(vector, vector))


def renorm(vector) -> Column:
    """Scaled to unit length; a zero vector stays zero."""
    n = norm(vector)
    return F.transform(doubles(vector), lambda x: x / F.when(n > 0, n).otherwise(1.0))


def query_renorm(vector, eps: float = 1e-12) -> Column:
    """Divided by the length plus eps, the other rule for queries; for vectors of ordinary length the same as renorm."""
    n = norm(vector)
    return F.transform(doubles(vector), lambda x: x / (n + eps))


def center(vector, mean) -> Column:
    return F.zip_with(doubles(vector), col(mean), lambda x, m: x - m)


def inverse_root(values, eps: float = 1e-6) -> Column:
    return F.transform(col(values), lambda s: 1 / F.sqrt(s + eps))


def half(vector) -> Column:
    """Rounded to half precision and back, as vectors come out of half-precision storage."""

    @F.pandas_udf(ArrayType(FloatType()))
    def rounded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return rounded(col(vector))
