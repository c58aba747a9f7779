"""Dense vectors in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(df: DataFrame, column: str) -> DataFrame:
    """df without rows whose vector is null or has a null or NaN in it."""
    v = F.col(column)
    return df.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
