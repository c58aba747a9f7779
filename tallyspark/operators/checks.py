"""Gates: what must hold before a result is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, after a count that both tables have as many rows; else an error names the two."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return left


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """keys, was, now, change: 'reproduced' within the tolerance, 'changed', 'added' or 'lost'. A regression has no lost row."""
    a = old.select(*keys, F.col(value).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("now"), F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full")
    near = F.coalesce(F.abs(F.col("was") - F.col("now")) <= tolerance, F.col("was").isNull() & F.col("now").isNull())
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "lost").when(near, "reproduced").otherwise("changed")
    return both.select(*keys, "was", "now", change.alias("change"))


def partitioned(parts: DataFrame, whole: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """Keys at which the parts' sum isn't the whole's, or that only one of them has; must be empty."""
    summed = parts.groupBy(*keys).agg(F.sum(value).alias(value))
    return difference(whole, summed, keys, value, tolerance).filter("change <> 'reproduced'")
