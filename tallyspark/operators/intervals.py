"""Points in time against a key's intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import small


def as_of(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, label: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """points with label and source: of its key's intervals the first that holds the date ('dated'), else the nearest
    by either end ('nearest'), else, without a date, the one that ends last ('latest'); null where the key has none.

    A key's intervals travel as one sorted array, so a point meets one row and nothing is exploded or
    regrouped. That suits intervals of which a key has few, such as a person's terms. The arrays are broadcast where
    there are at most ``max_broadcast`` intervals, counted; beyond that Spark joins by a shuffle and can split a hot key.
    """
    span = F.struct(F.col(start).alias("a"), F.col(end).alias("b"), F.col(label).alias("label"))
    per = intervals.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    t = F.col(at)

    def rank(s: Column) -> Column:
        inside = t.between(s["a"], s["b"])
        away = F.when(t.isNull(), -F.unix_date(s["b"])).when(inside, F.lit(0)).otherwise(F.least(F.abs(F.date_diff(t, s["a"])), F.abs(F.date_diff(t, s["b"]))))
        source = F.when(t.isNull(), "latest").when(inside, "dated").otherwise("nearest")
        return F.struct(away.alias("away"), s["a"].alias("a"), s["b"].alias("b"), s["label"].alias("label"), source.alias("source"))

    found = points.join(small(per, max_broadcast, rows=intervals), F.col(key) == F.col("__key"), "left").withColumn("__best", F.array_min(F.transform("__spans", rank)))
    return found.select(*[F.col(f"`{c}`") for c in points.columns], F.col("__best.label").alias(label), F.col("__best.source").alias("source"))
