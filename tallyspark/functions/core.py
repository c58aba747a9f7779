"""Helpers whose behaviour differs between engines, fixed once here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Ties are the caller's to break."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def quarter_index(year: Column, quarter: Column) -> Column:
    """A running number of quarters, for lags and bands."""
    return (year * 4 + quarter - 1).cast("int")


def number(text: Column) -> Column:
    """Text with thousands separators as a double; null where it isn't a number."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def blank_to_null(text: Column) -> Column:
    """Stripped of any white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def half_even(value: Column) -> Column:
    """A double as a long, halves to the even neighbour."""
    return F.bround(value).cast("long")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are present; null without variance instead of an error."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def distinct_pairs(*parts: Column) -> Column:
    """Distinct tuples, those with a null part included."""
    return F.count_distinct(F.struct(*parts))


def small(df: DataFrame, most: int, rows: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it (or ``rows``, which it is made of) has at most ``most`` rows, counted; else as it is."""
    return F.broadcast(df) if (df if rows is None else rows).limit(most + 1).count() <= most else df


def numbered(df: DataFrame, by: str, name: str, digits: int = 3) -> DataFrame:
    """df with name, the row's number from 1 in the order of ``by``, a distinct hexadecimal hash.

    Rows are numbered within the hash's first digits and shifted by the counts before them, at most
    16 ** digits rows, so no task sorts the whole table.
    """
    lead = F.substring(F.col(by), 1, digits)
    counts = df.groupBy(lead.alias("__lead")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__lead", F.coalesce(F.sum("__n").over(Window.orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__lead").orderBy(by))
    out = df.withColumn("__lead", lead).withColumn(name, own).join(F.broadcast(before), "__lead")
    return out.withColumn(name, F.col(name) + F.col("__before")).drop("__lead", "__before")
