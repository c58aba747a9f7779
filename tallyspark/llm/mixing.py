"""Mixing sources to target weights by repetition rates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, field, packed, small

#: Hash seeds tried per source; the one whose Bernoulli copies come closest to the target is used.
SEEDS = 16


def words(text: Column) -> Column:
    """Runs of other than the six white-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target of (source, size) rows.

    Sources in code-point order, null last, weigh ``weights`` in turn. They share ``share`` times all
    sizes by weight; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. That ends where every target is min(cap, weight * level): with sources by
    ascending cap / weight, the level is the largest (budget - caps so far) / (weights still open).
    The windows run over one row per source, in one task: sources are named by hand, not one per row.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    still = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / still)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything))
    return per.select("source", "source_size", target.alias("target"))


def _draw(id_: Column, seed: Column) -> Column:
    """A number from 0 up to 1 from 52 bits of the MD5 of id:seed."""
    text = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target, full (copies of every document), part (probability of one more), seed.

    sizes: id, source, size; read twice. A source without words keeps each document once.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rates = cut(source_targets(sizes, weights, share, most).withColumn("rate", rate).select("source", "source_size", "target", F.floor("rate").alias("full"), (F.col("rate") - F.floor("rate")).alias("part")))
    tried = sizes.join(small(rates, 50_000).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    hits = [F.sum(F.when(_draw(F.col("id"), F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"hit{k}") for k in range(SEEDS)]
    tried = tried.groupBy("of").agg(F.max("target").alias("t"), F.max(F.col("full") * F.col("source_size")).alias("base"), *hits)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("base") + F.col(f"hit{k}") - F.col("t")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    tried = tried.select("of", best.alias("seed"))
    return cut(rates.join(tried, F.col("source").eqNullSafe(F.col("of"))).drop("of"))


def _copies(id_: Column) -> Column:
    return (F.col("full") + F.when(_draw(id_, F.col("seed")) < F.col("part"), 1).otherwise(0)).cast("int")


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    Every document is taken floor(rate) times, rate = target / source size, plus once more if a draw
    hashed from its id and its source's seed falls below the fraction; so reruns agree and no document
    exceeds ``most`` copies. Sums are aggregated before their shuffle; the rates, one row per source,
    are broadcast if at most 50,000. Null text has size 0, a null source is a source, a null id draws
    as an empty one, repeated rows draw alike, an empty table gives no rows; other columns are ignored.
    """
    sizes = cut(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size")))
    rates = small(source_rates(sizes, weights, share, most), 50_000).withColumnRenamed("source", "of")
    out = sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies(F.col("id")))
    return out.select("id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """df's rows, each as many times as mix_plan() says; columns as they were, whatever their names. Texts are not shuffled.

    Nulls, repeated rows and empty tables as in mix_plan().
    """
    sizes = cut(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size")))
    rates = source_rates(sizes, weights, share, most).select("source", "full", "part", "seed")
    out = packed(df).join(small(rates, 50_000), field(source_col).eqNullSafe(F.col("source")))
    copies = _copies(field(id_col))
    return out.filter(copies > 0).select("r", F.explode(F.sequence(F.lit(1), copies))).select("r.*")
