"""Contributions: amended items counted once, receipts by what their line means, how a giver's money is spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENTITY = ["registrant_name", "lobbyist_name", "filer_type", "filing_year", "contribution_type", "amount", "payee_name", "honoree_name", "date", "contributor_name"]


def once(items: DataFrame, identity: list[str] = IDENTITY) -> DataFrame:
    """Items that agree in all of ``identity``, an original and its amendments, as one: cited by the least filing, with the number of its versions."""
    return items.groupBy(*identity).agg(F.min("filing_uuid").alias("cited"), F.count_distinct("filing_uuid").alias("versions"), F.count(F.lit(1)).alias("raw_items"))


def legs(items: DataFrame, by: dict[str, str | Column]) -> DataFrame:
    """leg, key, items, total: the same items summed in several ways, in one pass over them."""
    pairs = F.array(*[F.struct(F.lit(leg).alias("leg"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("key")) for leg, c in by.items()])
    rows = items.select("amount", F.explode(pairs).alias("p")).select("p.leg", "p.key", "amount")
    return rows.groupBy("leg", "key").agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("total"))


# What a receipt's line number begins with, and what the line is.
LINES = {"11": "contribution", "12": "transfer", "15": "refund_offset", "16": "refund_offset", "17": "other_receipt"}


def line_category(line_number: Column) -> Column:
    out = F.lit("other")
    for start, name in LINES.items():
        out = F.when(F.startswith(line_number, F.lit(start)), name).otherwise(out)
    return F.when(line_number.isNull(), "other").otherwise(out)


def is_person(receipt_type: Column, name: Column) -> Column:
    """By the entity type; where it is missing, by a name such as 'LAST, FIRST'."""
    last = F.trim(F.split_part(F.coalesce(name, F.lit("")), F.lit(","), F.lit(1)))
    shape = F.contains(F.coalesce(name, F.lit("")), F.lit(",")) & (last == F.upper(last)) & last.rlike("[A-Z]") & ~F.contains(last, F.lit(" "))
    return F.when(F.coalesce(receipt_type, F.lit("")) == "", shape).otherwise(F.upper(receipt_type) == "IND")


def receipts(rows: DataFrame) -> DataFrame:
    """Receipts that count, with category and person: memo entries left out, a committee's transaction once, the first by its row's id.

    rows: committee_id, transaction_id, sub_id, memo_code, line_number, entity_type, contributor_name. Rows without a transaction id all count.
    """
    real = rows.filter(F.coalesce("memo_code", F.lit("")) != "X")
    named = real.filter("transaction_id IS NOT NULL")
    first = named.groupBy("committee_id", "transaction_id").agg(F.min("sub_id").alias("sub_id"))
    kept = named.join(first, ["committee_id", "transaction_id", "sub_id"], "left_semi").unionByName(real.filter("transaction_id IS NULL"))
    return kept.withColumns({"category": line_category(F.col("line_number")), "person": is_person(F.col("entity_type"), F.col("contributor_name"))})


def concentrated(items: DataFrame, least_total: float, least_share: float) -> DataFrame:
    """giver, recipient, amount, share: givers of at least ``least_total`` of which one recipient has ``least_share`` or more."""
    to = items.groupBy("giver", "recipient").agg(F.sum("amount").alias("amount"))
    total = to.groupBy("giver").agg(F.sum("amount").alias("total")).filter(F.col("total") >= least_total)
    return to.join(total, "giver").withColumn("share", F.col("amount") / F.col("total")).filter(F.col("share") >= least_share).drop("total")
