"""Client spend without double counting, and the flags of a filing's quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import latest_by
from ..functions.names import filler_key

# The three ways a period's spend is told.
IN_HOUSE, OVER, OUTSIDE = "in-house total (outside firms subsumed)", "outside sum (in-house filing under-reported)", "outside sum (no in-house filing)"


def canonical_spend(filings: DataFrame, keys: list[str], group: list[str], order: list[Column]) -> DataFrame:
    """Per client and period: in-house and outside sums of the latest filings, the larger one, and what a plain sum counts twice.

    filings has amount and self_filed; keys identify a filing's versions, group a client's period. A filing
    of which isn't known whether it is the client's own counts as an outside firm's; a null amount adds nothing.
    """
    once = latest_by(filings, keys, order).withColumn("self_filed", F.coalesce("self_filed", F.lit(False)))
    sums = once.groupBy(*group).agg(
        F.bool_or("self_filed").alias("has_inhouse"),
        F.coalesce(F.sum(F.when(F.col("self_filed"), F.col("amount"))), F.lit(0)).alias("inhouse"),
        F.coalesce(F.sum(F.when(~F.col("self_filed"), F.col("amount"))), F.lit(0)).alias("outside"),
        F.count(F.lit(1)).alias("n_filings"),
    )
    method = F.when(F.col("has_inhouse") & (F.col("inhouse") >= F.col("outside")), IN_HOUSE).when(F.col("has_inhouse"), OVER).otherwise(OUTSIDE)
    return sums.withColumns({"canonical": F.greatest("inhouse", "outside"), "naive": F.col("inhouse") + F.col("outside"), "counted_twice": F.least("inhouse", "outside"), "method": method})


# Names of the flags, whose meaning other tools know.
FLAGS = "registration_or_termination quarter_number is_amendment has_quarter has_amendment is_duplicate any_change checkme".split()


def flag_versions(filings: DataFrame, keep: str = "latest", drop_registrations: bool = True, clean: bool = True) -> DataFrame:
    """FLAGS of doubtful filings, then one filing per registrant, client, year and period.

    filings: filing_type, registrant, client, filing_year, filing_period, income, expenses, posted and
    filing_uuid, which breaks ties. A filing's like are those of its registrant, client, year and quarter,
    the digits of its type. It needs a look (CHECK) if it is an amendment or repeats an amount of its like,
    if any of its like registers or terminates, or if its like have both a quarter's own report and an
    amendment, or neither. keep: 'latest' or 'earliest' by posted.
    """
    kind = F.col("filing_type")
    own = {"registration_or_termination": kind.rlike("(?i)(RR|T)$"), "quarter_number": F.nullif(F.regexp_extract(kind, r"\d+", 0), F.lit("")).try_cast("int"), "is_amendment": kind.rlike(r"\d+A$")}
    flagged = filings.withColumns(own)
    like = ["registrant", "client", "filing_year", "quarter_number"]
    among, times = Window.partitionBy(*like), lambda c: F.count(F.lit(1)).over(Window.partitionBy(*like, c))
    report = F.col("quarter_number").isNotNull() & ~F.col("is_amendment")
    flagged = flagged.withColumns({"has_quarter": F.bool_or(report).over(among), "has_amendment": F.bool_or("is_amendment").over(among), "is_duplicate": F.greatest(times("income"), times("expenses")) > 1, "any_change": F.bool_or("registration_or_termination").over(among)})
    look = F.col("is_amendment") | F.col("is_duplicate") | F.col("any_change") | (F.col("has_quarter") == F.col("has_amendment"))
    flagged = flagged.withColumn("checkme", F.when(look, "CHECK").otherwise("PASS CHECK"))
    if not clean:
        return flagged
    kept = flagged.filter(~kind.rlike("(?i)RR$")) if drop_registrations else flagged
    posted = F.col("posted").desc_nulls_last() if keep == "latest" else F.col("posted").asc_nulls_last()
    return latest_by(kept, ["registrant", "client", "filing_year", "filing_period"], [posted, F.col("filing_uuid")])


def drop_conflicts(filings: DataFrame, registrant: str = "registrant", client: str = "client") -> DataFrame:
    """Without outside firms' filings for clients that also lobby for themselves anywhere in the table."""
    keyed = filings.withColumns({"__r": filler_key(F.col(registrant)), "__c": filler_key(F.col(client))})
    own = keyed.filter(F.col("__r") == F.col("__c")).select(F.col("__c").alias("__own")).distinct()
    kept = keyed.join(own.withColumn("__hit", F.lit(True)), F.col("__c") == F.col("__own"), "left")
    return kept.filter(F.col("__hit").isNull() | (F.col("__r") == F.col("__c"))).drop("__r", "__c", "__own", "__hit")
