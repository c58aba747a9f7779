"""What a package on one issue exports: players, trends, cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import latest_by


def tier(n_filings: Column, core: int = 8, active: int = 3) -> Column:
    return F.when(n_filings >= core, "core").when(n_filings >= active, "active").otherwise("occasional")


def congress_of_year(year: Column) -> Column:
    """The congress that sits in a year; floors for years before the first one counted from, too."""
    return (F.lit(117) + F.floor((year - 2021) / 2)).cast("long")


def cross_check(cites: DataFrame, filings: DataFrame, key: str) -> DataFrame:
    """Per cited item and dataset: filings, clients, registrants and the amount of the filings that cite it.

    cites: item and key; filings: key, dataset, client, registrant, amount. A filing that cites an item twice counts once.
    """
    hits = filings.join(cites.select("item", key).distinct(), key)
    return hits.groupBy("item", "dataset").agg(F.count(F.lit(1)).alias("n_filings"), F.count_distinct("client").alias("n_clients"), F.count_distinct("registrant").alias("n_registrants"), F.sum("amount").alias("amount"))


def givers_of(items: DataFrame, member: int | str, tags: DataFrame) -> DataFrame:
    """Every giver of one member, the largest first by its rank: giver, items, total, tags.

    items: recipient, giver_key, giver, amount; tags: name_key, side, tag. A giver carries only what clients of the same key
    are tagged with; tags of registrants are context and stay in a column of their own.
    """
    own = items.filter(F.col("recipient") == member).groupBy("giver", "giver_key").agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("total"))
    listed = lambda side: F.array_join(F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("tag")))), "; ")
    per = tags.groupBy("name_key").agg(listed("client").alias("tags"), listed("registrant").alias("context_tags"))
    out = own.join(per, F.col("giver_key") == F.col("name_key"), "left")
    return out.select("giver", "items", "total", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("context_tags", F.lit("")).alias("context_tags"))


def engagements(filings: DataFrame, order: list[Column]) -> DataFrame:
    """Pairs with tagged quarters: first, last, how many, their amount, the end, a sample and the basis of the tag.

    filings: registrant, client, qidx, amount, tagged, n_activities, registration, terminates, uuid. Of a
    quarter the latest report counts. It is tagged if any of its filings' texts is, or if the pair's
    registration is and no filing of the quarter declares any activity; a quarter that declares other
    work is never credited by the registration.
    """
    pair = ["registrant", "client"]
    of_pair = filings.groupBy(*pair).agg(F.min(F.when(F.col("registration") & F.col("tagged"), F.col("uuid"))).alias("reg_uuid"), F.max(F.when(F.col("terminates"), F.col("qidx"))).alias("terminated"), F.bool_or("tagged").alias("any_tagged"))
    reports = filings.filter(~F.col("registration"))
    of_quarter = filings.groupBy(*pair, "qidx").agg(F.bool_or(F.col("tagged") & ~F.col("registration")).alias("text_tagged"), F.coalesce(F.max(F.when(~F.col("registration"), F.col("n_activities"))), F.lit(0)).alias("declared"))
    last = latest_by(reports, [*pair, "qidx"], order).select(*pair, "qidx", "amount", "uuid")
    q = last.join(of_quarter, [*pair, "qidx"]).join(of_pair.filter("any_tagged"), pair)
    q = q.withColumn("credited", F.col("text_tagged") | (F.col("reg_uuid").isNotNull() & (F.col("declared") == 0))).filter("credited")
    return q.groupBy(*pair).agg(
        F.min("qidx").alias("first_q"), F.max("qidx").alias("last_q"), F.count(F.lit(1)).alias("quarters"), F.sum("amount").alias("total"), F.max("terminated").alias("terminated"),
        F.coalesce(F.max(F.when(F.col("text_tagged"), F.col("uuid"))), F.min("reg_uuid")).alias("sample"), F.when(F.bool_or("text_tagged"), "quarterly-text").otherwise("registration-only").alias("basis"),
    )


def split_by_share(players: DataFrame, tagged: Column, everything: Column, gate_pct: float = 5.0) -> DataFrame:
    """players with roster: 'forward' at or above the gate's share of what they do, 'diversified' below, 'unknown' without any."""
    share = F.when(everything > 0, 100.0 * tagged / everything)
    return players.withColumn("roster", F.when(share.isNull(), "unknown").when(share >= gate_pct, "forward").otherwise("diversified"))
