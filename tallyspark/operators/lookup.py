"""Bills by number or name: what is asked to the numbers and phrases that it stands for, and who says or files them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BILL, bill_key


def resolve_bills(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked, kind, id, bills, phrases: 'number' (with the alias that has it, if any), 'alias', 'ambiguous' or 'none'.

    A name or id counts if it is an alias's own, else if just one alias's names or id hold it. aliases, a
    list kept by hand: id, names, bills, phrases.
    """
    q = F.lower(F.trim("asked"))
    number = F.when(F.trim("asked").rlike(BILL.replace(r"\b", "", 1).replace("(?iU)", "(?iU)^") + "$"), bill_key(F.col("asked")))
    rows = asked.select("asked").distinct().withColumns({"q": q, "number": number})
    known = F.broadcast(aliases)
    names = F.transform("names", lambda n: F.lower(n))
    pairs = rows.crossJoin(known)  # what is asked, one by one, against a list kept by hand
    has = F.array_contains("bills", F.col("number"))
    own = F.col("number").isNull() & ((F.col("q") == F.col("id")) | F.array_contains(names, F.col("q")))
    holds = F.col("number").isNull() & (F.exists(names, lambda n: F.contains(n, F.col("q"))) | F.contains("id", F.col("q")))
    alias = F.struct("id", "bills", "phrases")
    found = pairs.groupBy("asked", "number").agg(F.min(F.when(has, alias)).alias("numbered"), F.collect_set(F.when(own, alias)).alias("own"), F.collect_set(F.when(holds, alias)).alias("holds"))
    hits = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("holds"))
    kind = F.when(F.col("number").isNotNull(), "number").when(F.size(hits) == 1, "alias").when(F.size(hits) > 1, "ambiguous").otherwise("none")
    out = found.select("asked", "number", kind.alias("kind"), F.when(F.col("number").isNotNull(), F.col("numbered")).when(F.size(hits) == 1, hits[0]).alias("a"))
    none = F.array().cast("array<string>")
    return out.select("asked", "kind", "a.id", F.when(F.col("number").isNotNull(), F.array("number")).otherwise(F.coalesce("a.bills", none)).alias("bills"), F.coalesce("a.phrases", none).alias("phrases"))


def said_or_numbered(numbers: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, via: 'number', 'name' or 'both' of keys that cite a bill's number or say its name."""
    both = numbers.select(key, F.lit(1).alias("a")).unionByName(names.select(key, F.lit(2).alias("a"))).groupBy(key).agg(F.collect_set("a").alias("s"))
    return both.select(key, F.when(F.size("s") == 2, "both").when(F.col("s")[0] == 1, "number").otherwise("name").alias("via"))


def phrase_search(phrases: list[str]) -> str:
    """A pattern of phrases as whole words, without case; their signs stand for themselves."""
    escaped = ["".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in p) for p in phrases]
    return r"(?i)\b(" + "|".join(escaped) + r")\b"


def says(text: Column, phrases: list[str]) -> Column:
    return text.rlike(phrase_search(phrases))
