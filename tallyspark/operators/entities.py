"""Entity resolution by deterministic keys; ambiguity is reported, never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import small
from ..functions.names import name_key


def aliases(rows: DataFrame) -> DataFrame:
    """kind, dataset, raw_name, source_id -> one row each with norm_key and n_records."""
    counted = rows.groupBy("kind", "dataset", "raw_name", "source_id").agg(F.count(F.lit(1)).alias("n_records"))
    return counted.withColumn("norm_key", name_key(F.col("raw_name"))).filter("norm_key is not null")


def entities(alias_rows: DataFrame) -> DataFrame:
    """One entity per kind and key: its id from the smallest source id as text, its name the most recorded spelling, ties to the larger."""
    best = F.max_by("raw_name", F.struct("n_records", "raw_name"))
    out = alias_rows.groupBy("kind", "norm_key").agg(F.min("source_id").alias("least"), best.alias("canonical_name"), F.sum("n_records").alias("n_records"), F.count_distinct("source_id").alias("n_ids"))
    return out.select(F.concat_ws(":", "kind", F.coalesce("least", "norm_key")).alias("entity_id"), "kind", "norm_key", "canonical_name", "n_records", "n_ids")


def alias_entities(alias_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """kind, raw_name, entity_id, each pair once, so that joins through it don't multiply rows."""
    return alias_rows.select("kind", "raw_name", "norm_key").distinct().join(entity_rows.select("kind", "norm_key", "entity_id"), ["kind", "norm_key"]).select("kind", "raw_name", "entity_id").distinct()


def crosswalk(senate: DataFrame, house: DataFrame) -> DataFrame:
    """Senate (registrant_id, client_id) pairs with the House's compound ids ('registrant-client'), confidence 'id' where both have it."""
    left = senate.groupBy("registrant_id", "client_id").agg(F.count(F.lit(1)).alias("senate_filings"))
    right = house.select(F.split_part(F.col("senate_id"), F.lit("-"), F.lit(1)).try_cast("long").alias("registrant_id"), F.split_part(F.col("senate_id"), F.lit("-"), F.lit(2)).try_cast("long").alias("client_id"))
    right = right.groupBy("registrant_id", "client_id").agg(F.count(F.lit(1)).alias("house_filings"))
    return left.join(right, ["registrant_id", "client_id"], "left").withColumn("confidence", F.when(F.col("house_filings").isNotNull(), "id").otherwise("none"))


#: Letters of the pieces by which names that hold one another are found.
PIECE = 3


def _pieces(name: Column) -> Column:
    """Every run of PIECE characters, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - PIECE + 1)), lambda k: F.substring(name, k, F.lit(PIECE))))


def held_by(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked, name where the name holds what is asked, without case.

    What is asked and the names meet at the rarest of its pieces, so this is an equal join and not a loop
    over pairs; what is shorter than a piece is looked for in every name, as a list of its own.
    """
    a = asked.select("asked").distinct().withColumn("own", F.upper("asked")).filter("own <> ''")
    n = names.select("name").distinct().withColumn("own", F.upper("name")).filter("own IS NOT NULL")
    within = n.select("name", F.col("own").alias("whole"), F.explode(_pieces(F.col("own"))).alias("piece"))
    often = within.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    long_ = a.filter(F.length("own") >= PIECE)
    every = long_.select("asked", "own", F.explode(_pieces(F.col("own"))).alias("piece")).join(often, "piece", "left")
    rarest = every.groupBy("asked", "own").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("x")).select("asked", "own", "x.piece")
    found = within.join(small(rarest, 1_000_000), "piece").filter(F.contains("whole", "own")).select("asked", "name")
    short = a.filter(F.length("own") < PIECE)
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PIECE - 1)), lambda m: F.transform(F.sequence(F.lit(1), F.length("own")), lambda k: F.substring(F.col("own"), k, m)))))
    return found.unionByName(n.select("name", F.explode(runs).alias("own")).join(small(short, 1_000_000), "own").select("asked", "name")).distinct()


def resolve_roster(roster: DataFrame, names: DataFrame, client_names: DataFrame) -> DataFrame:
    """name, status, n_hits for every roster name: 'exact' (without case), 'substring', 'client-only' or 'none'.

    roster, names, client_names: name.
    """
    asked = roster.select(F.col("name").alias("asked")).distinct()
    hits = held_by(asked, names).withColumn("raw", F.upper("name")).select("asked", "raw").distinct()
    hits = hits.groupBy("asked").agg(F.count_if(F.col("raw") == F.upper("asked")).alias("same"), F.count(F.lit(1)).alias("within"))
    clients = held_by(asked, client_names).select("asked", F.lit(1).alias("client")).distinct()
    out = asked.join(hits, "asked", "left").join(clients, "asked", "left")
    status = F.when(F.col("same") > 0, "exact").when(F.col("within") > 0, "substring").when(F.col("client").isNotNull(), "client-only").otherwise("none")
    return out.select(F.col("asked").alias("name"), status.alias("status"), F.coalesce(F.when(F.col("same") > 0, F.col("same")), "within", F.lit(0)).alias("n_hits"))


def loose_names(roster: DataFrame, filers: DataFrame) -> DataFrame:
    """asked, name: filers' own names that hold a roster name, past any resolution; for recall, to be looked through."""
    return held_by(roster.select(F.col("name").alias("asked")), filers)


def filer_names(keys: DataFrame, filers: DataFrame) -> DataFrame:
    """name: filers' names whose key is among some (norm_key)."""
    return filers.select("name").distinct().withColumn("norm_key", name_key(F.col("name"))).join(keys.select("norm_key").distinct(), "norm_key", "left_semi").select("name")


def unique_prefix(asked: DataFrame, known: DataFrame, least: int = 10) -> DataFrame:
    """asked, name where one begins with the other and only one known name does so; asked of fewer than ``least`` letters doesn't match.

    A known name's first letters, at most ``least``, meet the asked name's beginnings of every such
    length, so this is an equal join and not a loop over pairs, and short known names are found as well.
    """
    a = asked.select("asked").distinct().filter(F.length("asked") >= least)
    a = a.withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.lit(least)), lambda m: F.left("asked", m))))
    k = known.select("name").distinct().filter("name <> ''").withColumn("head", F.left("name", F.lit(least)))
    pairs = a.join(k, "head").filter(F.startswith("name", "asked") | F.startswith("asked", "name"))
    return pairs.groupBy("asked").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter("n = 1").select("asked", "name")
