"""Members: names of every shape that recipients are filed under, resolved by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, members
from ..sources import scratch, sinks
from . import query
from .tables import FILINGS, filings, money, table

#: First names by a nation's key mod 5, as filed and as listed.
_FIRST = ["Robert", "Nicole", "Beto", "Mary", "Thomas"]
_LISTED = ["Robert", "Nicole (Nikki)", "Beto", "Mary Jo", "Thomas"]


def _members(spark: SparkSession, d: str) -> DataFrame:
    """A member per nation, every seventh with a namesake in the other chamber."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    code = F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ")
    last = F.concat(F.when(k % 5 == 2, "O'Q").otherwise("Q"), code)
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % 5 + 1).cast("int"))
    base = n.select(k.alias("k"), pick(_LISTED).alias("first"), last.alias("last"), F.when(k % 5 == 4, "Tom").alias("nickname"), F.concat_ws(" ", pick(_FIRST), last).alias("name"))
    own = base.withColumns({"bioguide_id": F.format_string("N%d", "k"), "chamber": F.when(F.col("k") % 2 == 0, "Senate").otherwise("House")})
    twin = base.filter("k % 7 = 0").withColumns({"bioguide_id": F.format_string("T%d", "k"), "chamber": F.when(F.col("k") % 2 == 0, "House").otherwise("Senate")})
    return own.unionByName(twin)


_ASKED = f"""WITH m AS (SELECT n_nationkey AS k, n_nationkey % 5 AS r, n_nationkey % 7 = 0 AS twin, ['{"', '".join(_FIRST)}'][n_nationkey % 5 + 1] AS f, CASE WHEN n_nationkey % 5 = 2 THEN 'O''Q' ELSE 'Q' END || translate(n_nationkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS l, CASE WHEN n_nationkey % 2 = 0 THEN 'Sen. ' ELSE 'Rep. ' END AS t FROM nation),
    a AS (SELECT DISTINCT c_custkey % 12 AS s, c_nationkey AS k FROM customer), x AS (SELECT * FROM a JOIN m USING (k)),
    q AS (SELECT *, CASE s WHEN 0 THEN t || f || ' ' || l WHEN 1 THEN upper(l) || ', ' || upper(f) WHEN 2 THEN left(f, 1) || '. ' || l || ' Jr.' WHEN 3 THEN l || ' for Congress' WHEN 4 THEN 'Friends of ' || l || ' Victory Fund 2024' WHEN 5 THEN 'NRCC' WHEN 6 THEN 'n/a'
        WHEN 7 THEN t || f || ' ' || l || '; NRCC; Nobody Atall' WHEN 8 THEN CASE r WHEN 0 THEN 'Bob' WHEN 4 THEN 'Tom' ELSE f END || ' ' || l WHEN 9 THEN 'Xavier ' || l WHEN 10 THEN 'The Honorable ' || left(f, 1) || 'xyz ' || l ELSE 'Lisa ' || l END AS query FROM x)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """raw, amount: what customers stand for, written as a table of items first."""
    c, k, s = table(spark, d, "customer"), F.col("c_nationkey"), F.col("c_custkey") % 12
    first = F.element_at(F.array(*[F.lit(x) for x in _FIRST]), (k % 5 + 1).cast("int"))
    last = F.concat(F.when(k % 5 == 2, "O'Q").otherwise("Q"), F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ"))
    title = F.when(k % 2 == 0, "Sen. ").otherwise("Rep. ")
    known = F.when(k % 5 == 0, "Bob").when(k % 5 == 4, "Tom").otherwise(first)
    shapes = [
        F.concat(title, first, F.lit(" "), last), F.concat(F.upper(last), F.lit(", "), F.upper(first)), F.concat(F.left(first, F.lit(1)), F.lit(". "), last, F.lit(" Jr.")), F.concat(last, F.lit(" for Congress")),
        F.concat(F.lit("Friends of "), last, F.lit(" Victory Fund 2024")), F.lit("NRCC"), F.lit("n/a"), F.concat(title, first, F.lit(" "), last, F.lit("; NRCC; Nobody Atall")), F.concat(known, F.lit(" "), last), F.concat(F.lit("Xavier "), last),
        F.concat(F.lit("The Honorable "), F.left(first, F.lit(1)), F.lit("xyz "), last), F.concat(F.lit("Lisa "), last),
    ]
    folder = scratch.folder(spark, "items")
    sinks.save({"items": c.select(F.element_at(F.array(*shapes), (s + 1).cast("int")).alias("raw"), F.col("c_acctbal").cast("decimal(12,2)").alias("amount"))}, folder)
    return spark.read.parquet(f"{folder}/items")


def _resolved(spark: SparkSession, d: str, asked: DataFrame) -> DataFrame:
    people = _members(spark, d)
    own = people.filter("bioguide_id LIKE 'N%'")
    named = lambda text, tier, cmte: own.select(F.format_string(cmte + "%d", "k").alias("cmte_id"), text.alias("cmte_name"), "bioguide_id", F.lit(tier).alias("tier"), F.lit("linked").alias("confidence"))
    committees = named(F.concat("last", F.lit(" for Congress")), "campaign-committee", "C").unionByName(named(F.concat(F.lit("Friends of "), "last", F.lit(" Victory Fund")), "jfc", "J"))
    nick = spark.createDataFrame([("BOB", "ROBERT")], "a string, b string")
    spelt = own.filter("k % 2 = 0").select("bioguide_id", F.concat(F.lit("LISA "), F.upper("last")).alias("spelling"))
    aliases = spark.createDataFrame([("NATL QA CMTE", "C0")], "spelling string, cmte_id string")
    parties = spark.createDataFrame([("NRCC", "NRCC")], "key string, display string")
    return members.resolve_recipients(asked, "raw", people, committees, nick, spelt, aliases, parties)


_RESOLVED = """r AS (
      SELECT query, 'member' AS kind, 'N' || k AS bioguide_id, 'direct' AS tier, CASE WHEN s = 0 THEN CASE WHEN twin THEN 'title-chamber' ELSE 'matched' END WHEN s = 1 THEN 'inverted' WHEN s = 10 THEN 'title-initial' WHEN s = 11 THEN 'alias' ELSE CASE WHEN twin THEN 'ambiguous' ELSE 'matched' END END AS confidence, s IN (2, 8) AND twin AS ambiguous
        FROM q WHERE s IN (0, 2, 8) OR (s IN (1, 10) AND NOT twin) OR (s = 11 AND k % 2 = 0)
      UNION ALL SELECT query, 'member', 'T' || k, 'direct', 'ambiguous', true FROM q WHERE s IN (2, 8) AND twin
      UNION ALL SELECT query, 'committee', 'N' || k, 'campaign-committee', 'linked', false FROM q WHERE s = 3
      UNION ALL SELECT query, 'committee', 'N' || k, 'jfc-shared, unallocated', 'prefix', false FROM q WHERE s = 4
      UNION SELECT query, 'party-committee', NULL, NULL, 'NRCC', false FROM q WHERE s = 5
      UNION ALL SELECT query, 'compound', 'N' || k, 'multi-honoree, unallocated', CASE WHEN twin THEN 'compound:title-chamber' ELSE 'compound:matched' END, false FROM q WHERE s = 7
      UNION ALL SELECT query, 'compound', NULL, NULL, 'compound:NRCC', false FROM q WHERE s = 7
      UNION SELECT query, 'unresolved', NULL, NULL, NULL, false FROM q WHERE s IN (6, 9) OR (s IN (1, 10) AND twin) OR (s = 11 AND k % 2 <> 0))"""


@query(f"{_ASKED}, {_RESOLVED} SELECT * FROM r")
def recipient_resolution(spark: SparkSession, d: str) -> DataFrame:
    """M5, M6: every string that customers stand for, by the rule that resolves it."""
    return _resolved(spark, d, _asked(spark, d))


@query(f"""{_ASKED}, {_RESOLVED}, g AS (SELECT c_custkey % 12 AS s, c_nationkey AS k, c_acctbal::DECIMAL(12, 2) AS amount FROM customer), i AS (SELECT query, amount FROM g JOIN q USING (s, k))
    SELECT bioguide_id, coalesce(sum(amount) FILTER (WHERE tier = 'direct'), 0)::DOUBLE AS direct, coalesce(sum(amount) FILTER (WHERE tier = 'campaign-committee'), 0)::DOUBLE AS campaign, coalesce(sum(amount) FILTER (WHERE tier NOT IN ('direct', 'campaign-committee')), 0)::DOUBLE AS shared, count(*) AS items
    FROM i JOIN r USING (query) WHERE bioguide_id IS NOT NULL AND NOT ambiguous GROUP BY 1""")
def recipient_rollup(spark: SparkSession, d: str) -> DataFrame:
    """M7: members' money by tier over resolved items; what is shared is never a member's own, ambiguous items are left out."""
    items = _asked(spark, d)
    hits = items.join(_resolved(spark, d, items), items.raw == F.col("query")).filter("bioguide_id IS NOT NULL AND NOT ambiguous")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0)).cast("double")
    own, campaign = F.col("tier") == "direct", F.col("tier") == "campaign-committee"
    return hits.groupBy("bioguide_id").agg(part(own).alias("direct"), part(campaign).alias("campaign"), part(~own & ~campaign).alias("shared"), F.count(F.lit(1)).alias("items"))


@query("""WITH p AS (SELECT p_partkey, p_type AS known, CASE p_size % 3 WHEN 0 THEN left(p_type, 1) WHEN 1 THEN upper(split_part(p_name, ' ', 1)) ELSE p_type END AS said FROM part)
    SELECT p_partkey, said = known OR (length(said) = 1 AND starts_with(known, said)) OR (said = 'RED' AND known = 'SMALL') OR (said = 'SMALL' AND known = 'RED') OR (said = 'BLUE' AND known = 'PROMO') AS same FROM p""")
def same_words(spark: SparkSession, d: str) -> DataFrame:
    """M4: words that are equal, an initial, or equal by a list of nicknames."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("RED", "SMALL"), ("BLUE", "PROMO"))])
    size = F.col("p_size") % 3
    said = F.when(size == 0, F.left("p_type", F.lit(1))).when(size == 1, F.upper(F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", members.same_word(said, members.with_nicknames(members.words(F.col("p_type")), pairs)).alias("same"))


@query("SELECT 'N' || n_nationkey AS bioguide_id, n_name AS last FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name FROM region")
def retired_members(spark: SparkSession, d: str) -> DataFrame:
    """M8: members and those of a list kept by hand whom no member's name covers."""
    n = table(spark, d, "nation").select(F.format_string("N%d", "n_nationkey").alias("bioguide_id"), F.lit("A").alias("first"), F.col("n_name").alias("last"))
    more = table(spark, d, "region").select(F.format_string("R%d", "r_regionkey").alias("bioguide_id"), F.lit("B").alias("first"), F.col("r_name").alias("last"))
    known = n.filter("bioguide_id = 'N3'").withColumns({"bioguide_id": F.lit("X"), "first": F.lit("a")})
    return members.with_retired(n, more.unionByName(known)).select("bioguide_id", "last")


@query(f"""{FILINGS}, o AS (SELECT client, round(sum(amount), 2)::DOUBLE AS was FROM filings WHERE client % 10 <> 1 GROUP BY 1), n AS (SELECT client, round(sum(amount), 2)::DOUBLE + CASE WHEN client % 7 = 0 THEN 1 ELSE 0 END AS now FROM filings WHERE client % 10 <> 2 GROUP BY 1)
    SELECT client, was, now, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'lost' WHEN abs(was - now) <= 0.01 THEN 'reproduced' ELSE 'changed' END AS change FROM o FULL JOIN n USING (client)""")
def retrofit_difference(spark: SparkSession, d: str) -> DataFrame:
    """A result against an earlier one: reproduced, changed, added, lost."""
    total = filings(spark, d).groupBy("client").agg(money(F.sum("amount")).alias("v"))
    new = total.filter("client % 10 <> 2").withColumn("v", F.col("v") + F.when(F.col("client") % 7 == 0, 1).otherwise(0))
    return checks.difference(total.filter("client % 10 <> 1"), new, ["client"], "v")
