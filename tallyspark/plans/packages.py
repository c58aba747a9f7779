"""Package exports, cross-checks, rosters and composed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.core import latest_by, numbered
from ..operators import entities, filters, members
from ..operators import packages as pk
from ..sources import scratch, sinks
from ..sources.reference_data import read_roster, write_roster
from . import query
from .tables import FILINGS, LATEST_SQL, filings, latest_order, money, table

ISSUES = {"1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"}


@query(f"""{FILINGS}, t AS (SELECT ok, unnest(regexp_extract_all('HR ' || ok % 900 || ' and S ' || client % 90 || ', HR ' || ok % 900, '(?:HR|S) \\d+')) AS raw FROM filings),
    c AS (SELECT DISTINCT ok, replace(raw, ' ', '') AS item FROM t),
    one AS (SELECT *, CASE WHEN status = 'O' THEN 'senate' ELSE 'house' END AS dataset FROM filings QUALIFY row_number() OVER (PARTITION BY registrant, client, yr, q {LATEST_SQL}) = 1)
    SELECT item, dataset, count(*) AS n_filings, count(DISTINCT client) AS n_clients, count(DISTINCT registrant) AS n_registrants, round(sum(amount), 2)::DOUBLE AS amount FROM one JOIN c USING (ok) GROUP BY 1, 2""")
def bill_cross_check(spark: SparkSession, d: str) -> DataFrame:
    """Who cites an item, by dataset, over the latest versions."""
    f = filings(spark, d)
    number = (F.col("o_orderkey") % 900).cast("string")
    txt = F.concat(F.lit("HR "), number, F.lit(" and S "), (F.col("o_custkey") % 90).cast("string"), F.lit(", HR "), number)
    cites = table(spark, d, "orders").select(F.col("o_orderkey").alias("ok"), F.explode(tx.bills(txt)).alias("item"))
    one = latest_by(f, ["registrant", "client", "yr", "q"], latest_order()).withColumn("dataset", F.when(F.col("status") == "O", "senate").otherwise("house"))
    return pk.cross_check(cites, one, "ok").withColumn("amount", money("amount"))


@query(f"""{FILINGS}, p AS (SELECT client, count(*) FILTER (WHERE issue LIKE '1-%') AS tagged, count(*) AS n_all, min(yr) FILTER (WHERE issue LIKE '1-%') AS first_year, max(yr) FILTER (WHERE issue LIKE '1-%') AS last_year, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY 1)
    SELECT client, tagged, n_all, round(100.0 * tagged / n_all, 3) AS share_pct, CASE WHEN tagged >= 8 THEN 'core' WHEN tagged >= 3 THEN 'active' ELSE 'occasional' END AS tier, first_year, last_year, total FROM p WHERE tagged > 0""")
def player_tiers(spark: SparkSession, d: str) -> DataFrame:
    """An issue's players with their tier and its share of all they do; one aggregate."""
    hit = F.col("issue").startswith("1-")
    p = filings(spark, d).groupBy("client").agg(F.count_if(hit).alias("tagged"), F.count(F.lit(1)).alias("n_all"), F.min(F.when(hit, F.col("yr"))).alias("first_year"), F.max(F.when(hit, F.col("yr"))).alias("last_year"), money(F.sum("amount")).alias("total"))
    return p.filter("tagged > 0").select("client", "tagged", "n_all", F.round(100.0 * F.col("tagged") / F.col("n_all"), 3).alias("share_pct"), pk.tier(F.col("tagged")).alias("tier"), "first_year", "last_year", "total")


@query(f"""{FILINGS}, tagged AS (SELECT client FROM filings GROUP BY 1 HAVING count(*) FILTER (WHERE issue LIKE '1-%') >= 2)
    SELECT 'Q' || q || ' ' || yr AS quarter, CASE 'Q' || q WHEN 'Q1' THEN 1 WHEN 'Q2' THEN 2 WHEN 'Q3' THEN 3 ELSE 4 END + yr * 4 AS pos, count(*) FILTER (WHERE issue LIKE '1-%') AS n_tagged, count(DISTINCT client) AS n_clients, round(sum(amount), 2)::DOUBLE AS spend
    FROM filings WHERE client IN (SELECT client FROM tagged) GROUP BY 1, 2 ORDER BY pos""")
def package_trend(spark: SparkSession, d: str) -> DataFrame:
    """Every quarter of the clients with two or more tagged filings, in the order of a mapped label."""
    f = filings(spark, d)
    own = f.join(f.groupBy("client").agg(F.count_if(F.col("issue").startswith("1-")).alias("m")).filter("m >= 2").select("client"), "client", "left_semi")
    label, pos = F.concat(F.lit("Q"), F.col("q"), F.lit(" "), F.col("yr")), F.when(F.col("q") == 1, 1).when(F.col("q") == 2, 2).when(F.col("q") == 3, 3).otherwise(4) + F.col("yr") * 4
    out = own.groupBy(label.alias("quarter"), pos.alias("pos")).agg(F.count_if(F.col("issue").startswith("1-")).alias("n_tagged"), F.count_distinct("client").alias("n_clients"), money(F.sum("amount")).alias("spend"))
    return out.orderBy("pos")


@query(f"""{FILINGS}, g AS (SELECT registrant, count(*) AS items, sum(amount) AS total FROM filings WHERE client = 7 GROUP BY 1),
    tags AS (SELECT client AS k, 'client' AS side, issue AS tag FROM filings UNION SELECT registrant, 'registrant', issue FROM filings WHERE flag = 'R')
    SELECT 'Supplier#' || lpad(registrant::VARCHAR, 9, '0') AS giver, any_value(items) AS items, round(any_value(total), 2)::DOUBLE AS total, coalesce(string_agg(tag, '; ' ORDER BY tag) FILTER (WHERE side = 'client'), '') AS tags, coalesce(string_agg(tag, '; ' ORDER BY tag) FILTER (WHERE side = 'registrant'), '') AS context_tags
    FROM g LEFT JOIN tags ON k = registrant GROUP BY registrant""")
def member_map(spark: SparkSession, d: str) -> DataFrame:
    """M9: one member's givers; only tags of clients of the same key are theirs."""
    f = filings(spark, d)
    giver = F.concat(F.lit("Supplier#"), F.lpad(F.col("registrant").cast("string"), 9, "0"))
    items = f.select(F.col("client").alias("recipient"), F.col("registrant").alias("giver_key"), giver.alias("giver"), "amount")
    sides = F.array(F.struct(F.col("client").alias("name_key"), F.lit("client").alias("side")), F.struct(F.when(F.col("flag") == "R", F.col("registrant")).alias("name_key"), F.lit("registrant").alias("side")))
    tags = f.select(F.col("issue").alias("tag"), F.explode(sides).alias("s")).select("s.name_key", "s.side", "tag").filter("name_key IS NOT NULL")
    return pk.givers_of(items, 7, tags).withColumn("total", money("total"))


_ROSTER = ["supplier#000000003", "Supplier#00000000", "Customer#00000000", "Nobody & Sons", "Supplier#000000001", "mer#00000000", "s"]


@query(f"""WITH r(name) AS (VALUES {', '.join(f"('{n}')" for n in _ROSTER)}), h AS (SELECT r.name, count(*) FILTER (WHERE upper(s_name) = upper(r.name)) AS same, count(DISTINCT upper(s_name)) FILTER (WHERE contains(upper(s_name), upper(r.name))) AS within FROM r, supplier GROUP BY 1)
    SELECT name, CASE WHEN same > 0 THEN 'exact' WHEN within > 0 THEN 'substring' WHEN EXISTS (SELECT 1 FROM customer WHERE contains(upper(c_name), upper(name))) THEN 'client-only' ELSE 'none' END AS status, CASE WHEN same > 0 THEN 1 ELSE within END AS n_hits FROM h""")
def roster_resolution(spark: SparkSession, d: str) -> DataFrame:
    """How each name of a roster file is found, or that it isn't."""
    path = scratch.folder(spark, "roster")
    write_roster(spark.createDataFrame([(n,) for n in [*_ROSTER, "# a remark", None]], "name string"), "name", path)
    return entities.resolve_roster(read_roster(spark, path), table(spark, d, "supplier").select(F.col("s_name").alias("name")), table(spark, d, "customer").select(F.col("c_name").alias("name")))


@query("""WITH k AS (SELECT DISTINCT upper(p_name || ' ' || p_type) AS key, p_brand FROM part), a AS (SELECT DISTINCT upper(left(p_name, 7)) AS asked FROM part)
    SELECT asked, key AS name FROM a JOIN k ON contains(key, asked) GROUP BY ALL""")
def loose_filers(spark: SparkSession, d: str) -> DataFrame:
    """filers' names that hold what is asked, past any resolution; found by shared pieces, not by a loop over pairs."""
    part = table(spark, d, "part")
    return entities.loose_names(part.select(F.upper(F.left("p_name", F.lit(7))).alias("name")), part.select(F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("name"))).select("asked", "name")


@query("""WITH k AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT left(p_name, 5) FROM part WHERE p_size = 1), a AS (SELECT DISTINCT left(p_name, 10) AS asked FROM part UNION SELECT DISTINCT p_name || ' fund' FROM part WHERE p_size < 5)
    SELECT asked, min(name) AS name FROM a JOIN k ON starts_with(name, asked) OR starts_with(asked, name) WHERE length(asked) >= 10 GROUP BY asked HAVING count(*) = 1""")
def unique_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Names by their beginnings, of ten letters or more, where only one fits."""
    part = table(spark, d, "part")
    asked = part.select(F.left("p_name", F.lit(10)).alias("asked")).unionByName(part.filter("p_size < 5").select(F.concat("p_name", F.lit(" fund")).alias("asked")))
    known = part.select(F.col("p_name").alias("name")).unionByName(part.filter("p_size = 1").select(F.left("p_name", F.lit(5)).alias("name")))
    return entities.unique_prefix(asked, known)


_PLAYERS = ["RING", "Bolt", "blue widget pac", "red gear", "hot", "WIDGET", "the small", "gear red", "plate steel small"]
_TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(upper({}), '[^A-Z0-9]+'), lambda w: w <> '')))"


@query(f"""WITH r(player) AS (VALUES {', '.join(f"('{n}')" for n in _PLAYERS)}), n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, player, {_TOKENS.format('name')} AS a, {_TOKENS.format('player')} AS b FROM n, r),
    l AS (SELECT *, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS less FROM w),
    m AS (SELECT name, player, CASE WHEN a = b THEN 'exact' ELSE 'candidate' END AS confidence, CASE WHEN a = b THEN 1000000 ELSE len(less) END AS score FROM l
          WHERE a = b OR ((list_has_all(a, b) OR list_has_all(b, a)) AND len(a) <> len(b) AND NOT list_has_all([{', '.join(f"'{w}'" for w in members.GENERIC)}], less) AND (len(less) > 1 OR length(less[1]) >= 5)))
    SELECT name, player, confidence FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, player) = 1""")
def token_subsets(spark: SparkSession, d: str) -> DataFrame:
    """A name's player by the same words, else by words that properly hold the other's."""
    return members.token_subset_matches(table(spark, d, "part").select(F.col("p_name").alias("name")), spark.createDataFrame([(n,) for n in _PLAYERS], "player string"))


@query(f"""{FILINGS}, s AS (SELECT registrant::VARCHAR AS cmte_id, client::VARCHAR AS bioguide_id, CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS k FROM filings)
    SELECT cmte_id, bioguide_id, CASE min(k) WHEN 1 THEN 'link' WHEN 2 THEN 'candidate' ELSE 'name' END AS link_source FROM s GROUP BY 1, 2""")
def committee_priority(spark: SparkSession, d: str) -> DataFrame:
    """M3: of the sources that link a pair, the first in order."""
    f = filings(spark, d).select(F.col("registrant").cast("string").alias("cmte_id"), F.col("client").cast("string").alias("bioguide_id"), "flag")
    sources = [(F.col("flag") == "A", "link"), (F.col("flag") == "R", "candidate"), (~F.col("flag").isin("A", "R"), "name")]
    return members.committee_links([f.filter(c).select("cmte_id", "bioguide_id", F.lit(n).alias("link_source")) for c, n in sources])


@query(f"""{FILINGS} SELECT ok, ln, pk, registrant, client, issue FROM filings WHERE (regexp_matches(lower(issue), 'urgent') OR regexp_matches(lower(issue), 'low')) AND posted::DATE BETWEEN DATE '1996-02-01' AND DATE '1997-03-31'
    AND ((amount BETWEEN 20000 AND 40000) OR (amount / 2 BETWEEN 20000 AND 40000))""")
def composed_filter(spark: SparkSession, d: str) -> DataFrame:
    """Optional terms joined; an amount range must hold within one column."""
    f = filings(spark, d).withColumns({"income": F.col("amount"), "expenses": F.col("amount") / 2})
    out = filters.select_filings(f, issues=["urgent", "low"], issue_col="issue", first_day="1996-02-01", last_day="1997-03-31", least=20000, most=40000)
    return out.select("ok", "ln", "pk", "registrant", "client", "issue")


@query(f"""{FILINGS}, c AS (SELECT client, qidx, list_sort(list(DISTINCT issue)) AS codes FROM filings GROUP BY 1, 2)
    SELECT client, qidx, 'all' AS how, list_aggregate(codes, 'string_agg', '; ') AS codes FROM c WHERE list_has_all(codes, ['1-URGENT', '2-HIGH']) UNION ALL SELECT client, qidx, 'any', list_aggregate(codes, 'string_agg', '; ') FROM c WHERE list_has_any(codes, ['5-LOW', '3-MEDIUM'])""")
def code_filter(spark: SparkSession, d: str) -> DataFrame:
    """rows by all or any of some codes."""
    c = filings(spark, d).groupBy("client", "qidx").agg(F.array_sort(F.collect_set("issue")).alias("codes"))
    out = lambda how, codes, joiner: filters.with_codes(c, "codes", codes, ISSUES, joiner).select("client", "qidx", F.lit(how).alias("how"), F.array_join("codes", "; ").alias("codes"))
    return out("all", ["1-URGENT", "2-HIGH"], "and").unionByName(out("any", ["5-LOW", "3-MEDIUM"], "or"))


@query("SELECT md5(text) AS hash, row_number() OVER (ORDER BY md5(text)) AS text_id, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def text_ids(spark: SparkSession, d: str) -> DataFrame:
    """Texts numbered in a global order, without a task that holds them all."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.count(F.lit(1)).alias("docs"))
    folder = scratch.folder(spark, "text_ids")
    sinks.save({"text_ids": numbered(t, "hash", "text_id").withColumn("text_id", F.col("text_id").cast("long"))}, folder)
    return spark.read.parquet(f"{folder}/text_ids")


@query("""SELECT c_mktsegment, sum(TRY_CAST(regexp_replace('$ ' || c_acctbal::DECIMAL(12, 2)::VARCHAR || ' USD', '[^0-9.-]', '', 'g') AS DECIMAL(12, 2)))::DOUBLE AS total, count(*) AS n FROM customer GROUP BY 1""")
def stripped_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts out of text that holds more than digits."""
    txt = F.concat(F.lit("$ "), F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" USD"))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum(F.regexp_replace(txt, "[^0-9.-]", "").try_cast("decimal(12,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"{FILINGS} SELECT 117 + floor((yr - 2021) / 2)::BIGINT AS congress, count(*) AS n, count(DISTINCT client) AS clients FROM filings GROUP BY 1")
def by_congress(spark: SparkSession, d: str) -> DataFrame:
    """Years before the first one counted from floor as well."""
    return filings(spark, d).groupBy(pk.congress_of_year(F.col("yr")).alias("congress")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("client").alias("clients"))


@query(f"{FILINGS} SELECT registrant, client, yr, ok, ln, pk, greatest(amount, 0)::DOUBLE AS amount FROM filings QUALIFY row_number() OVER (PARTITION BY registrant, client, yr ORDER BY posted, ok, ln, pk) = 1")
def earliest_version(spark: SparkSession, d: str) -> DataFrame:
    """The other reading, in which the earliest version stays."""
    order = [F.col(c) for c in ("posted", "ok", "ln", "pk")]
    return latest_by(filings(spark, d), ["registrant", "client", "yr"], order).select("registrant", "client", "yr", "ok", "ln", "pk", F.greatest("amount", F.lit(0)).cast("double").alias("amount"))
