"""Spend, entities, turnover, giving and the gates that reconcile them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import top_per_group
from ..operators import entities as en
from ..operators import spend, turnover
from . import query
from .tables import FILINGS, LATEST_SQL, filings, latest_order, money, table

_SELF = f"""{FILINGS}, own AS (SELECT f.*, c_nationkey = s_nationkey AS self_filed FROM filings f JOIN customer ON client = c_custkey JOIN supplier ON registrant = s_suppkey)"""


def _own(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("client"), "c_nationkey"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("registrant"), "s_nationkey")
    return filings(spark, d).join(c, "client").join(s, "registrant").withColumn("self_filed", F.col("c_nationkey") == F.col("s_nationkey"))


@query(f"""{_SELF}, one AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY registrant, client, yr, q {LATEST_SQL}) = 1),
    a AS (SELECT client, yr, q, bool_or(self_filed) AS has_inhouse, coalesce(sum(amount) FILTER (WHERE self_filed), 0) AS i, coalesce(sum(amount) FILTER (WHERE NOT self_filed), 0) AS o, count(*) AS n_filings FROM one GROUP BY 1, 2, 3)
    SELECT client, yr, q, has_inhouse, round(i, 2)::DOUBLE AS inhouse, round(o, 2)::DOUBLE AS outside, n_filings, round(greatest(i, o), 2)::DOUBLE AS canonical, round(i + o, 2)::DOUBLE AS naive, round(least(i, o), 2)::DOUBLE AS counted_twice,
      CASE WHEN has_inhouse AND i >= o THEN '{spend.IN_HOUSE}' WHEN has_inhouse THEN '{spend.OVER}' ELSE '{spend.OUTSIDE}' END AS method FROM a""")
def canonical_spend(spark: SparkSession, d: str) -> DataFrame:
    """The flagship."""
    out = spend.canonical_spend(_own(spark, d), ["registrant", "client", "yr", "q"], ["client", "yr", "q"], latest_order())
    return out.withColumns({c: money(c) for c in ("inhouse", "outside", "canonical", "naive", "counted_twice")})


_ALIAS = """WITH raw AS (SELECT 'client' AS kind, 'senate' AS dataset, upper(c_mktsegment) || ' Group' || CASE WHEN c_custkey % 3 = 0 THEN ', Inc.' ELSE '' END AS raw_name, (c_nationkey)::VARCHAR AS source_id FROM customer
    UNION ALL SELECT 'registrant', 'house', replace(s_name, '#', ' ') || CASE WHEN s_suppkey % 2 = 0 THEN ' LLC' ELSE '' END, NULL FROM supplier),
    al AS (SELECT kind, dataset, raw_name, source_id, count(*) AS n_records, nullif(trim(regexp_replace(trim(regexp_replace(upper(raw_name), '[^A-Z0-9]+', ' ', 'g')), '(?:(?:^| )(?:LLC|INC))+$', '')), '') AS norm_key FROM raw GROUP BY 1, 2, 3, 4),
    ent AS (SELECT kind || ':' || coalesce(min(source_id), norm_key) AS entity_id, kind, norm_key, arg_max(raw_name, (n_records, raw_name)) AS canonical_name, sum(n_records)::BIGINT AS n_records, count(DISTINCT source_id) AS n_ids FROM al GROUP BY kind, norm_key)"""


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("client").alias("kind"), F.lit("senate").alias("dataset"), F.concat(F.upper("c_mktsegment"), F.lit(" Group"), F.when(F.col("c_custkey") % 3 == 0, ", Inc.").otherwise("")).alias("raw_name"), F.col("c_nationkey").cast("string").alias("source_id"))
    s = table(spark, d, "supplier").select(F.lit("registrant").alias("kind"), F.lit("house").alias("dataset"), F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.when(F.col("s_suppkey") % 2 == 0, " LLC").otherwise("")).alias("raw_name"), F.lit(None).cast("string").alias("source_id"))
    return en.aliases(c.unionByName(s))


@query(f"{_ALIAS} SELECT * FROM ent")
def entity_build(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of both kinds to entities."""
    return en.entities(_aliases(spark, d))


@query(f"{_ALIAS}, pairs AS (SELECT DISTINCT al.kind, raw_name, entity_id FROM al JOIN ent ON al.kind = ent.kind AND al.norm_key = ent.norm_key) SELECT kind, raw_name, entity_id FROM pairs")
def alias_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with its entity, once."""
    rows = _aliases(spark, d)
    return en.alias_entities(rows, en.entities(rows))


@query(f"{_ALIAS} SELECT kind, count(*) AS entities, count(*) FILTER (WHERE n_ids > 1) AS ambiguous, sum(n_records)::BIGINT AS records FROM ent GROUP BY kind")
def entity_qa(spark: SparkSession, d: str) -> DataFrame:
    """Keys that more than one id claims."""
    return en.entities(_aliases(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n_ids") > 1).alias("ambiguous"), F.sum("n_records").alias("records"))


@query(f"""{FILINGS}, s AS (SELECT registrant AS registrant_id, client AS client_id, count(*) AS senate_filings FROM filings WHERE ln % 2 = 1 GROUP BY 1, 2),
    h AS (SELECT registrant AS registrant_id, client AS client_id, count(*) AS house_filings FROM filings WHERE ln % 2 = 0 GROUP BY 1, 2)
    SELECT registrant_id, client_id, senate_filings, house_filings, CASE WHEN house_filings IS NULL THEN 'none' ELSE 'id' END AS confidence FROM s LEFT JOIN h USING (registrant_id, client_id)""")
def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Ids of one source inside the other's compound id."""
    f = filings(spark, d)
    senate = f.filter("ln % 2 = 1").select(F.col("registrant").alias("registrant_id"), F.col("client").alias("client_id"))
    return en.crosswalk(senate, f.filter("ln % 2 = 0").select(F.concat_ws("-", "registrant", "client").alias("senate_id")))


_TERM = "regexp_matches(filing_type, '^[1-4](T|TY|@|@Y)$')"
_PAIRS = f"""{FILINGS}, f AS (SELECT f.* EXCLUDE (client), c_nationkey AS client FROM filings f JOIN customer ON client = c_custkey),
    rep AS (SELECT registrant, client, qidx, amount, uuid AS paid_by FROM f WHERE filing_type NOT IN ('RR', 'RA') QUALIFY row_number() OVER (PARTITION BY registrant, client, qidx ORDER BY posted DESC, uuid) = 1),
    ev AS (SELECT registrant, client, qidx, bool_or({_TERM}) AS ended, min(uuid) FILTER (WHERE {_TERM}) AS cite, min(uuid) AS first FROM f GROUP BY 1, 2, 3),
    pq AS (SELECT ev.*, amount, paid_by FROM ev LEFT JOIN rep USING (registrant, client, qidx)),
    fq AS (SELECT registrant, client, min(qidx) AS qidx, arg_min(first, qidx) AS hire FROM pq GROUP BY 1, 2)"""
#: A quarter in which pairs still begin in every test table.
AT = 7984


def _pairs(spark: SparkSession, d: str, by_pair: bool = False) -> DataFrame:
    """by_pair: clients meet the orders, and filings are dealt by their pair, once for its quarters and for what is asked of all of them."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("client"), "c_nationkey")
    f = filings(spark, d, c) if by_pair else filings(spark, d).join(c, "client")
    f = f.drop("client").withColumnsRenamed({"c_nationkey": "client", "uuid": "filing_uuid"})
    f = f.repartition(*turnover.PAIR) if by_pair else f
    return turnover.pair_quarters(f, [F.col("posted").desc(), F.col("filing_uuid")])


@query(f"{_PAIRS}, a AS (SELECT qidx, count(*) AS terminations FROM pq WHERE ended GROUP BY 1), b AS (SELECT qidx, count(*) AS new_engagements FROM fq GROUP BY 1) SELECT qidx, coalesce(terminations, 0) AS terminations, coalesce(new_engagements, 0) AS new_engagements FROM a FULL JOIN b USING (qidx)")
def turnover_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ends and beginnings by quarter."""
    return turnover.counts(_pairs(spark, d))


@query(f"""{_PAIRS}, h AS (SELECT registrant, client, min(qidx) AS first_q, count(*) AS n_quarters, sum(amount) FILTER (WHERE qidx > {AT} - 4 AND qidx <= {AT}) AS s, count(*) FILTER (WHERE qidx > {AT}) AS re_engaged FROM pq WHERE paid_by IS NOT NULL GROUP BY 1, 2)
    SELECT registrant, client, round(s, 2)::DOUBLE AS trail4, n_quarters, first_q, first_q = {AT} AS new_this_q, re_engaged, cite FROM pq JOIN h USING (registrant, client) WHERE qidx = {AT} AND ended""")
def terminations(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that ends in a quarter, with its history."""
    return turnover.terminations(_pairs(spark, d), AT).select("registrant", "client", money("trailing").alias("trail4"), "n_quarters", "first_q", "new_this_q", "re_engaged", "cite")


@query(f"{_PAIRS} SELECT registrant, client, round(amount, 2)::DOUBLE AS first_amount, coalesce(paid_by, hire) AS cite, paid_by IS NULL AS registration_only, ended AS term_same_q FROM fq JOIN pq USING (registrant, client, qidx) WHERE qidx = {AT}")
def new_engagements(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that begin in a quarter."""
    return turnover.new_engagements(_pairs(spark, d), AT).select("registrant", "client", money("amount").alias("first_amount"), "cite", "registration_only", "term_same_q")


@query(f"""{_PAIRS} SELECT e.client, e.registrant AS lost_by, n.registrant AS won_by, n.qidx, n.qidx - {AT} AS hire_dq, CASE WHEN n.registrant = e.client THEN 'to-inhouse' WHEN e.registrant = e.client THEN 'from-inhouse' ELSE '' END AS move, cite, hire
    FROM pq e JOIN fq n ON e.client = n.client AND e.registrant <> n.registrant WHERE e.qidx = {AT} AND e.ended AND n.qidx BETWEEN {AT} - 1 AND {AT} + 1""")
def swaps(spark: SparkSession, d: str) -> DataFrame:
    """Who lost a client beside who won it, every pair of them."""
    return turnover.swaps(_pairs(spark, d, by_pair=True).withColumn("own", F.col("client").cast("long")), AT).select("client", "lost_by", "won_by", "qidx", "hire_dq", "move", "cite", "hire")


@query(f"""{_PAIRS}, t AS (SELECT registrant, client, sum(amount) AS t FROM pq WHERE paid_by IS NOT NULL AND qidx BETWEEN {AT} - 3 AND {AT} GROUP BY 1, 2), l AS (SELECT registrant, count(*) AS lost, sum(t) AS lt FROM pq LEFT JOIN t USING (registrant, client) WHERE qidx = {AT} AND ended GROUP BY 1), w AS (SELECT registrant, count(*) AS signed FROM fq WHERE qidx = {AT} GROUP BY 1)
    SELECT registrant, coalesce(lost, 0) AS lost, round(lt, 2)::DOUBLE AS lost_trail4, coalesce(signed, 0) AS signed, coalesce(signed, 0) - coalesce(lost, 0) AS net FROM l FULL JOIN w USING (registrant)""")
def firm_churn(spark: SparkSession, d: str) -> DataFrame:
    """D1, D17, U1."""
    return turnover.churn(_pairs(spark, d), AT).select("registrant", "lost", money("lost_trailing").alias("lost_trail4"), "signed", "net")


_IDENT = "registrant, client, yr, q, issue, flag, status"


@query(f"""{FILINGS}, dd AS (SELECT {_IDENT}, min(ok) AS cited, count(DISTINCT ok) AS versions, round(max(amount), 2)::DOUBLE AS amount FROM filings GROUP BY ALL)
    SELECT yr, flag, count(*) AS items, sum(versions)::BIGINT AS raw_items, round(sum(amount), 2)::DOUBLE AS total, min(cited) AS cited FROM dd GROUP BY 1, 2""")
def giving_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One item per identity, with a citation and its versions."""
    dd = filings(spark, d).groupBy(*_IDENT.split(", ")).agg(F.min("ok").alias("cited"), F.count_distinct("ok").alias("versions"), money(F.max("amount")).alias("amount"))
    return dd.groupBy("yr", "flag").agg(F.count(F.lit(1)).alias("items"), F.sum("versions").alias("raw_items"), money(F.sum("amount")).alias("total"), F.min("cited").alias("cited"))


@query(f"""{FILINGS} SELECT client, round(coalesce(sum(amount) FILTER (WHERE flag = 'A'), 0), 2)::DOUBLE AS direct, round(coalesce(sum(amount) FILTER (WHERE flag = 'N'), 0), 2)::DOUBLE AS committee, round(coalesce(sum(amount) FILTER (WHERE flag IN ('A', 'N')), 0), 2)::DOUBLE AS attributable,
    round(coalesce(sum(amount) FILTER (WHERE flag NOT IN ('A', 'N')), 0), 2)::DOUBLE AS shared, count(*) FILTER (WHERE flag NOT IN ('A', 'N')) AS shared_rows FROM filings GROUP BY client""")
def member_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Shared rows are listed and never summed into a recipient's total."""
    part = lambda *kinds: money(F.coalesce(F.sum(F.when(F.col("flag").isin(*kinds), F.col("amount"))), F.lit(0)))
    shared = ~F.col("flag").isin("A", "N")
    return filings(spark, d).groupBy("client").agg(part("A").alias("direct"), part("N").alias("committee"), part("A", "N").alias("attributable"), money(F.coalesce(F.sum(F.when(shared, F.col("amount"))), F.lit(0))).alias("shared"), F.count_if(shared).alias("shared_rows"))


@query(f"""{FILINGS}, t AS (SELECT registrant, client, round(sum(amount), 2)::DOUBLE AS a FROM filings GROUP BY 1, 2), s AS (SELECT registrant, sum(a) AS total, max(a) AS top, count(*) AS n FROM t GROUP BY 1)
    SELECT registrant, n, round(total, 2)::DOUBLE AS total, round(top / total, 6) AS top_share FROM s WHERE n >= 3""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """How much of a giver's total one recipient has."""
    t = filings(spark, d).groupBy("registrant", "client").agg(money(F.sum("amount")).alias("a"))
    s = t.groupBy("registrant").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("total"), F.max("a").alias("top")).filter("n >= 3")
    return s.select("registrant", "n", money("total").alias("total"), F.round(F.col("top") / F.col("total"), 6).alias("top_share"))


_SLICES = {0: "core", 1: "ambient", 2: "legacy"}


@query(f"""{FILINGS}, s AS (SELECT client, CASE registrant % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'ambient' ELSE 'legacy' END AS slice, round(sum(amount), 2)::DOUBLE AS total, count(*) AS items FROM filings GROUP BY 1, 2)
    SELECT client, {', '.join(f"coalesce(max({v}) FILTER (WHERE slice = '{x}'), 0) AS {x}_{v}" for x in _SLICES.values() for v in ("total", "items"))} FROM s GROUP BY 1""")
def giving_split(spark: SparkSession, d: str) -> DataFrame:
    """Recipients over several slices of givers, merged on the recipient's key."""
    rest = F.col("registrant") % 3
    s = filings(spark, d).withColumn("slice", F.when(rest == 0, _SLICES[0]).when(rest == 1, _SLICES[1]).otherwise(_SLICES[2]))
    out = s.groupBy("client").pivot("slice", list(_SLICES.values())).agg(money(F.sum("amount")).alias("total"), F.count(F.lit(1)).alias("items"))
    return out.na.fill(0)


@query(f"""{FILINGS}, parts AS (SELECT issue, registrant % 3 = 0 AS core, round(sum(amount), 2)::DOUBLE AS a, count(*) AS n FROM filings GROUP BY 1, 2), p AS (SELECT issue, sum(a) AS a, sum(n) AS n FROM parts GROUP BY 1),
    w AS (SELECT issue, sum(amount) AS a, count(*) AS n FROM filings GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (WHERE p.issue IS NULL OR w.issue IS NULL OR abs(p.a - w.a) > 0.02 OR p.n <> w.n) AS failed FROM p FULL JOIN w ON p.issue = w.issue""")
def reconciliation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Slices add up to the whole; failed must be 0."""
    f = filings(spark, d)
    parts = f.groupBy("issue", (F.col("registrant") % 3 == 0).alias("core")).agg(money(F.sum("amount")).alias("a"), F.count(F.lit(1)).alias("n"))
    p = parts.groupBy("issue").agg(F.sum("a").alias("pa"), F.sum("n").alias("pn"))
    w = f.groupBy("issue").agg(F.sum("amount").alias("wa"), F.count(F.lit(1)).alias("wn"))
    off = F.col("pn").isNull() | F.col("wn").isNull() | (F.abs(F.col("pa") - F.col("wa")) > 0.02) | (F.col("pn") != F.col("wn"))
    return p.join(w, "issue", "full").agg(F.count(F.lit(1)).alias("checked"), F.count_if(off).alias("failed"))


@query(f"""{FILINGS}, e AS (SELECT DISTINCT pk, client FROM filings), n AS (SELECT pk FROM e GROUP BY 1 HAVING count(*) <= 200), m AS (SELECT e.* FROM e JOIN n USING (pk) JOIN (SELECT DISTINCT pk FROM e WHERE client = 1) o USING (pk))
    SELECT client, count(*) AS shared FROM m WHERE client <> 1 GROUP BY 1""")
def colobby_distinctive(spark: SparkSession, d: str) -> DataFrame:
    """Who shares a client's distinctive items."""
    e = filings(spark, d).select("pk", "client").distinct()
    rare = e.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).filter("n <= 200").select("pk")
    own = e.filter("client = 1").select("pk")
    return e.filter("client <> 1").join(rare, "pk", "left_semi").join(own, "pk", "left_semi").groupBy("client").agg(F.count(F.lit(1)).alias("shared"))


@query(f"{FILINGS}, s AS (SELECT registrant, count(*) AS n, count(*) FILTER (WHERE issue LIKE '1-%') AS tagged FROM filings GROUP BY 1), p AS (SELECT *, round(100.0 * tagged / n, 2)::DOUBLE AS pct FROM s) SELECT registrant, n, tagged, pct, CASE WHEN pct >= 25 THEN 'dedicated' WHEN pct >= 5 THEN 'engaged' WHEN pct IS NULL THEN 'n/a (registrations only)' ELSE 'ambient' END AS band FROM p")
def activity_share_band(spark: SparkSession, d: str) -> DataFrame:
    """D9, D12."""
    s = filings(spark, d).groupBy("registrant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("issue").like("1-%")).alias("tagged")).withColumn("pct", money(F.col("tagged") * 100.0 / F.col("n")))
    return s.withColumn("band", F.when(F.col("pct") >= 25, "dedicated").when(F.col("pct") >= 5, "engaged").when(F.col("pct").isNull(), "n/a (registrations only)").otherwise("ambient"))


@query(f"""{FILINGS}, w AS (SELECT *, bool_or(flag = 'A') OVER (PARTITION BY registrant, client) AS tagged, min(qidx) OVER (PARTITION BY registrant, client) AS first_q, max(qidx) OVER (PARTITION BY registrant, client) AS last_q FROM filings),
    one AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY registrant, client, qidx {LATEST_SQL}) = 1)
    SELECT registrant, client, any_value(first_q) AS first_q, any_value(last_q) AS last_q, count(*) AS quarters, round(sum(amount), 2)::DOUBLE AS total, min('https://example.org/filing/' || ok || '/print/') AS url FROM one WHERE tagged GROUP BY 1, 2 HAVING count(*) > 1""")
def engagements(spark: SparkSession, d: str) -> DataFrame:
    """What a pair ever did decides, then only its latest filings count."""
    pair = Window.partitionBy("registrant", "client")
    w = filings(spark, d).withColumns({"tagged": F.bool_or(F.col("flag") == "A").over(pair), "first_q": F.min("qidx").over(pair), "last_q": F.max("qidx").over(pair)})
    rank = F.row_number().over(Window.partitionBy("registrant", "client", "qidx").orderBy(*latest_order()))
    one = w.withColumn("rn", rank).filter("rn = 1 AND tagged")
    url = F.concat(F.lit("https://example.org/filing/"), F.col("ok").cast("string"), F.lit("/print/"))
    return one.groupBy("registrant", "client").agg(F.min("first_q").alias("first_q"), F.max("last_q").alias("last_q"), F.count(F.lit(1)).alias("quarters"), money(F.sum("amount")).alias("total"), F.min(url).alias("url")).filter("quarters > 1")


@query(f"""{FILINGS}, s AS (SELECT client, count(*) AS n, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, client) AS r1, row_number() OVER (ORDER BY total DESC, client) AS r2 FROM s)
    SELECT client, n, total, r2 <= 30 AS in_scatter FROM r WHERE r1 <= 50 OR r2 <= 30""")
def display_selection(spark: SparkSession, d: str) -> DataFrame:
    """The tops of two orders, each found as a top-k instead of a global rank."""
    s = filings(spark, d).groupBy("client").agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total"))
    a = s.orderBy(F.col("n").desc(), "client").limit(50)
    b = s.orderBy(F.col("total").desc(), "client").limit(30).withColumn("in_scatter", F.lit(True))
    return a.join(b, ["client", "n", "total"], "full").na.fill(False, ["in_scatter"])


@query(f"{FILINGS}, t AS (SELECT registrant, qidx, count(*) AS n FROM filings WHERE flag = 'R' GROUP BY 1, 2) SELECT qidx, registrant, n, row_number() OVER (PARTITION BY qidx ORDER BY n DESC, registrant) AS rk FROM t QUALIFY rk <= 5")
def turnover_slices(spark: SparkSession, d: str) -> DataFrame:
    """D17, W2."""
    t = filings(spark, d).filter("flag = 'R'").groupBy("registrant", "qidx").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(t, ["qidx"], [F.col("n").desc(), F.col("registrant")], 5).withColumn("rk", F.col("rk").cast("long"))


_FLAGGED = f"""{FILINGS}, v AS (SELECT *, amount / 2 AS half, regexp_matches(filing_type, '(?i)(RR|T)$') AS reg, TRY_CAST(nullif(regexp_extract(filing_type, '\\d+'), '') AS INTEGER) AS qn, regexp_matches(filing_type, '\\d+A$') AS am FROM filings),
    w AS (SELECT *, bool_or(NOT am AND qn IS NOT NULL) OVER g AS hq, bool_or(am) OVER g AS ha, bool_or(reg) OVER g AS ch,
            count(*) OVER (PARTITION BY registrant, client, yr, qn, amount) > 1 OR count(*) OVER (PARTITION BY registrant, client, yr, qn, half) > 1 AS dup FROM v WINDOW g AS (PARTITION BY registrant, client, yr, qn))"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the filings that flag_versions() reads."""
    return filings(spark, d).withColumn("expenses", F.col("amount") / 2).withColumnsRenamed({"yr": "filing_year", "q": "filing_period", "amount": "income", "uuid": "filing_uuid"})


@query(f"{_FLAGGED} SELECT yr, q, count(*) AS n, count(*) FILTER (WHERE (hq AND ha) OR (NOT hq AND NOT ha) OR ch OR am OR dup) AS check_rows, count(*) FILTER (WHERE dup) AS repeated FROM w GROUP BY 1, 2")
def doubtful_filings(spark: SparkSession, d: str) -> DataFrame:
    """Rows that need a look, by quarter."""
    v = spend.flag_versions(_versions(spark, d), clean=False)
    return v.groupBy(F.col("filing_year").alias("yr"), F.col("filing_period").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("checkme") == "CHECK").alias("check_rows"), F.count_if("is_duplicate").alias("repeated"))


@query(f"{FILINGS} SELECT registrant, client, yr, q, uuid FROM filings WHERE filing_type <> 'RR' QUALIFY row_number() OVER (PARTITION BY registrant, client, yr, q ORDER BY posted DESC, uuid) = 1")
def kept_versions(spark: SparkSession, d: str) -> DataFrame:
    """Of a period's filings the latest, registrations left out."""
    return spend.flag_versions(_versions(spark, d)).select("registrant", "client", F.col("filing_year").alias("yr"), F.col("filing_period").alias("q"), F.col("filing_uuid").alias("uuid"))


@query(f"""{FILINGS}, k AS (SELECT *, 'ORG ' || registrant % 20 AS r, 'ORG ' || client % 37 AS c FROM filings), o AS (SELECT DISTINCT c FROM k WHERE r = c)
    SELECT yr, count(*) AS kept, round(sum(amount), 2)::DOUBLE AS total FROM k WHERE r = c OR c NOT IN (SELECT c FROM o) GROUP BY 1""")
def without_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Outside firms' filings go where a client files for itself anywhere."""
    names = {"registrant_name": F.concat(F.lit("Org, "), (F.col("registrant") % 20).cast("string"), F.lit(" LLC")), "client_name": F.concat(F.lit("The Org "), (F.col("client") % 37).cast("string"), F.lit(" Inc."))}
    kept = spend.drop_conflicts(filings(spark, d).withColumns(names), "registrant_name", "client_name")
    return kept.groupBy("yr").agg(F.count(F.lit(1)).alias("kept"), money(F.sum("amount")).alias("total"))
