"""Bills, players, contributions, receipts and a package's exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import text as tx
from ..functions.core import latest_by, top_per_group
from ..operators import checks, entities, giving, lookup
from ..operators import packages as pk
from ..sources import reference_data, scratch, sinks
from . import query
from .analytics import _PAIRS, _TERM, _pairs
from .tables import FILINGS, LATEST_SQL, filings, latest_order, money, table, texts

_ALIASES = [("farm", ["Farm Bill", "Farm Act"], ["HR2"], ["farm bill"]), ("license", ["License Act"], [], ["apache license", "rights reserved"]), ("ndaa", ["NDAA", "Defense Act"], ["HR7", "S7"], ["ndaa"])]
_ASKED = ["h.r. 2", "HR 99", "NDAA", "farm", "act", "Defense", "nothing", " License Act "]


@query("""SELECT * FROM (VALUES ('h.r. 2', 'number', 'farm', 'HR2', 'farm bill'), ('HR 99', 'number', NULL, 'HR99', ''), ('NDAA', 'alias', 'ndaa', 'HR7;S7', 'ndaa'), ('farm', 'alias', 'farm', 'HR2', 'farm bill'), ('act', 'ambiguous', NULL, '', ''),
    ('Defense', 'alias', 'ndaa', 'HR7;S7', 'ndaa'), ('nothing', 'none', NULL, '', ''), (' License Act ', 'alias', 'license', '', 'apache license;rights reserved')) AS t(asked, kind, id, bills, phrases)""")
def bill_aliases(spark: SparkSession, d: str) -> DataFrame:
    """What is asked to a number or an alias, read from its file; several or none are said so."""
    path = f"{scratch.folder(spark, 'aliases')}/aliases.json"
    rows = spark.createDataFrame(_ALIASES, "id string, names array<string>, bills array<string>, phrases array<string>")
    sinks.save_lines(rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("aliases"))).alias("value")), path)
    out = lookup.resolve_bills(spark.createDataFrame([(a,) for a in _ASKED], "asked string"), reference_data.read_aliases(spark, path))
    return out.withColumns({"bills": F.array_join("bills", ";"), "phrases": F.array_join("phrases", ";")})


@query("""WITH p AS (SELECT doc_id, lang, regexp_matches(text, '(?i)\\b(apache license|rights reserved)\\b') AS says, doc_id % 9 = 4 AS cites FROM documents), v AS (SELECT lang, CASE WHEN says AND cites THEN 'both' WHEN cites THEN 'number' ELSE 'name' END AS via FROM p WHERE says OR cites)
    SELECT lang, via, count(*) AS releases FROM v GROUP BY 1, 2""")
def bill_releases(spark: SparkSession, d: str) -> DataFrame:
    """Releases that cite a bill's number, say its name, or both."""
    docs = table(spark, d, "documents")
    cites = docs.filter("doc_id % 9 = 4").select("doc_id")
    says = docs.filter(lookup.says(F.col("text"), ["apache license", "rights reserved"])).select("doc_id")
    return lookup.said_or_numbered(cites, says, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "via").agg(F.count(F.lit(1)).alias("releases"))


@query(f"""{FILINGS}, k AS (SELECT DISTINCT ok FROM filings WHERE issue LIKE '1-%' AND ok % 3 = 0), one AS (SELECT f.* FROM filings f JOIN k USING (ok) QUALIFY row_number() OVER (PARTITION BY registrant, client, yr, q {LATEST_SQL}) = 1)
    SELECT yr, count(*) AS engagements, count(DISTINCT client) AS clients, round(sum(amount), 2)::DOUBLE AS attributed, (SELECT count(*) FROM k) AS raw_filings FROM one GROUP BY 1""")
def bill_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings that cite a number: raw ones, then each engagement's latest by year."""
    f = filings(spark, d)
    keys = f.filter(F.col("issue").startswith("1-") & (F.col("ok") % 3 == 0)).select("ok").distinct()
    one = latest_by(f.join(keys, "ok", "left_semi"), ["registrant", "client", "yr", "q"], latest_order())
    out = one.groupBy("yr").agg(F.count(F.lit(1)).alias("engagements"), F.count_distinct("client").alias("clients"), money(F.sum("amount")).alias("attributed"))
    return out.crossJoin(F.broadcast(keys.agg(F.count(F.lit(1)).alias("raw_filings"))))


_LEX = {"LIC": ["apache license", "license", "version 2.0"], "LAW": ["license", "rights reserved", "all rights reserved", "copyright"], "ENG": ["the", "and", "to", "of", "in", "that"], "GER": ["der", "die", "und", "das", "ist", "nicht"], "FRE": ["les", "des", "que", "une", "aux", "qui"], "SPA": ["los", "las", "para", "una", "con", "del"], "SEC": ["password", "token", "secret", "api key"]}
_LEX_SQL = ", ".join(f"('{p}', '{t}')" for t, ps in _LEX.items() for p in ps)
_LEX_BODY = "|".join(p.replace(".", r"\.").replace(" ", r"\s+") for p in sorted({p for ps in _LEX.values() for p in ps}, key=lambda p: (-len(p), p)))


@query(rf"""WITH lex(keyword, tag) AS (VALUES {_LEX_SQL}), w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '\b(?:{_LEX_BODY})\b') AS m FROM documents),
    k AS (SELECT DISTINCT doc_id, lang, regexp_replace(u, '\s+', ' ', 'g') AS keyword FROM (SELECT doc_id, lang, unnest(m) AS u FROM w)) SELECT lang, tag, count(DISTINCT doc_id) AS docs, count(DISTINCT keyword) AS keywords, count(*) AS mentions FROM k JOIN lex USING (keyword) GROUP BY 1, 2""")
def lexicon_facets(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon file's facets over all texts; a phrase may have several tags."""
    path = f"{scratch.folder(spark, 'lexicon')}/lexicon.json"
    facets = spark.createDataFrame([(t.lower(), t, ps) for t, ps in _LEX.items()], "id string, tag string, phrases array<string>")
    sinks.save_lines(facets.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("facets"))).alias("value")), path)
    lexicon = reference_data.read_lexicon(spark, path)
    phrases = sorted({r.keyword for r in lexicon.select("keyword").distinct().collect()})  # a list kept by hand
    tags = tx.tag(texts(spark, d).select("doc_id", "lang", "text"), "text", lexicon, phrases, unicode=False)
    return tags.groupBy("lang", "tag").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("keyword").alias("keywords"), F.count(F.lit(1)).alias("mentions"))


@query(f"""{FILINGS}, docs AS (SELECT uuid, registrant, client, yr, CASE WHEN ln % 2 = 1 THEN 'senate' ELSE 'house' END AS ds FROM filings WHERE issue LIKE '1-%'), raw AS (SELECT uuid, yr, 'client' AS role, 'Client ' || client % 400 AS raw FROM docs UNION ALL SELECT uuid, yr, 'registrant', 'Firm ' || registrant || CASE WHEN ds = 'house' THEN ' LLC' ELSE '' END FROM docs),
    n AS (SELECT *, upper(regexp_replace(raw, ' LLC$', '')) AS key FROM raw), e AS (SELECT role, key, arg_max(raw, (c, raw)) AS player, role || ':' || key AS entity_id FROM (SELECT role, key, raw, count(*) AS c FROM n GROUP BY ALL) GROUP BY role, key),
    s AS (SELECT 'CLIENT ' || client % 400 AS key, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY 1)
    SELECT n.role, e.player, e.entity_id, count(DISTINCT uuid) AS n_filings, min(yr) AS first_year, max(yr) AS last_year, any_value(s.total) AS total_spend FROM n JOIN e USING (role, key) LEFT JOIN s ON n.role = 'client' AND s.key = n.key GROUP BY 1, 2, 3 HAVING count(DISTINCT uuid) >= 3""")
def industry_map(spark: SparkSession, d: str) -> DataFrame:
    """D3: an issue's players by role, as resolved entities, those of three filings or more, with what clients spend on everything."""
    f = filings(spark, d)
    client = F.concat(F.lit("Client "), (F.col("client") % 400).cast("string"))
    firm = F.concat(F.lit("Firm "), F.col("registrant").cast("string"), F.when(F.col("ln") % 2 == 0, " LLC").otherwise(""))
    legs = F.array(F.struct(F.lit("client").alias("kind"), client.alias("raw_name")), F.struct(F.lit("registrant").alias("kind"), firm.alias("raw_name")))
    raw = f.filter(F.col("issue").startswith("1-")).select("uuid", "yr", F.explode(legs).alias("l")).select("uuid", "yr", "l.kind", "l.raw_name")
    alias = entities.aliases(raw.select("kind", "raw_name", F.lit("all").alias("dataset"), F.lit(None).cast("string").alias("source_id")))
    ent = entities.entities(alias)
    spend = f.groupBy(nm.name_key(client).alias("norm_key")).agg(money(F.sum("amount")).alias("total_spend")).withColumn("kind", F.lit("client"))
    out = raw.join(entities.alias_entities(alias, ent), ["kind", "raw_name"]).groupBy("entity_id").agg(F.count_distinct("uuid").alias("n_filings"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year")).filter("n_filings >= 3")
    out = out.join(ent.select("entity_id", "kind", "norm_key", F.col("canonical_name").alias("player")), "entity_id").join(spend, ["kind", "norm_key"], "left")
    return out.select(F.col("kind").alias("role"), "player", "entity_id", "n_filings", "first_year", "last_year", "total_spend")


_ITEMS = f"""{FILINGS}, i AS (SELECT 'Firm ' || registrant % 50 AS registrant_name, CASE WHEN ln % 3 = 0 THEN 'Al ' || ln END AS lobbyist_name, CASE WHEN ln % 3 = 0 THEN 'lobbyist' ELSE 'organization' END AS filer_type, yr AS filing_year, flag AS contribution_type, round(amount, -3) AS amount, 'Payee ' || client % 60 AS payee_name, status AS honoree_name, qidx AS date, uuid FROM filings),
    dd AS (SELECT registrant_name, lobbyist_name, filer_type, filing_year, contribution_type, amount, payee_name, honoree_name, date, min(uuid) AS cited, count(DISTINCT uuid) AS versions, count(*) AS raw_items FROM i GROUP BY ALL)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Line items as contributions; amounts in thousands, so that some are filed again."""
    text = lambda c: c.cast("string")
    own = F.col("ln") % 3 == 0
    return filings(spark, d).select(
        F.concat(F.lit("Firm "), text(F.col("registrant") % 50)).alias("registrant_name"), F.when(own, F.concat(F.lit("Al "), text(F.col("ln")))).alias("lobbyist_name"), F.when(own, "lobbyist").otherwise("organization").alias("filer_type"), F.col("yr").alias("filing_year"), F.col("flag").alias("contribution_type"),
        F.round("amount", -3).alias("amount"), F.concat(F.lit("Payee "), text(F.col("client") % 60)).alias("payee_name"), F.col("status").alias("honoree_name"), F.col("qidx").alias("date"), F.lit(None).cast("string").alias("contributor_name"), F.col("uuid").alias("filing_uuid"),
    )


@query(f"""{_ITEMS}, l AS (SELECT 'type' AS leg, contribution_type AS key, amount FROM dd UNION ALL SELECT 'year', filing_year::VARCHAR, amount FROM dd UNION ALL SELECT 'filer', filer_type, amount FROM dd UNION ALL SELECT 'recipient', upper(payee_name), amount FROM dd UNION ALL SELECT 'entity', registrant_name, amount FROM dd UNION ALL SELECT 'all', NULL, amount FROM dd)
    SELECT leg, key, count(*) AS items, sum(amount)::DOUBLE AS total FROM l GROUP BY 1, 2 UNION ALL SELECT 'raw', NULL, count(*), sum(amount)::DOUBLE FROM i""")
def giving_legs(spark: SparkSession, d: str) -> DataFrame:
    """Contributions counted once, by type, year, filer, recipient and entity in one pass, beside the raw total."""
    items = _items(spark, d)
    own = giving.legs(giving.once(items), {"type": "contribution_type", "year": "filing_year", "filer": "filer_type", "recipient": F.upper("payee_name"), "entity": "registrant_name", "all": F.lit(None)})
    raw = items.agg(F.count(F.lit(1)).alias("items"), F.sum("amount").alias("total")).select(F.lit("raw").alias("leg"), F.lit(None).cast("string").alias("key"), "items", "total")
    return own.unionByName(raw).withColumn("total", F.col("total").cast("double"))


@query(f"{_ITEMS} SELECT cited, registrant_name, amount::DOUBLE AS amount, versions, raw_items FROM dd ORDER BY amount DESC, cited LIMIT 50")
def giving_sample(spark: SparkSession, d: str) -> DataFrame:
    """The fifty largest items with the filing that shows them and their versions."""
    return giving.once(_items(spark, d)).select("cited", "registrant_name", F.col("amount").cast("double").alias("amount"), "versions", "raw_items").orderBy(F.col("amount").desc(), "cited").limit(50)


@query(f"""{_ITEMS}, t AS (SELECT registrant_name AS giver, payee_name AS recipient, sum(amount) AS a FROM dd GROUP BY 1, 2), s AS (SELECT giver, sum(a) AS total FROM t GROUP BY 1 HAVING sum(a) >= 100000)
    SELECT giver, recipient, a::DOUBLE AS amount, round((a / total)::DOUBLE, 6) AS share FROM t JOIN s USING (giver) WHERE a / total >= 0.03""")
def honoree_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Givers much of whose money goes to one recipient."""
    items = giving.once(_items(spark, d)).select(F.col("registrant_name").alias("giver"), F.col("payee_name").alias("recipient"), "amount")
    return giving.concentrated(items, 100_000, 0.03).select("giver", "recipient", F.col("amount").cast("double").alias("amount"), F.round(F.col("share").cast("double"), 6).alias("share"))


@query(f"""{FILINGS}, one AS (SELECT * FROM filings WHERE filing_type NOT IN ('RR', 'RA') QUALIFY row_number() OVER (PARTITION BY registrant, client, yr, q {LATEST_SQL}) = 1), p AS (SELECT registrant, client, {', '.join(f"coalesce(sum(amount) FILTER (WHERE yr = {y}), 0) AS y{y}" for y in (1995, 1996, 1997, 1998))} FROM one GROUP BY 1, 2)
    SELECT registrant, client, round(y1997, 2)::DOUBLE AS y1997, round(y1998, 2)::DOUBLE AS y1998 FROM p WHERE y1995 = 0 AND y1996 = 0 AND y1997 >= 20000 AND y1998 >= 20000""")
def emerging(spark: SparkSession, d: str) -> DataFrame:
    """Engagements that were nothing for two years and large in the next two."""
    f = filings(spark, d).filter("filing_type NOT IN ('RR', 'RA')")
    one = latest_by(f, ["registrant", "client", "yr", "q"], latest_order())
    of = lambda y: F.coalesce(F.sum(F.when(F.col("yr") == y, F.col("amount"))), F.lit(0)).alias(f"y{y}")
    p = one.groupBy("registrant", "client").agg(*[of(y) for y in (1995, 1996, 1997, 1998)])
    return p.filter("y1995 = 0 AND y1996 = 0 AND y1997 >= 20000 AND y1998 >= 20000").select("registrant", "client", money("y1997").alias("y1997"), money("y1998").alias("y1998"))


@query(f"""{FILINGS}, r AS (SELECT 'C' || client % 8 AS committee_id, CASE WHEN ln <> 3 THEN 't' || ok % 5000 END AS transaction_id, uuid AS sub_id, CASE WHEN ln = 6 THEN 'X' END AS memo, CASE ln % 5 WHEN 0 THEN '17' WHEN 1 THEN '11AI' WHEN 2 THEN '11C' WHEN 3 THEN '12' ELSE '15' END AS line, CASE flag WHEN 'A' THEN 'ORG' WHEN 'R' THEN 'IND' END AS entity_type,
      CASE WHEN pk % 2 = 0 THEN 'DOE, JANE' ELSE 'Acme Fund, Inc.' END AS name, 'Employer ' || registrant % 9 AS employer, amount FROM filings),
    n AS (SELECT * FROM r WHERE coalesce(memo, '') <> 'X'), o AS (SELECT * FROM n WHERE transaction_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY committee_id, transaction_id ORDER BY sub_id) = 1 UNION ALL SELECT * FROM n WHERE transaction_id IS NULL),
    c AS (SELECT *, CASE left(line, 2) WHEN '11' THEN 'contribution' WHEN '12' THEN 'transfer' WHEN '15' THEN 'refund_offset' ELSE 'other_receipt' END AS category, CASE WHEN entity_type IS NULL THEN pk2 ELSE entity_type = 'IND' END AS person FROM (SELECT *, name = 'DOE, JANE' AS pk2 FROM o))
    SELECT committee_id, category, CASE WHEN category = 'contribution' THEN CASE WHEN person THEN employer ELSE 'organisations' END END AS who, count(*) AS items, round(sum(amount), 2)::DOUBLE AS total FROM c GROUP BY 1, 2, 3""")
def receipts_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Receipts from cached pages: memo entries out, a transaction once, only lines 11 are gifts, people by employer apart from organisations."""
    folder, ln = scratch.folder(spark, "receipts"), F.col("ln")
    text = lambda c: c.cast("string")
    line = F.element_at(F.array(*[F.lit(x) for x in ("17", "11AI", "11C", "12", "15")]), (ln % 5 + 1).cast("int"))
    row = F.struct(
        F.concat(F.lit("C"), text(F.col("client") % 8)).alias("committee_id"), F.when(ln != 3, F.concat(F.lit("t"), text(F.col("ok") % 5000))).alias("transaction_id"), F.col("uuid").alias("sub_id"), F.when(ln == 6, "X").alias("memo_code"), line.alias("line_number"),
        F.when(F.col("flag") == "A", "ORG").when(F.col("flag") == "R", "IND").alias("entity_type"), F.when(F.col("pk") % 2 == 0, "DOE, JANE").otherwise("Acme Fund, Inc.").alias("contributor_name"), F.concat(F.lit("Employer "), text(F.col("registrant") % 9)).alias("contributor_employer"), F.col("amount").cast("double").alias("contribution_receipt_amount"),
    )
    filings(spark, d).select(F.to_json(F.struct(F.array(row).alias("results"))).alias("value")).write.text(f"{folder}/pages")  # a receipt a page, a page a line
    raw = spark.read.schema(f"results array<struct<{reference_data._RECEIPT}>>").json(f"{folder}/pages").select(F.explode("results").alias("r")).select("r.*")
    rows = giving.receipts(raw).withColumn("amount", F.col("contribution_receipt_amount").cast("decimal(18,4)"))
    who = F.when(F.col("category") == "contribution", F.when(F.col("person"), F.col("contributor_employer")).otherwise("organisations"))
    return rows.groupBy("committee_id", "category", who.alias("who")).agg(F.count(F.lit(1)).alias("items"), money(F.sum("amount")).alias("total"))


_ENG = f"""{FILINGS}, f AS (SELECT *, issue LIKE '1-%' AS tagged, CASE WHEN ln % 3 = 0 THEN 0 ELSE 1 END AS n_act, filing_type LIKE 'R%' AS reg, {_TERM} AS term FROM filings),
    pr AS (SELECT registrant, client, min(uuid) FILTER (WHERE reg AND tagged) AS reg_uuid, max(qidx) FILTER (WHERE term) AS terminated FROM f GROUP BY 1, 2 HAVING bool_or(tagged)),
    w AS (SELECT *, bool_or(tagged) OVER g AS tt, max(n_act) OVER g AS declared FROM f WHERE NOT reg WINDOW g AS (PARTITION BY registrant, client, qidx)), d AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY registrant, client, qidx ORDER BY posted DESC, uuid DESC) = 1),
    x AS (SELECT d.*, reg_uuid, terminated FROM d JOIN pr USING (registrant, client) WHERE tt OR (reg_uuid IS NOT NULL AND declared = 0))"""


@query(f"""{_ENG} SELECT registrant, client, min(qidx) AS first_q, max(qidx) AS last_q, count(*) AS quarters, round(sum(amount), 2)::DOUBLE AS total, any_value(terminated) AS terminated, coalesce(max(uuid) FILTER (WHERE tt), any_value(reg_uuid)) AS sample, CASE WHEN bool_or(tt) THEN 'quarterly-text' ELSE 'registration-only' END AS basis FROM x GROUP BY 1, 2""")
def credited_engagements(spark: SparkSession, d: str) -> DataFrame:
    """Engagements with the credit of a tagged registration for quarters that declare nothing."""
    f = filings(spark, d).withColumns({"tagged": F.col("issue").startswith("1-"), "n_activities": F.when(F.col("ln") % 3 == 0, 0).otherwise(1), "registration": F.col("filing_type").startswith("R"), "terminates": F.col("filing_type").rlike("^[1-4](T|TY|@|@Y)$")})
    return pk.engagements(f, [F.col("posted").desc(), F.col("uuid").desc()]).withColumn("total", money("total"))


@query(f"""{FILINGS}, p AS (SELECT client, count(*) FILTER (WHERE issue LIKE '1-%') AS tagged, count(*) FILTER (WHERE filing_type <> 'RR') AS n, round(sum(amount), 2)::DOUBLE AS spend FROM filings GROUP BY 1 HAVING count(*) FILTER (WHERE issue LIKE '1-%') > 0),
    r AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN 100.0 * tagged / n >= 20 THEN 'forward' ELSE 'diversified' END AS roster FROM p) SELECT roster, count(*) AS players, sum(tagged)::BIGINT AS tagged, round(sum(spend::DECIMAL(18, 2)), 2)::DOUBLE AS spend, (SELECT count(*) FROM p) AS of_all FROM r GROUP BY 1""")
def roster_split(spark: SparkSession, d: str) -> DataFrame:
    """Players by the share that an issue has of what they do; the parts' counts add up to all of them."""
    hit = F.col("issue").startswith("1-")
    p = filings(spark, d).groupBy("client").agg(F.count_if(hit).alias("tagged"), F.count_if(F.col("filing_type") != "RR").alias("n"), money(F.sum("amount")).cast("decimal(18,2)").alias("spend")).filter("tagged > 0")
    out = pk.split_by_share(p, F.col("tagged"), F.col("n"), 20.0).groupBy("roster").agg(F.count(F.lit(1)).alias("players"), F.sum("tagged").alias("tagged"), F.sum("spend").cast("double").alias("spend"))
    return out.withColumn("of_all", F.sum("players").over(Window.partitionBy()))


@query(f"""{_ITEMS}, w AS (SELECT payee_name, sum(amount) AS v FROM dd GROUP BY 1), p AS (SELECT payee_name, contribution_type, sum(amount) AS v FROM dd GROUP BY 1, 2), s AS (SELECT payee_name, sum(v) AS v FROM p GROUP BY 1) SELECT count(*) AS checked, count(*) FILTER (WHERE w.v IS NULL OR s.v IS NULL OR abs(w.v - s.v) > 0.01) AS off FROM w FULL JOIN s USING (payee_name)""")
def partition_gate(spark: SparkSession, d: str) -> DataFrame:
    """Slices of giving add up to the whole per recipient and add no keys; off must be 0."""
    items = giving.once(_items(spark, d))
    whole = items.groupBy("payee_name").agg(F.sum("amount").alias("v"))
    parts = items.groupBy("payee_name", "contribution_type").agg(F.sum("amount").alias("v"))
    off = checks.partitioned(parts, whole, ["payee_name"], "v").agg(F.count(F.lit(1)).alias("off"))
    return whole.agg(F.count(F.lit(1)).alias("checked")).crossJoin(off)


@query(f"""{_PAIRS}, t AS (SELECT e.qidx, 'term' AS kind, e.registrant, e.client, (SELECT sum(h.amount) FROM pq h WHERE h.registrant = e.registrant AND h.client = e.client AND h.paid_by IS NOT NULL AND h.qidx > e.qidx - 4 AND h.qidx <= e.qidx) AS v, e.cite AS cite FROM pq e WHERE e.ended),
    h AS (SELECT fq.qidx, 'hire' AS kind, registrant, client, amount AS v, coalesce(paid_by, hire) AS cite FROM fq JOIN pq USING (registrant, client, qidx)), u AS (SELECT * FROM t UNION ALL SELECT * FROM h)
    SELECT qidx, kind, registrant, client, round(v, 2)::DOUBLE AS amount, cite, row_number() OVER (PARTITION BY qidx, kind ORDER BY coalesce(v, 0) DESC, client, registrant) AS rk FROM u QUALIFY rk <= 30""")
def turnover_top(spark: SparkSession, d: str) -> DataFrame:
    """Of every quarter the thirty largest ends, by what they paid in its last four quarters, and the thirty largest beginnings."""
    p = _pairs(spark, d)
    band = Window.partitionBy("registrant", "client").orderBy("qidx").rangeBetween(-3, 0)
    p = p.withColumn("trail", F.sum(F.when(F.col("reported"), F.col("amount"))).over(band)).withColumn("first_q", F.min("qidx").over(Window.partitionBy("registrant", "client"))).withColumn("hire", F.min_by("first", "qidx").over(Window.partitionBy("registrant", "client")))
    kinds = F.array(F.when(F.col("ended"), F.struct(F.lit("term").alias("kind"), F.col("trail").alias("v"), F.col("cite").alias("cite"))), F.when(F.col("qidx") == F.col("first_q"), F.struct(F.lit("hire").alias("kind"), F.col("amount").alias("v"), F.coalesce("paid_by", "hire").alias("cite"))))
    rows = p.select("qidx", "registrant", "client", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("qidx", "k.kind", "registrant", "client", "k.v", "k.cite")
    top = top_per_group(rows, ["qidx", "kind"], [F.coalesce("v", F.lit(0)).desc(), F.col("client"), F.col("registrant")], 30)
    return top.select("qidx", "kind", "registrant", "client", money("v").alias("amount"), "cite", F.col("rk").cast("long").alias("rk"))


@query(f"{FILINGS}, t AS (SELECT DISTINCT client FROM filings WHERE issue LIKE '1-%') SELECT client, qidx, count(*) AS n_filings, count(*) FILTER (WHERE issue LIKE '1-%') AS n_tagged, round(sum(amount), 2)::DOUBLE AS spend, min(uuid) FILTER (WHERE issue LIKE '1-%') AS sample FROM filings WHERE client IN (SELECT client FROM t) GROUP BY 1, 2")
def player_quarters(spark: SparkSession, d: str) -> DataFrame:
    """A player's quarters with filings, spend and a sample to cite."""
    hit = F.col("issue").startswith("1-")
    q = filings(spark, d).groupBy("client", "qidx").agg(F.count(F.lit(1)).alias("n_filings"), F.count_if(hit).alias("n_tagged"), money(F.sum("amount")).alias("spend"), F.min(F.when(hit, F.col("uuid"))).alias("sample"))
    return q.withColumn("any", F.max("n_tagged").over(Window.partitionBy("client"))).filter("any > 0").drop("any")


@query(f"{FILINGS}, t AS (SELECT registrant, count(DISTINCT client) AS n_clients, count(*) AS n_filings, string_agg(DISTINCT filing_type, ';' ORDER BY filing_type) AS kinds, min(qidx) AS first_q, max(qidx) AS last_q FROM filings WHERE issue LIKE '1-%' GROUP BY 1) SELECT * FROM t")
def package_registrants(spark: SparkSession, d: str) -> DataFrame:
    """The firms of an issue."""
    f = filings(spark, d).filter(F.col("issue").startswith("1-"))
    return f.groupBy("registrant").agg(F.count_distinct("client").alias("n_clients"), F.count(F.lit(1)).alias("n_filings"), F.array_join(F.array_sort(F.collect_set("filing_type")), ";").alias("kinds"), F.min("qidx").alias("first_q"), F.max("qidx").alias("last_q"))


@query(f"{FILINGS}, c AS (SELECT p_brand AS code, qidx, count(DISTINCT ok) AS n FROM filings JOIN part ON pk = p_partkey GROUP BY 1, 2) SELECT code, qidx, n, n - lag(n) OVER (PARTITION BY code ORDER BY qidx) AS change FROM c")
def code_trend(spark: SparkSession, d: str) -> DataFrame:
    """Filings per code and quarter and the change to the one before."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), F.col("p_brand").alias("code"))
    c = filings(spark, d).join(p, "pk").groupBy("code", "qidx").agg(F.count_distinct("ok").alias("n"))
    return c.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("code").orderBy("qidx")))


@query("""WITH e AS (SELECT event_id::VARCHAR AS row_id, event_type FROM events), x AS (SELECT event_id::VARCHAR AS row_id, upper(event_type) AS theme FROM events) SELECT row_id, event_type, theme FROM e LEFT JOIN x USING (row_id)""")
def drafted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined to their drafted labels, after a check that there are as many."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("row_id"), "event_type")
    labels = e.select("row_id", F.upper("event_type").alias("theme"))
    return checks.same_rows(e, labels).join(labels, "row_id", "left")


_SHOWN = "CASE s_suppkey % 5 WHEN 0 THEN 'ACME GLOBAL HOLDINGS USA' WHEN 1 THEN 'Foris Dax, Inc.' WHEN 2 THEN 'Old (fka New) d/b/a Shop Company' WHEN 3 THEN 'Extraordinarily-Long-Name LLC' ELSE 'Payward Ventures LLC' END"


@query(f"""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Acme Global Holdings USA' ELSE {_SHOWN} END AS title, CASE s_suppkey % 5 WHEN 0 THEN 'ACME GLOBAL' WHEN 1 THEN 'Foris Dax' WHEN 2 THEN 'Shop' WHEN 3 THEN 'Extraordinarily-' ELSE 'Payward Ventures' END AS short,
    CASE s_suppkey % 5 WHEN 1 THEN 'Foris (combined)' WHEN 4 THEN 'Kraken (combined)' ELSE {_SHOWN} END AS family FROM supplier""")
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are shown: in title case, shortened, by family."""
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, "ACME GLOBAL HOLDINGS USA").when(k == 1, "Foris Dax, Inc.").when(k == 2, "Old (fka New) d/b/a Shop Company").when(k == 3, "Extraordinarily-Long-Name LLC").otherwise("Payward Ventures LLC")
    families = {"Foris (combined)": ["FORIS", "CRYPTO.COM"], "Kraken (combined)": ["PAYWARD", "KRAKEN"]}
    return table(spark, d, "supplier").select("s_suppkey", nm.title_case(name).alias("title"), nm.shorten(name).alias("short"), nm.family(name, families).alias("family"))
