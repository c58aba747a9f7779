"""Sources and sinks: test tables written in the documents' own formats and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, members
from ..sources import house, press, reference_data, scratch, senate, sinks
from . import query
from .tables import table




def _json(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def _array_file(rows: DataFrame, path: str, key: str, value: Column | None = None) -> None:
    """One file with an array of the objects in value, or that a column expression makes of sorted rows, in the order of ``key``."""
    ends = rows.agg(F.min(key).alias("__first"), F.max(key).alias("__last"))
    out = rows.crossJoin(F.broadcast(ends))
    line = F.concat(F.when(F.col(key) == F.col("__first"), "[\n").otherwise(""), F.col("value") if value is None else value, F.when(F.col(key) == F.col("__last"), "]").otherwise(","))
    sinks.save_lines(out, path, line, by=[key])


def _press(spark: SparkSession, d: str) -> list[str]:
    """Documents as releases in files of six months, their lines in the order of ids, each followed by a blank one."""
    folder, docs = scratch.folder(spark, "press"), table(spark, d, "documents")
    date = F.format_string("2025-%02d-15", F.col("doc_id") % 6 + 1)
    member = F.struct(F.format_string("N%d", F.col("doc_id") % 25).alias("bioguide_id"), F.col("lang").alias("party"))
    line = F.to_json(F.struct(F.concat(F.lit("https://example.org/"), F.col("doc_id")).alias("url"), F.col("lang").alias("title"), date.alias("date"), member.alias("member"), F.col("text")))
    paths = [f"{folder}/2025-{month + 1:02}.jsonl" for month in range(6)]
    sinks.save_files(docs, paths, F.col("doc_id") % 6, F.concat(line, F.lit("\n")), by=["doc_id"])
    return paths


_PRESS = """WITH p AS (SELECT *, doc_id % 6 AS m, '2025-0' || (doc_id % 6 + 1) || '.jsonl' AS src_file, 2 * row_number() OVER (PARTITION BY doc_id % 6 ORDER BY doc_id) - 1 AS src_line FROM documents)"""


@query(f"{_PRESS} SELECT row_number() OVER (ORDER BY src_file, src_line) AS pr_id, src_file, src_line::INTEGER AS src_line, 'N' || doc_id % 25 AS bioguide_id, lang AS party, 'first_quarter' AS quarter, md5(text) AS hash FROM p WHERE m < 3")
def press_files(spark: SparkSession, d: str) -> DataFrame:
    """Releases of a quarter's three files, numbered by file and line; blank lines count as lines."""
    scope = reference_data.sample_scope("2025-Q1")
    rows = press.read_press(spark, _press(spark, d), scope["years"], scope["months"])
    return rows.select("pr_id", "src_file", "src_line", "member.bioguide_id", "member.party", "quarter", F.md5(F.col("text").cast("binary")).alias("hash"))


@query(f"{_PRESS}, k AS (SELECT src_file || ':' || src_line AS record_key, lang FROM p), e AS (SELECT CASE WHEN doc_id % 4 = 0 THEN src_file || ':' || src_line END AS record_key, doc_id FROM p) SELECT e.doc_id, lang FROM e LEFT JOIN k USING (record_key)")
def press_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Releases joined by the key that cites them, file and line; rows that cite none are dealt by their own ids, as null keys would all meet in one task."""
    rows = press.read_press(spark, _press(spark, d)).withColumn("record_key", press.press_key())
    asked = rows.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), "record_key")
    asked = asked.withColumn("record_key", F.when(F.col("doc_id") % 4 == 0, F.col("record_key")))
    asked = asked.withColumn("record_key", F.coalesce("record_key", F.concat(F.lit("\0"), F.col("doc_id").cast("string"))))  # no file's name has that character
    return asked.join(rows.select("record_key", F.col("title").alias("lang")), "record_key", "left").select("doc_id", "lang")


def _orders(spark: SparkSession, d: str) -> str:
    """Orders as filings with two activities, in one JSON array."""
    path = f"{scratch.folder(spark, 'senate')}/filings_2025.json"
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    text = lambda c: c.cast("string")
    person = F.struct(F.struct(F.lit("Ann").alias("first_name"), F.concat(F.lit(" L"), text(key % 50)).alias("last_name")).alias("lobbyist"), F.when(key % 3 == 0, F.lit("Counsel")).alias("covered_position"), (key % 2 == 0).alias("new"))
    agency = F.when(key % 2 == 0, F.to_json(F.struct(F.lit("SENATE").alias("name")))).otherwise(F.lit("HOUSE"))
    act = lambda k: F.struct(F.left("o_orderpriority", F.lit(1)).alias("general_issue_code"), F.concat(F.lit("H.R. "), text(key % 90 + k), F.lit(" and s. 7")).alias("description"), F.array(person).alias("lobbyists"), F.array(agency).alias("government_entities"))
    filing = F.struct(
        F.concat(F.lit("f"), text(key)).alias("filing_uuid"), F.concat(F.lit("Q"), text(F.quarter("o_orderdate"))).alias("filing_type"), F.year("o_orderdate").alias("filing_year"), F.format_number("o_totalprice", 2).alias("income"), F.lit("n/a").alias("expenses"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt_posted"), F.struct((key % 20).alias("id"), F.concat(F.lit("Firm "), text(key % 20)).alias("name"), text(key % 7).alias("house_registrant_id")).alias("registrant"),
        F.struct(F.when(key % 2 == 0, F.col("o_custkey")).alias("id"), (F.col("o_custkey") + 1).alias("client_id"), F.concat(F.lit("Client "), text(F.col("o_custkey"))).alias("name")).alias("client"),
        F.when(key % 5 != 0, F.array(act(0), act(1))).alias("lobbying_activities"), F.when(key % 11 == 0, F.array(F.struct(F.lit("Abroad").alias("name"), F.lit("X").alias("country")))).alias("foreign_entities"),
    )
    _array_file(o, path, "o_orderkey", F.to_json(filing))
    return path


_SENATE = "WITH o AS (SELECT *, 'f' || o_orderkey AS filing_uuid, (row_number() OVER (ORDER BY o_orderkey) - 1)::INTEGER AS src_index FROM orders), a AS (SELECT *, unnest([0, 1]) AS activity_index FROM o WHERE o_orderkey % 5 <> 0)"


@query(f"""{_SENATE} SELECT filing_uuid, src_index, 'Q' || quarter(o_orderdate) AS filing_type, year(o_orderdate)::INTEGER AS filing_year, round(o_totalprice::DECIMAL(18, 2), 2)::DOUBLE AS income, NULL::DOUBLE AS expenses, 'Firm ' || o_orderkey % 20 AS registrant_name,
    (o_orderkey % 7)::VARCHAR AS house_registrant_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END::VARCHAR AS client_id FROM o""")
def senate_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings out of an array, with their place in it; a client's id comes before its client_id."""
    out = senate.read_filings(spark, _orders(spark, d))["filings"]
    return out.select("filing_uuid", "src_index", "filing_type", "filing_year", "income", "expenses", "registrant_name", "house_registrant_id", "client_id")


@query(f"""{_SENATE}, b AS (SELECT filing_uuid, activity_index, unnest(['H.R. ' || (o_orderkey % 90 + activity_index), 's. 7']) AS raw, unnest([0, 1]) AS mention_index FROM a)
    SELECT filing_uuid, activity_index, 'activity' AS kind, left(o_orderpriority, 1) AS a, NULL AS b FROM a UNION ALL SELECT filing_uuid, activity_index, 'lobbyist', 'Ann L' || o_orderkey % 50, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END FROM a
    UNION ALL SELECT filing_uuid, activity_index, 'agency', CASE WHEN o_orderkey % 2 = 0 THEN 'SENATE' ELSE 'HOUSE' END, NULL FROM a UNION ALL SELECT filing_uuid, activity_index, 'bill ' || mention_index, replace(replace(upper(raw), '.', ''), ' ', ''), raw FROM b
    UNION ALL SELECT filing_uuid, NULL, 'foreign', 'Abroad', 'X' FROM o WHERE o_orderkey % 11 = 0""")
def senate_children(spark: SparkSession, d: str) -> DataFrame:
    """Every child table of the filings, one under the other."""
    t = senate.read_filings(spark, _orders(spark, d))
    row = lambda df, kind, a, b, at="activity_index": df.select("filing_uuid", (F.col(at) if at else F.lit(None).cast("int")).alias("activity_index"), kind.alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    out = row(t["activities"], F.lit("activity"), F.col("general_issue_code"), none)
    out = out.unionByName(row(t["lobbyists"], F.lit("lobbyist"), F.concat_ws(" ", "first_name", "last_name"), F.col("is_new").cast("string")))
    out = out.unionByName(row(t["gov_entities"], F.lit("agency"), F.col("gov_name"), none))
    out = out.unionByName(row(t["bill_mentions"], F.concat(F.lit("bill "), F.col("mention_index")), F.col("bill"), F.col("raw")))
    return out.unionByName(row(t["foreign_entities"], F.lit("foreign"), F.col("name"), F.col("country"), None))


@query(f"""{_SENATE}, w AS (SELECT filing_uuid, 'Firm ' || o_orderkey % 20 AS registrant, CASE WHEN o_orderkey % 5 <> 0 THEN left(o_orderpriority, 1) ELSE '' END AS codes, CASE WHEN o_orderkey % 5 <> 0 THEN 'H.R. ' || o_orderkey % 90 || ' and s. 7 | H.R. ' || (o_orderkey % 90 + 1) || ' and s. 7' END AS issue_text, o_totalprice AS p FROM o)
    SELECT filing_uuid, registrant, codes, issue_text FROM w WHERE regexp_matches(lower(registrant), 'firm 1') AND regexp_matches(lower(issue_text), 'h.r. 8|s. 7') AND round(p::DECIMAL(18, 2), 2)::DOUBLE >= 20000""")
def filing_loader(spark: SparkSession, d: str) -> DataFrame:
    """Filings read from their file, one wide row each, filtered by the terms a caller gives."""
    wide = senate.wide_filings(senate.read_filings(spark, _orders(spark, d)))
    out = filters.select_filings(wide, registrant="Firm 1", issues=["h.r. 8", "s. 7"], least=20000)
    return out.select("filing_uuid", "registrant", F.array_join("codes", ";").alias("codes"), "issue_text")


def _reports(spark: SparkSession, d: str) -> str:
    """Suppliers as contribution reports, their parts as items."""
    path = f"{scratch.folder(spark, 'ld203')}/contributions_2025.json"
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    text = lambda c: c.cast("string")
    item = lambda k: F.struct(F.when(key % 2 == 0, "feca").alias("contribution_type"), F.when(key % 2 == 1, "he").alias("type"), F.when((key + k) % 3 != 0, F.concat(F.lit("Rep. X"), text(key % 9), F.lit(" ., "))).alias("honoree_name"), F.lit(" payee ").alias("payee"), F.concat(F.lit("1,"), F.lpad(text(key % 900 + k), 3, "0")).alias("amount"), F.lit("2025-02-03").alias("contribution_date"))
    report = F.struct(
        F.concat(F.lit("c"), text(key)).alias("uuid"), F.when(key % 4 == 0, "lobbyist").otherwise("organization").alias("filer_type"), F.lit(2025).alias("filing_year"), F.struct(F.col("s_name").alias("name")).alias("registrant"),
        F.when(key % 4 == 0, F.struct(F.lit("Al").alias("first_name"), F.concat(F.lit("Ly"), text(key)).alias("last_name"))).alias("lobbyist"), F.when(key % 3 == 0, F.array(F.lit(" P1"), F.to_json(F.struct(F.lit("P2").alias("name"))))).alias("pacs"), F.array(item(0), item(1)).alias("contribution_items"),
    )
    _array_file(s, path, "s_suppkey", F.to_json(report))
    return path


@query("""WITH i AS (SELECT s_suppkey AS k, unnest([0, 1]) AS item_index, * FROM supplier)
    SELECT 'c' || k AS filing_uuid, item_index, CASE WHEN k % 2 = 0 THEN 'feca' ELSE 'he' END AS contribution_type, CASE WHEN (k + item_index) % 3 <> 0 THEN 'REP. X' || k % 9 ELSE 'PAYEE' END AS recipient, (1000 + k % 900 + item_index)::DOUBLE AS amount, '2025-02-03' AS date,
      CASE WHEN k % 4 = 0 THEN 'Al Ly' || k END AS lobbyist_name, CASE WHEN k % 3 = 0 THEN 'P1; P2' END AS pacs, CASE WHEN k % 4 = 0 THEN 'lobbyist' ELSE 'organization' END AS filer_type FROM i""")
def contribution_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports and items whose fields go by either of their names, committees by name or as objects."""
    t = senate.read_contributions(spark, _reports(spark, d))
    items = t["items"].select("filing_uuid", "item_index", "contribution_type", senate.recipient().alias("recipient"), "amount", "date")
    return items.join(t["reports"].select("filing_uuid", "lobbyist_name", "pacs", "filer_type"), "filing_uuid")


@query("""WITH s AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 END AS n FROM supplier), f AS (SELECT s_suppkey::VARCHAR AS filing_id, NULL::INTEGER AS ali_index, 'BUD' AS code, 'flat ' || s_suppkey AS description, 'Q' AS last_name FROM s WHERE n IS NULL),
    b AS (SELECT s_suppkey::VARCHAR AS filing_id, unnest(range(n + 1))::INTEGER AS ali_index, 'TAX' AS code, 'about ' || s_suppkey AS description, 'Y' AS last_name FROM s WHERE n IS NOT NULL), x AS (SELECT * FROM f UNION ALL SELECT * FROM b)
    SELECT filing_id, 2025 AS filing_year, 'first_quarter' AS filing_period, 'Org ' || filing_id AS registrant_name, (1000 + filing_id::BIGINT % 50)::DOUBLE AS income, ali_index, code, description, last_name FROM x""")
def house_documents(spark: SparkSession, d: str) -> DataFrame:
    """One document a supplier, with blocks or flat; empty lobbyist slots are left out."""
    folder = f"{scratch.folder(spark, 'house')}/2025_1stQuarter_XML"
    s, key = table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    people = lambda last: tag("lobbyists", F.lit(f"<lobbyist><lobbyistFirstName>X</lobbyistFirstName><lobbyistLastName>{last}</lobbyistLastName></lobbyist><lobbyist><lobbyistFirstName> </lobbyistFirstName></lobbyist>"))
    block = tag("ali_info", F.lit("<issueAreaCode>TAX</issueAreaCode>"), tag("specific_issues", tag("description", F.lit("about "), key)), people("Y"))
    flat = F.concat(F.lit("<ali_Code>BUD</ali_Code>"), tag("specific_issues", tag("description", F.lit("flat "), key)), people("Q"))
    body = F.when(F.col("s_suppkey") % 3 == 0, flat).otherwise(tag("alis", block, F.when(F.col("s_suppkey") % 2 == 1, block).otherwise("")))
    doc = tag("LOBBYINGDISCLOSURE2", tag("organizationName", F.lit("Org "), key), tag("income", F.lit("1,0"), F.lpad((F.col("s_suppkey") % 50).cast("string"), 2, "0")), body)
    _documents(s.select(F.concat(key, F.lit(".xml")).alias("name"), doc.alias("value")), folder)
    t = house.read_house(spark, folder)
    out = t["alis"].select("filing_id", "ali_index", "code", "description").join(t["filings"].select("filing_id", "filing_year", "filing_period", "registrant_name", "income"), "filing_id")
    people_ = t["lobbyists"].select("filing_id", F.coalesce("ali_index", F.lit(-1)).alias("at"), "last_name")
    return out.withColumn("at", F.coalesce("ali_index", F.lit(-1))).join(people_, ["filing_id", "at"]).drop("at")


def _documents(df: DataFrame, folder: str) -> None:
    """A file per row (name, value), named by it."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    df.withColumn("file", F.col("name")).repartition("file").select("file", "value").write.partitionBy("file").text(f"{folder}.parts")
    files = where(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where(folder))
    for status in files.listStatus(where(f"{folder}.parts")):
        name = status.getPath().getName()
        if name.startswith("file="):
            (part,) = [s.getPath() for s in files.listStatus(status.getPath()) if s.getPath().getName().startswith("part-")]
            files.rename(part, where(f"{folder}/{name[5:]}"))
    files.delete(where(f"{folder}.parts"), True)


@query("""SELECT 'N' || n_nationkey AS bioguide_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Senate' ELSE 'House' END AS chamber, CASE WHEN n_nationkey % 5 = 0 THEN 'I' ELSE 'D' END AS party, n_nationkey % 3 = 0 AS is_current, CASE WHEN n_nationkey % 4 = 0 THEN 'Ann|Zed' END AS aka_names,
    CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS segments, DATE '2019-01-03' AS served_from, make_date(2021 + n_nationkey % 5, 1, 3) AS served_to FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 >= 1""")
def legislators(spark: SparkSession, d: str) -> DataFrame:
    """All current members, former ones by the end of their last term, segments by party."""
    folder, n, key = scratch.folder(spark, "legislators"), table(spark, d, "nation"), F.col("n_nationkey")
    end = F.format_string("%d-01-03", F.lit(2021) + key % 5)
    parts = F.when(key % 5 == 0, F.array(F.struct(F.lit("2019-01-03").alias("start"), F.lit("2020-06-01").alias("end"), F.lit("Democrat").alias("party")), F.struct(F.lit("2020-06-01").alias("start"), end.alias("end"), F.lit("Independent").alias("party"))))
    term = F.struct(F.when(key % 2 == 0, "sen").otherwise("rep").alias("type"), F.lit("2019-01-03").alias("start"), end.alias("end"), F.lit("AZ").alias("state"), F.lit("Democrat").alias("party"), parts.alias("party_affiliations"))
    other = F.when(key % 4 == 0, F.array(F.struct(F.lit("Zed").alias("first"), F.lit(None).cast("string").alias("middle"), F.lit("Ann").alias("last"))))
    person = F.struct(F.struct(F.format_string("N%d", key).alias("bioguide")).alias("id"), F.struct(F.lit("F").alias("first"), F.col("n_name").alias("last")).alias("name"), other.alias("other_names"), F.array(term).alias("terms"))
    rows = n.select(key.cast("long").alias("k"), F.to_json(person).alias("value"))
    for name, some in (("current", rows.filter("k % 3 = 0")), ("historical", rows.filter("k % 3 <> 0"))):
        _array_file(some, f"{folder}/{name}.json", "k")
    people, terms = reference_data.read_legislators(spark, [f"{folder}/current.json"], [f"{folder}/historical.json"], "2022-01-01")
    return people.join(terms.groupBy("bioguide_id").agg(F.count(F.lit(1)).alias("segments")), "bioguide_id").select("bioguide_id", "chamber", "party", "is_current", "aka_names", "segments", "served_from", "served_to")


def _committees(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder with committee, link and candidate files, and members; candidates are nations, committees suppliers."""
    folder, s, key = scratch.folder(spark, "fec"), table(spark, d, "supplier"), F.col("s_suppkey")
    pipe = lambda *c: F.concat_ws("|", *c)
    text = lambda c: c.cast("string")
    x, none = F.lit("x"), F.lit("")
    kind = F.element_at(F.array(*[F.lit(t) for t in "PDJU"]), (key % 4 + 1).cast("int"))
    name = F.when(key % 4 == 2, F.concat(F.lit("LAST"), text(key % 30), F.lit(" VICTORY É"))).otherwise(F.concat(F.lit("COMMITTEE "), text(key)))
    cand = F.when(key % 8 == 0, F.concat(F.lit("H"), text(key % 25))).otherwise("")
    for cycle in (2022, 2024):
        line = pipe(F.concat(F.lit("C"), text(key)), F.concat(F.lit("OLD "), name) if cycle == 2022 else name, x, x, x, x, x, x, kind, F.lit("O"), F.lit("DEM"), none, none, none, cand if cycle == 2022 else none)
        some = s if cycle == 2022 else s.filter("s_suppkey % 5 <> 0")
        rows = some.select(key.alias("k"), line.alias("value"))
        sinks.save_lines(rows.unionByName(spark.createDataFrame([(-1, "short|row")], "k long, value string")).select("k", F.encode("value", "ISO-8859-1").alias("value")).select("k", F.decode("value", "ISO-8859-1").alias("value")).repartition(1), f"{folder}/cm{cycle}.txt", by=["k"])
    link = s.filter("s_suppkey % 4 <> 1 AND s_suppkey % 7 = 0").select(key.alias("k"), pipe(F.concat(F.lit("S"), text(key % 25)), x, x, F.concat(F.lit("C"), text(key)), x, kind, x).alias("value"))
    sinks.save_lines(link.repartition(1), f"{folder}/ccl.txt", by=["k"])
    cn = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), pipe(F.concat(F.lit("P"), text(F.col("n_nationkey"))), F.concat(F.lit("LAST"), text(F.col("n_nationkey")), F.lit(", BOB")), x, x, F.lit("US"), x).alias("value"))
    sinks.save_lines(cn.repartition(1), f"{folder}/cn.txt", by=["k"])
    sponsor = F.struct(F.concat(F.lit("C"), text(key)).alias("committee_id"), F.array(F.concat(F.when(key % 3 == 0, "S").otherwise("P"), text(key % 25))).alias("sponsor_candidate_ids"))
    pages = s.filter("s_suppkey % 4 = 1").groupBy(F.floor(key / 400).alias("p")).agg(F.to_json(F.struct(F.collect_list(sponsor).alias("results"))).alias("value"))  # 100 a page
    _documents(pages.select(F.format_string("page%d.json", "p").alias("name"), "value"), f"{folder}/pages")
    members_ = table(spark, d, "nation").select(F.format_string("N%d", "n_nationkey").alias("bioguide_id"), F.format_string("Robert Last%d", "n_nationkey").alias("name"), F.lit("Robert").alias("first"), F.format_string("Last%d", "n_nationkey").alias("last"), F.lit(None).cast("string").alias("nickname"), F.lit("AZ").alias("state"), F.format_string("H%d;S%d", "n_nationkey", "n_nationkey").alias("fec_ids"))
    return folder, members_


_CM = """WITH c AS (SELECT s_suppkey AS k, 'C' || s_suppkey AS cmte_id, CASE WHEN s_suppkey % 4 = 2 THEN 'LAST' || s_suppkey % 30 || ' VICTORY É' ELSE 'COMMITTEE ' || s_suppkey END AS name, 'PDJU'[s_suppkey % 4 + 1] AS designation FROM supplier),
    cm AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'OLD ' || name ELSE name END AS cmte_name, CASE WHEN k % 5 = 0 THEN '2022' ELSE '2022;2024' END AS cycles, CASE WHEN k % 8 = 0 THEN 'H' || k % 25 END AS cand_id FROM c)"""


@query(f"{_CM} SELECT cmte_id, cmte_name, designation, cand_id, cycles FROM cm")
def committee_files(spark: SparkSession, d: str) -> DataFrame:
    """Committees of two cycles, the later one's names; a candidate once known stays."""
    folder, _ = _committees(spark, d)
    return _cm(spark, folder).select("cmte_id", "cmte_name", "designation", "cand_id", "cycles")


def _cm(spark: SparkSession, folder: str) -> DataFrame:
    """Test files are written in UTF-8, so names are brought back from what Latin-1 makes of them."""
    cm = reference_data.read_committees(spark, {2022: f"{folder}/cm2022.txt", 2024: f"{folder}/cm2024.txt"})
    return cm.withColumn("cmte_name", F.decode(F.encode("cmte_name", "ISO-8859-1"), "UTF-8"))


@query(f"""{_CM}, l AS (
      SELECT cmte_id, 'N' || k % 25 AS bioguide_id, CASE designation WHEN 'P' THEN 'campaign-committee' WHEN 'D' THEN 'leadership-pac' WHEN 'J' THEN 'jfc' END AS tier, 'S' || k % 25 AS cand_id, 'fec-ccl' AS link_source, 'linked' AS confidence, 0 AS rk FROM cm WHERE k % 4 <> 1 AND k % 7 = 0
      UNION ALL SELECT cmte_id, 'N' || k % 25, CASE designation WHEN 'P' THEN 'campaign-committee' WHEN 'D' THEN 'leadership-pac' WHEN 'J' THEN 'jfc' END, cand_id, 'fec-cm-candid', 'linked', 1 FROM cm WHERE cand_id IS NOT NULL
      UNION ALL SELECT cmte_id, 'N' || k % 25, 'leadership-pac', 'S' || k % 25, 'openfec-sponsor', 'linked', 2 FROM cm WHERE k % 4 = 1 AND k % 3 = 0
      UNION ALL SELECT cmte_id, 'N' || k % 25, 'leadership-pac', 'P' || k % 25, 'cn-name-inference', 'inferred', 3 FROM cm WHERE k % 4 = 1 AND k % 3 <> 0),
    a AS (SELECT * FROM l WHERE tier IS NOT NULL)
    SELECT cmte_id, cmte_name, bioguide_id, tier, a.cand_id, link_source, confidence FROM a JOIN cm USING (cmte_id) QUALIFY row_number() OVER (PARTITION BY cmte_id, bioguide_id ORDER BY rk) = 1""")
def committee_links(spark: SparkSession, d: str) -> DataFrame:
    """Committees to members by candidate ids, sponsors' ids and sponsors' names. Names of joint committees have no member's whole word here; tests hold that source."""
    folder, people = _committees(spark, d)
    cm = _cm(spark, folder)
    nick = spark.createDataFrame([("BOB", "ROBERT")], "a string, b string")
    return members.committee_crosswalk(people, cm, reference_data.read_candidate_links(spark, f"{folder}/ccl.txt"), reference_data.read_sponsors(spark, f"{folder}/pages"), reference_data.read_candidates(spark, f"{folder}/cn.txt"), nick)


@query("SELECT event_id::VARCHAR AS row_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE upper(event_type) END AS theme FROM events")
def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafted labels, one object a line, a mistyped key read too."""
    path, e = scratch.folder(spark, "drafts"), table(spark, d, "events")
    own = F.col("event_id") % 3 == 0
    _json(e, F.col("event_id").alias("row_id"), F.when(own, F.col("event_type")).alias("candidate_theme"), F.when(~own, F.upper("event_type")).alias("candidate_team")).write.text(path)
    return reference_data.read_drafts(spark, path)


@query("SELECT k, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT n_regionkey AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation) GROUP BY 1")
def appended(spark: SparkSession, d: str) -> DataFrame:
    """K1: a table written, then replaced, then appended to."""
    folder, n = scratch.folder(spark, "appended"), table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("v"))
    for append in (False, False, True):
        sinks.save({"t": n}, folder, {"t": "k"}, append=append)
    return spark.read.parquet(f"{folder}/t").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT NULL, 'SELECT 1', NULL")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file for spreadsheets and the query beside it, read back."""
    path = f"{scratch.folder(spark, 'csv')}/customers.csv"
    sinks.save_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, query="SELECT 1", by=["c_custkey"])
    back = spark.read.option("header", True).csv(path)
    log = spark.read.text(f"{path}.sql").select(F.lit(None).cast("string").alias("c_custkey"), F.col("value").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return back.toDF("c_custkey", "c_name", "c_mktsegment").unionByName(log)


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, left(o_orderpriority, 6) AS o_orderpriority, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '·') AS status FROM orders")
def printed(spark: SparkSession, d: str) -> DataFrame:
    """K5: fields cut to a width, a dot for null."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return sinks.as_text(o.withColumn("o_orderkey", F.col("o_orderkey").cast("string")), 48).select("o_orderkey", F.left("o_orderpriority", F.lit(6)).alias("o_orderpriority"), "status")


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """K6: rows as JSON, parsed again."""
    out = sinks.as_json(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return out.select(F.from_json("value", "n_nationkey long, n_name string").alias("r")).select(F.col("r.n_nationkey").alias("k"), F.col("r.n_name").alias("name"))


@query("SELECT * FROM (VALUES ('nation', (SELECT count(*) FROM nation), 25::BIGINT, false), ('region', (SELECT count(*) FROM region), 9::BIGINT, true), ('supplier', (SELECT count(*) FROM supplier), NULL, false)) AS t(\"table\", n, expected, off)")
def sanity_report(spark: SparkSession, d: str) -> DataFrame:
    """K9: rows against a manual's counts."""
    return sinks.sanity({n: table(spark, d, n) for n in ("nation", "region", "supplier")}, {"nation": 25, "region": 9})


@query("SELECT 7 AS src_line, n_name AS line FROM nation WHERE n_nationkey = 6")
def point_read(spark: SparkSession, d: str) -> DataFrame:
    """The line that a citation points to."""
    path = f"{scratch.folder(spark, 'lines')}/names.txt"
    sinks.save_lines(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition(1), path, by=["n_nationkey"])
    return spark.createDataFrame([(7, sinks.raw_record(spark, path, 7))], "src_line int, line string")
