"""Senate filings and contribution reports: arrays of nested objects, flattened to child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, number
from ..functions.text import bill_key, cited
from .arrays import read_elements

_PERSON = "id string, first_name string, last_name string"
FILING = f"""filing_uuid string, uuid string, filing_type string, filing_year int, filing_period string, income string, expenses string, dt_posted string, posted string,
    registrant struct<id string, name string, house_registrant_id string>, client struct<id string, client_id string, name string, general_description string, state string>,
    lobbying_activities array<struct<general_issue_code string, description string, lobbyists array<struct<lobbyist struct<{_PERSON}>, {_PERSON}, covered_position string, new boolean, is_new boolean>>, government_entities array<string>>>,
    foreign_entities array<struct<name string, country string>>"""
REPORT = f"""filing_uuid string, uuid string, filing_type string, filing_year int, filing_period string, dt_posted string, posted string, filer_type string,
    registrant struct<id string, name string>, lobbyist struct<{_PERSON}>, pacs array<string>, no_contributions boolean,
    contribution_items array<struct<contribution_type string, type string, contributor_name string, contributor string, payee_name string, payee string, honoree_name string, honoree string, amount string, date string, contribution_date string>>"""


def _elements(spark: SparkSession, paths: str | list[str], schema: str, max_records: int | None) -> DataFrame:
    """The elements of each file's array with src_file and src_index, their place in it; see read_elements."""
    raw = read_elements(spark, paths, schema)
    return raw.orderBy("src_file", "src_index").limit(max_records) if max_records is not None else raw


def _any(*columns: str) -> Column:
    """The first that isn't null or blank, stripped."""
    return F.coalesce(*[blank_to_null(F.col(c)) for c in columns])


def _named(value: Column) -> Column:
    """A name given as a string, or as an object with one."""
    return blank_to_null(F.when(F.startswith(F.trim(value), F.lit("{")), F.get_json_object(value, "$.name")).otherwise(value))


def read_filings(spark: SparkSession, paths: str | list[str], max_records: int | None = None) -> dict[str, DataFrame]:
    """filings, activities, lobbyists, gov_entities, foreign_entities, bill_mentions."""
    raw = _elements(spark, paths, FILING, max_records).withColumn("filing_uuid", _any("filing_uuid", "uuid"))
    filings = raw.select(
        "filing_uuid", "filing_type", "filing_year", "filing_period", number(F.col("income")).alias("income"), number(F.col("expenses")).alias("expenses"), _any("dt_posted", "posted").alias("posted"),
        _any("registrant.id").alias("registrant_id"), _any("registrant.name").alias("registrant_name"), _any("registrant.house_registrant_id").alias("house_registrant_id"), _any("client.id", "client.client_id").alias("client_id"), _any("client.name").alias("client_name"),
        _any("client.general_description").alias("client_description"), _any("client.state").alias("client_state"), "src_file", "src_index",
    )
    acts = raw.select("filing_uuid", F.posexplode("lobbying_activities").alias("activity_index", "a"), "src_file", "src_index")
    people = acts.select("filing_uuid", "activity_index", F.explode("a.lobbyists").alias("p"))
    activities = acts.select("filing_uuid", "activity_index", F.col("a.general_issue_code").alias("general_issue_code"), blank_to_null(F.col("a.description")).alias("description"), "src_file", "src_index")
    found = activities.select("filing_uuid", "activity_index", F.posexplode(cited(F.col("description"))).alias("mention_index", "raw"))
    agencies = acts.select("filing_uuid", "activity_index", F.explode("a.government_entities").alias("g")).select("filing_uuid", "activity_index", _named(F.col("g")).alias("gov_name"))
    return {
        "filings": filings,
        "activities": activities,
        "lobbyists": people.select("filing_uuid", "activity_index", _any("p.lobbyist.first_name", "p.first_name").alias("first_name"), _any("p.lobbyist.last_name", "p.last_name").alias("last_name"), _any("p.covered_position").alias("covered_position"), F.coalesce("p.new", "p.is_new", F.lit(False)).alias("is_new")),
        "gov_entities": agencies,
        "foreign_entities": raw.select("filing_uuid", F.explode("foreign_entities").alias("f")).select("filing_uuid", _any("f.name").alias("name"), _any("f.country").alias("country")),
        "bill_mentions": found.withColumn("bill", bill_key(F.col("raw"))),
    }


def read_contributions(spark: SparkSession, paths: str | list[str], max_records: int | None = None) -> dict[str, DataFrame]:
    """reports and items; pacs, given as names or objects, joined by '; ', a lobbyist named 'first last'."""
    raw = _elements(spark, paths, REPORT, max_records).withColumn("filing_uuid", _any("filing_uuid", "uuid"))
    reports = raw.select(
        "filing_uuid", "filing_type", "filing_year", "filing_period", _any("dt_posted", "posted").alias("posted"), "filer_type", _any("registrant.name").alias("registrant_name"),
        blank_to_null(F.concat_ws(" ", "lobbyist.first_name", "lobbyist.last_name")).alias("lobbyist_name"), F.nullif(F.array_join(F.transform("pacs", _named), "; "), F.lit("")).alias("pacs"), "no_contributions", "src_file", "src_index",
    )
    items = raw.select("filing_uuid", F.posexplode("contribution_items").alias("item_index", "i"))
    items = items.select(
        "filing_uuid", "item_index", _any("i.contribution_type", "i.type").alias("contribution_type"), _any("i.contributor_name", "i.contributor").alias("contributor_name"), _any("i.payee_name", "i.payee").alias("payee_name"),
        _any("i.honoree_name", "i.honoree").alias("honoree_name"), number(F.col("i.amount")).alias("amount"), _any("i.date", "i.contribution_date").alias("date"),
    )
    return {"reports": reports, "items": items}


def recipient() -> Column:
    """Whom an item went to: the honoree, else the payee, in capitals without trailing blanks, commas and stops."""
    return F.expr("trim(TRAILING ' ,.' FROM upper(trim(coalesce(nullif(honoree_name, ''), payee_name, ''))))")


def wide_filings(tables: dict[str, DataFrame]) -> DataFrame:
    """Filings with all their activities in one row: codes, issue_text, registrant, client, posted, income, expenses."""
    per = tables["activities"].groupBy("filing_uuid").agg(F.array_sort(F.collect_set("general_issue_code")).alias("codes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("activity_index", "description"))), lambda x: x["description"]), " | ").alias("issue_text"))
    out = tables["filings"].join(per, "filing_uuid", "left").withColumnsRenamed({"registrant_name": "registrant", "client_name": "client"})
    return out.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
