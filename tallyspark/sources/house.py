"""House filings: one XML document per file, in folders named by year and period."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import blank_to_null, number

_LOBBYIST = "struct<lobbyistFirstName string, lobbyistLastName string, coveredPosition string, lobbyistNew string>"
_SCHEMA = f"""organizationName string, clientName string, senateID string, houseID string, reportYear string, reportType string, income string, expenses string, ali_Code string,
    specific_issues struct<description string>, lobbyists struct<lobbyist array<{_LOBBYIST}>>,
    alis struct<ali_Code array<string>, ali_info array<struct<issueAreaCode string, specific_issues struct<description string>, federal_agencies string, lobbyists struct<lobbyist array<{_LOBBYIST}>>>>>, _corrupt_record string"""
# The folder names' period words and the period they stand for.
FOLDERS = {"Registrations": "RR", "1stQuarter": "first_quarter", "2ndQuarter": "second_quarter", "3rdQuarter": "third_quarter", "4thQuarter": "fourth_quarter", "MidYear": "mid_year", "YearEnd": "year_end"}


def folder_period(path: str) -> tuple[int, str] | None:
    """(year, period) of a folder such as 2026_1stQuarter_XML, or None."""
    m = re.search(r"(?:^|/)(\d{4})_([A-Za-z0-9]+)_XML/?$", path)
    return (int(m[1]), FOLDERS[m[2]]) if m and m[2] in FOLDERS else None


def read_house(spark: SparkSession, folder: str, root: str = "LOBBYINGDISCLOSURE2", max_records: int | None = None) -> dict[str, DataFrame]:
    """filings, alis, lobbyists and errors (documents that don't parse) of one folder; of its first documents by name, if limited.

    A document with ali_info blocks gives one ali per block with its lobbyists; one without gives one
    from its flat fields, whose lobbyists have no ali_index. Empty lobbyist slots are left out.
    """
    at = folder_period(folder.rstrip("/"))
    year, period = at if at else (None, None)
    raw = spark.read.format("xml").option("rowTag", root).option("mode", "PERMISSIVE").schema(_SCHEMA).load(folder)
    raw = raw.withColumn("filing_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1))
    if max_records is not None:
        raw = raw.orderBy("filing_id").limit(max_records)
    good, bad = raw.filter("_corrupt_record IS NULL"), raw.filter("_corrupt_record IS NOT NULL").select("filing_id", "_corrupt_record")
    clean = lambda c: blank_to_null(F.col(c))
    filings = good.select(
        "filing_id", F.lit(year).cast("int").alias("filing_year"), F.lit(period).alias("filing_period"), F.lit("LD1" if root.endswith("1") else "LD2").alias("form"),
        clean("organizationName").alias("registrant_name"), clean("clientName").alias("client_name"), clean("senateID").alias("senate_id"), clean("houseID").alias("house_id"),
        number(clean("income")).alias("income"), number(clean("expenses")).alias("expenses"),
    )
    blocks = good.select("filing_id", F.posexplode("alis.ali_info").alias("ali_index", "b"))
    flat = good.filter(F.coalesce(F.size("alis.ali_info"), F.lit(-1)) <= 0)
    alis = blocks.select("filing_id", "ali_index", blank_to_null(F.col("b.issueAreaCode")).alias("code"), blank_to_null(F.col("b.specific_issues.description")).alias("description"), blank_to_null(F.col("b.federal_agencies")).alias("agencies"))
    own = flat.select("filing_id", F.lit(None).cast("int").alias("ali_index"), clean("ali_Code").alias("code"), blank_to_null(F.col("specific_issues.description")).alias("description"), F.lit(None).cast("string").alias("agencies"))
    people = blocks.select("filing_id", "ali_index", F.explode("b.lobbyists.lobbyist").alias("p")).unionByName(flat.select("filing_id", F.lit(None).cast("int").alias("ali_index"), F.explode("lobbyists.lobbyist").alias("p")))
    people = people.select("filing_id", "ali_index", *[blank_to_null(F.col(f"p.{c}")).alias(n) for c, n in (("lobbyistFirstName", "first_name"), ("lobbyistLastName", "last_name"), ("coveredPosition", "covered_position"), ("lobbyistNew", "lobbyist_new"))])
    return {"filings": filings, "alis": alis.unionByName(own).filter("code IS NOT NULL OR description IS NOT NULL"), "lobbyists": people.filter("first_name IS NOT NULL OR last_name IS NOT NULL"), "errors": bad}
