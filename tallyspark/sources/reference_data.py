"""Rosters, legislators and committee files that resolution reads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import save_lines

_TERM = "struct<type string, start string, end string, state string, party string, party_affiliations array<struct<start string, end string, party string>>>"
LEGISLATOR = f"id struct<bioguide string, fec array<string>>, name struct<first string, last string, middle string, suffix string, nickname string, official_full string>, other_names array<struct<first string, middle string, last string>>, terms array<{_TERM}>"


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a list, without blank lines and those that begin with #, each once."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> '' AND name NOT LIKE '#%'").distinct()


def write_roster(df: DataFrame, column: str, path: str) -> None:
    """The distinct names of a column, one per line, in order."""
    save_lines(df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct(), path, by=["value"])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """keyword, tag of a lexicon's facets; keywords in lower case with single blanks. A keyword may have several tags."""
    raw = spark.read.schema("facets array<struct<id string, tag string, phrases array<string>>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("facets").alias("f")).select("f.tag", F.explode("f.phrases").alias("p"))
    return rows.select(F.regexp_replace(F.lower(F.trim("p")), r"\s+", " ").alias("keyword"), "tag").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """id, name, bill, phrase of named bills: a row for each of an alias's names, numbers and phrases."""
    raw = spark.read.schema("aliases array<struct<id string, names array<string>, bills array<string>, phrases array<string>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("aliases").alias("a")).select("a.id", F.col("a.names").alias("names"), F.coalesce("a.bills", F.array().cast("array<string>")).alias("bills"), F.coalesce("a.phrases", F.array().cast("array<string>")).alias("phrases"))


def read_legislators(spark: SparkSession, current: list[str], historical: list[str] | None = None, since_end: str = "") -> tuple[DataFrame, DataFrame]:
    """(members, terms) of JSON arrays of legislators: all current ones, and former ones whose last term ends on or after since_end.

    Terms are split where a member changed party; a member's party is that of the segment that ends last.
    """

    def read(paths: list[str], is_current: bool) -> DataFrame:
        raw = spark.read.schema(LEGISLATOR).option("multiLine", True).json(paths).withColumn("is_current", F.lit(is_current)).filter(F.size("terms") > 0)
        return raw if is_current else raw.filter(F.array_max(F.transform("terms", lambda t: t["end"])) >= since_end)

    raw = reduce(DataFrame.unionByName, [read(p, c) for p, c in ((current, True), (historical or [], False)) if p])
    ends, starts = F.transform("terms", lambda t: t["end"]), F.transform("terms", lambda t: t["start"])
    raw = raw.select(F.col("id.bioguide").alias("bioguide_id"), F.col("id.fec").alias("fec_ids"), "name", "other_names", "terms", "is_current", F.to_date(F.array_min(starts)).alias("served_from"), F.to_date(F.array_max(ends)).alias("served_to"))
    term = raw.select("bioguide_id", F.explode("terms").alias("t"))
    whole = F.array(F.struct(F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.party").alias("party")))
    parts = F.when(F.size("t.party_affiliations") > 0, F.col("t.party_affiliations")).otherwise(whole)
    terms = term.select("bioguide_id", F.when(F.col("t.type") == "sen", "Senate").otherwise("House").alias("chamber"), F.col("t.state").alias("state"), F.explode(parts).alias("s"))
    terms = terms.select("bioguide_id", "chamber", "state", F.left("s.party", F.lit(1)).alias("party"), F.to_date("s.start").alias("from_date"), F.to_date("s.end").alias("to_date"))
    last = terms.groupBy("bioguide_id").agg(F.max_by(F.struct("chamber", "state", "party"), F.struct("to_date", "from_date")).alias("l"))
    others = F.flatten(F.transform(F.coalesce("other_names", F.array().cast("array<struct<first:string,middle:string,last:string>>")), lambda o: F.array(o["first"], o["middle"], o["last"])))
    aka = F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(others, lambda x: F.coalesce(x, F.lit("")) != ""))), "|"), F.lit(""))
    members = raw.select(
        "bioguide_id", F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last")).alias("name"), F.col("name.first").alias("first"), F.col("name.middle").alias("middle"), F.col("name.last").alias("last"),
        F.col("name.suffix").alias("suffix"), F.col("name.nickname").alias("nickname"), aka.alias("aka_names"), F.array_join("fec_ids", ";").alias("fec_ids"), "is_current", "served_from", "served_to",
    )
    return members.join(last, "bioguide_id").select(*members.columns, "l.chamber", "l.state", "l.party"), terms


def _pipes(spark: SparkSession, path: str, names: dict[str, int], least: int) -> DataFrame:
    """Fields of headerless, pipe-delimited Latin-1 lines that have so many; a line is one field of a separator that never occurs, as only this reader decodes."""
    parts = spark.read.schema("value string").option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").csv(path).select(F.split("value", r"\|").alias("p")).filter(F.size("p") >= least)
    return parts.select(*[F.nullif(F.trim(F.col("p")[k]), F.lit("")).alias(n) for n, k in names.items()])


def read_candidate_links(spark: SparkSession, path: str) -> DataFrame:
    """cand_id, cmte_id, designation of a cycle's links."""
    return _pipes(spark, path, {"cand_id": 0, "cmte_id": 3, "designation": 5}, 7).filter("cand_id IS NOT NULL AND cmte_id IS NOT NULL")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """cand_id, name, state of a cycle's candidates."""
    return _pipes(spark, path, {"cand_id": 0, "name": 1, "state": 4}, 5).filter("cand_id IS NOT NULL").na.fill("", ["state"])


def read_committees(spark: SparkSession, cycles: dict[int, str], least_fields: int = 15) -> DataFrame:
    """One row per committee of headerless, pipe-delimited Latin-1 files by cycle; the later cycle's name, designation and type hold."""

    names = {"cmte_id": 0, "cmte_name": 1, "designation": 8, "cmte_type": 9, "party": 10, "cand_id": 14}
    rows = reduce(DataFrame.unionByName, [_pipes(spark, p, names, least_fields).withColumn("cycle", F.lit(c)) for c, p in sorted(cycles.items())])
    latest = F.max_by(F.struct("cmte_name", "designation", "cmte_type", "party"), "cycle").alias("l")
    known = F.max_by("cand_id", F.when(F.col("cand_id").isNotNull(), F.col("cycle"))).alias("cand_id")  # a later cycle without a candidate doesn't undo an earlier one's
    return rows.groupBy("cmte_id").agg(latest, known, F.array_join(F.array_sort(F.collect_set("cycle")).cast("array<string>"), ";").alias("cycles")).select("cmte_id", "l.*", "cand_id", "cycles")


_RECEIPT = "committee_id string, transaction_id string, sub_id string, memo_code string, line_number string, entity_type string, contributor_name string, contributor_employer string, contribution_receipt_amount double, contribution_receipt_date string"


def read_receipts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Receipts of cached response pages, one object with results a file; a receipt that two pages show comes once, by its sub_id."""
    raw = spark.read.schema(f"results array<struct<{_RECEIPT}>>").option("multiLine", True).json(paths)
    rows = raw.select(F.explode("results").alias("r")).select("r.*")
    return rows.filter("sub_id IS NOT NULL").dropDuplicates(["sub_id"]).unionByName(rows.filter("sub_id IS NULL"))


def read_sponsors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """cmte_id, cand_id: the sponsors of leadership committees on cached response pages."""
    raw = spark.read.schema("results array<struct<committee_id string, name string, sponsor_candidate_ids array<string>>>").option("multiLine", True).json(paths)
    return raw.select(F.explode("results").alias("r")).select(F.col("r.committee_id").alias("cmte_id"), F.explode("r.sponsor_candidate_ids").alias("cand_id")).distinct()


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    """row_id, theme of drafted labels, one JSON object per line; a mistyped key is read too."""
    raw = spark.read.schema("row_id string, candidate_theme string, candidate_team string").json(path)
    return raw.select("row_id", F.coalesce("candidate_theme", "candidate_team").alias("theme"))


def sample_scope(quarter: str, most: int = 5000) -> dict:
    """What a trial load of a quarter such as 2026-Q1 reads: the year, three months of releases, the folders' periods, so many records a kind."""
    m = re.fullmatch(r"(\d{4})-Q([1-4])", quarter)
    if not m:
        raise ValueError(f"{quarter}: not a quarter such as 2025-Q1")
    year, q = int(m[1]), int(m[2])
    return {"years": [year], "months": [f"{year}-{k:02}" for k in range(3 * q - 2, 3 * q + 1)], "periods": ["RR", f"Q{q}"], "max_records": most}
