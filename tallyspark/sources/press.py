"""Press releases: one JSON object per line, in files named by month."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bill_key, cited

SCHEMA = "url string, title string, date string, date_source string, source string, domain string, scraper string, member struct<bioguide_id string, name string, party string, state string, chamber string>, text string"
#: Month to the period names of filings.
PERIODS = ("first_quarter", "second_quarter", "third_quarter", "fourth_quarter")


def period_of(month: Column) -> Column:
    """Null for a null month; element_at() would give the last period."""
    out = F.when(month.between(1, 3), PERIODS[0])
    for k in range(1, 4):
        out = out.when(month.between(3 * k + 1, 3 * k + 3), PERIODS[k])
    return out


def wanted(paths: list[str], years: list[int] | None = None, months: list[str] | None = None) -> list[str]:
    """The files whose names (YYYY-MM.jsonl) lie in years and months; files named otherwise are kept."""
    named = {p: re.search(r"(\d{4})-(\d{2})\.jsonl$", p) for p in paths}
    return [p for p, m in named.items() if m is None or ((not years or int(m[1]) in years) and (not months or f"{m[1]}-{m[2]}" in months))]


def read_press(spark: SparkSession, paths: list[str], years: list[int] | None = None, months: list[str] | None = None, max_records: int | None = None) -> DataFrame:
    """Typed rows with src_file and src_line; blank lines count as lines but give no row, bad lines keep their raw text.

    Files outside years or months aren't read. pr_id numbers rows by file and line. Files are read in splits:
    a line's number is its place in its split, plus the lines of the file's splits before it, which a first
    pass counts; so no task has a whole file.
    """
    keep = wanted(paths, years, months)
    if not keep:
        return spark.createDataFrame([], f"src_file string, src_line int, {SCHEMA}, bad_line string, quarter string, pr_id long")
    split = ["path", "start", "length", "task"]
    lines = spark.read.option("lineSep", "\n").text(keep)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("src_file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    filled = F.trim("line") != ""
    splits = lines.groupBy("src_file", *split).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("filled"))  # one row a split; so windows over them are small
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(
        *split, (F.col("first") - before("n", Window.partitionBy("path").orderBy("start"))).alias("line_0"),
        (F.shiftleft(F.col("task").cast("long"), 33) + before("filled", Window.partitionBy("task").orderBy("first")) - before("filled", Window.orderBy("src_file", "path", "start"))).alias("row_0"),
    )
    rows = lines.filter(filled).withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(splits), split, "left")
    known = lambda c: F.coalesce(c, F.raise_error(F.lit("the splits of a file have changed between its two passes")).cast("long"))
    rows = rows.select("src_file", (F.col("at") - known(F.col("line_0")) + 1).cast("int").alias("src_line"), (F.col("row") - known(F.col("row_0")) + 1).alias("pr_id"), F.from_json("line", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if max_records is not None:
        rows = rows.filter(F.col("pr_id") <= max_records)
    month = F.substr(F.col("date"), F.lit(6), F.lit(2)).try_cast("int")
    return rows.select("src_file", "src_line", "r.*", "pr_id").withColumnRenamed("_bad", "bad_line").withColumn("quarter", period_of(month))


def press_key() -> Column:
    """The citation of a release."""
    return F.concat_ws(":", "src_file", F.col("src_line").cast("string"))


def press_mentions(press: DataFrame) -> DataFrame:
    """record_key, bill, raw: every citation in a release's text."""
    return press.select(press_key().alias("record_key"), F.explode(cited(F.col("text"))).alias("raw")).select("record_key", bill_key(F.col("raw")).alias("bill"), "raw")
