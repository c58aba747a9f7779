"""An addition to the batch operators: versions of filings that arrive over time, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.core import latest_by


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Keep the latest version (posted, filing_uuid) of each filing under target, a folder per batch.

    A batch is merged with the state before it and written under its own number, so a batch that runs
    again overwrites itself; current() reads the last.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/batch={number - 1}"))
        latest_by(rows, keys, [F.col("posted").desc_nulls_last(), F.col("filing_uuid").desc()]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, target: str) -> DataFrame:  # noqa: ANN001
    """The state after the last batch."""
    rows = spark.read.parquet(target)
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")


def daily_counts(stream: DataFrame, time: str, by: str, late: str = "2 days") -> DataFrame:
    """Rows and value sums per day of event time; rows later than ``late`` are left out once their day is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
