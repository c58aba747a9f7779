"""The disclosure model laid over the star schema: a line item is a filing, its supplier the registrant, its customer the client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import quarter_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table that Spark reads in fewer tasks than there are cores is dealt to all of them.
DEALT = 256 << 20


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents; a small file that Spark can't split is dealt to all cores, as tokens cost far more than that shuffle."""
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= DEALT and df.rdd.getNumPartitions() < cores else df


def filings(spark: SparkSession, sf_dir: str, clients: DataFrame | None = None) -> DataFrame:
    """One row per line item with its order's client and quarter. Only the columns a query uses are read.

    clients: client and more columns, to be joined to the orders, which are fewer than the line items.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    o = o.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("client"), F.year(day).alias("yr"), F.quarter(day).alias("q"), quarter_index(F.year(day), F.quarter(day)).alias("qidx"), F.col("o_orderpriority").alias("issue"))
    o = o if clients is None else o.join(clients, "client")
    li = li.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("registrant"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("amount"), F.col("l_shipdate").alias("posted"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    return li.join(o, "ok").withColumns({"filing_type": _type(), "uuid": F.concat_ws("-", "ok", "ln", "pk", "registrant")})


def _type() -> Column:
    """A line item's type of filing: returned ones terminate, some register, some amend, the others report a quarter."""
    q = F.col("q").cast("string")
    ends = F.concat(q, F.when(F.col("ln") % 2 == 0, "TY").otherwise("T"))
    return F.when(F.col("flag") == "R", ends).when(F.col("ln") == 5, "RR").when((F.col("flag") == "A") & (F.col("ln") == 4), F.concat(q, F.lit("A"))).otherwise(F.concat(F.lit("Q"), q))


#: The same in SQL, to stand before a query's own CTEs.
FILINGS = """WITH filings AS (
    SELECT l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS registrant, (l_extendedprice::DECIMAL(12, 2) * (1 - l_discount::DECIMAL(4, 2)))::DECIMAL(18, 4) AS amount,
           l_shipdate AS posted, l_returnflag AS flag, l_linestatus AS status, o_custkey AS client, year(o_orderdate)::INTEGER AS yr,
           quarter(o_orderdate)::INTEGER AS q, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1)::INTEGER AS qidx, o_orderpriority AS issue,
           CASE WHEN l_returnflag = 'R' THEN quarter(o_orderdate) || CASE WHEN l_linenumber % 2 = 0 THEN 'TY' ELSE 'T' END WHEN l_linenumber = 5 THEN 'RR'
                WHEN l_returnflag = 'A' AND l_linenumber = 4 THEN quarter(o_orderdate) || 'A' ELSE 'Q' || quarter(o_orderdate) END AS filing_type,
           l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS uuid
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""



def money(amount: str | Column) -> Column:
    """Amounts are summed as decimals, exactly, and reported as doubles of whole cents."""
    return F.round(amount, 2).cast("double")


def latest_order() -> list:
    return [F.col(c).desc() for c in ("posted", "ok", "ln", "pk")]


LATEST_SQL = "ORDER BY posted DESC, ok DESC, ln DESC, pk DESC"
