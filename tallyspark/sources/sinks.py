"""Writers and the checks that go with them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str, partition: dict[str, str] | None = None, append: bool = False) -> None:
    """Each table as Parquet under its name; a rerun replaces it unless rows are appended."""
    for name, df in tables.items():
        writer = df.write.mode("append" if append else "overwrite")
        (writer.partitionBy(partition[name]) if partition and name in partition else writer).parquet(f"{folder}/{name}")


def _one_file(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder as one file at path, which is replaced; several are copied one after the other, as streams."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = where(folder), where(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    files.delete(target, True)
    files.mkdirs(target.getParent())
    if len(parts) == 1:
        if not files.rename(parts[0], target):
            raise OSError(f"{path} can't be written")
    else:
        out = files.create(target)
        try:
            for part in parts:
                stream = files.open(part)
                try:
                    spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        finally:
            out.close()
    files.delete(source, True)


def save_lines(df: DataFrame, path: str, column: str | Column = "value", by: list[str] | None = None) -> None:
    """One text file of a column's values, in the order of ``by``: sorted and written by ranges, which are then joined."""
    folder = f"{path}.{uuid.uuid4().hex}"
    (df.orderBy(*by) if by else df).select((F.col(column) if isinstance(column, str) else column).alias("value")).write.text(folder)
    _one_file(df.sparkSession, folder, path)


def save_files(df: DataFrame, paths: list[str], index: Column, value: Column, by: list[str]) -> None:
    """Text files, each of the values of the rows whose index is its place in paths, in the order of ``by``; all are sorted at once."""
    folder, spark = f"{paths[0]}.{uuid.uuid4().hex}", df.sparkSession
    rows = df.withColumn("__file", index.cast("int")).filter(F.col("__file").between(0, len(paths) - 1))
    rows.orderBy("__file", *by).select("__file", value.alias("value")).write.partitionBy("__file").text(folder)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = where(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, path in enumerate(paths):
        files.mkdirs(where(f"{folder}/__file={k}"))  # no rows, an empty file
        _one_file(spark, f"{folder}/__file={k}", path)
    files.delete(where(folder), True)


def save_csv(df: DataFrame, path: str, bom: bool = True, query: str | None = None, by: list[str] | None = None) -> None:
    """One CSV file with a header, its first field marked as UTF-8 for spreadsheets; the query that made it goes to path.sql."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    one = df.coalesce(1)
    named = (one.sortWithinPartitions(*by) if by else one).select(*[c.alias(("\ufeff" if bom and k == 0 else "") + n) for k, (c, n) in enumerate(zip(columns, df.columns, strict=True))])
    folder = f"{path}.{uuid.uuid4().hex}"
    named.write.option("header", True).option("encoding", "UTF-8").csv(folder)
    _one_file(df.sparkSession, folder, path)
    if query is not None:
        save_lines(df.sparkSession.createDataFrame([(query,)], "value string"), f"{path}.sql")


def save_vectors(df: DataFrame, path: str, column: str, dim: int) -> None:
    """Parquet of rows whose vectors have ``dim`` numbers each; any other vector fails the write."""
    bad = F.raise_error(F.concat(F.lit(f"a vector of another length than {dim}: "), F.size(column).cast("string")))
    df.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dim), F.col(column)).otherwise(bad)).write.mode("overwrite").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_text(df: DataFrame, width: int = 48) -> DataFrame:
    """df as strings to print: at most ``width`` characters a field, a dot for null."""
    text = lambda c: F.coalesce(F.left(F.col(f"`{c}`").cast("string"), F.lit(width)), F.lit("·"))
    return df.select(*[text(c).alias(c) for c in df.columns])


def sanity(tables: dict[str, DataFrame], expected: dict[str, int], tolerance: float = 0.1) -> DataFrame:
    """table, n, expected, off: rows against a manual's counts, off where they differ by the tolerance or more."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n", F.lit(expected.get(name)).cast("long").alias("expected")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("off", F.coalesce(F.abs(F.col("n") - F.col("expected")) >= tolerance * F.col("expected"), F.lit(False)))


def raw_record(spark: SparkSession, path: str, src_line: int) -> str | None:
    """The line of a file that a row points to; no line after it is read."""
    rows = spark.read.text(path).limit(src_line)
    last = rows.tail(1)
    return last[0].value if last and rows.count() == src_line else None
