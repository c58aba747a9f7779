"""Runs queries by name, one failing without the others."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import QUERIES


def run(spark: SparkSession, sf_dir: str, prefix: str = "", most: int = 20) -> Iterator[tuple[str, list[tuple] | None, str | None]]:
    """(name, first rows, error) of every registered query whose name begins with ``prefix``."""
    for name in [n for n in QUERIES if n.startswith(prefix)]:
        yield (name, *_tried(lambda name=name: QUERIES[name](spark, sf_dir), most))


def run_blocks(spark: SparkSession, sql: str, prefix: str = "", most: int = 20) -> Iterator[tuple[str, list[tuple] | None, str | None]]:
    """(label, first rows, error) of the blocks of a SQL text, each begun by a line '-- ==== label ===='."""
    parts = re.split(r"(?m)^-- ==== (.+?) ====\s*$", sql)[1:]
    for label, body in zip(parts[::2], parts[1::2], strict=True):
        if label.strip().startswith(prefix):
            yield (label.strip(), *_tried(lambda body=body: spark.sql(body.strip().rstrip(";")), most))


def _tried(made, most: int) -> tuple[list[tuple] | None, str | None]:
    try:
        df: DataFrame = made()
        return [tuple(r) for r in df.limit(most).collect()], None
    except Exception as e:  # noqa: BLE001 a block's failure is its result
        return None, f"{type(e).__name__}: {e}".splitlines()[0]
