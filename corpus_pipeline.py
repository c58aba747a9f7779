"""A training-data pipeline: toxicity, exact dedup, near dedup, mixing, packing, each stage written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import _common, exact_dedup, mixing, packing, queries, simhash
from tallyspark.llm import toxicity as toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below queries.TOXIC by a model learnt from the rows of docs that labels has.

    Null and empty texts score as texts without matches and stay unless such a score is toxic; repeated
    rows score alike. Without labels of toxic rows nothing is rejected. An empty table gives no rows.
    """
    model = toxic.train(toxic.labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxic.toxicity(_common.packed(docs).withColumn("text", _common.field("text")), model)
    return scored.filter(F.col("toxicity") < queries.TOXIC).select("r.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document of the largest id; null counts as empty. See exact_dedup."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The smallest id stays, null after all others; texts without words are one group, repeated rows one
    row; an empty table gives no rows. See simhash.drop_near_duplicates.
    """
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the weights of their sources ask for; null sources are one source, null texts have no words. See mixing."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids; row tells the copies of a document apart. See packing.pack_documents.

    Null and empty texts are one end token; null ids stay null; an empty table gives no rows.
    """
    out = packing.pack_documents(docs, queries.TOKENIZER, queries.RANKS)
    return out.withColumn("id", out["id"].cast(docs.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't say the SimHash, toxicity and packing stages; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written as Parquet in the shared folder and read by the next.

    What a stage keeps in the shared folder goes when its rows are written, and those go when the next
    stage's are; the last rows stay until the driver ends.
    """
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{_common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    _common.at_exit(spark, folder)
    for name, stage in STAGES:
        with _common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _common.delete(spark, f"{folder}/{before}")
        before = name
    return docs
