"""The ten operators as queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, lm_scoring, mixing, packing, secret_scan, sharding, simhash, topk
from . import toxicity as toxic

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A score from here on counts as toxic.
TOXIC = 0.3
#: Bytes of text in a shard: small ones, that a reader holds in memory, and that the smallest test table has to split.
SHARD = 256 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), hash_all=True)
    return out.withColumnsRenamed({"id": "doc_id", "full_hash": "text_sha256"})


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), limit_bytes=SHARD).withColumnRenamed("id", "doc_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = packing.pack_documents(docs, TOKENIZER, RANKS, with_ids=False).drop("ids")
    return out.withColumn("id", F.col("id").cast(docs.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = lm_scoring.score_documents(docs)
    return out.withColumn("id", F.col("id").cast(docs.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), digest.alias("kept_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxic.train(toxic.labelled_rows(docs, _table(spark, sf_dir, "labels")))
    out = toxic.toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxic.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score")).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, most=4).withColumnRenamed("id", "doc_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs).withColumn("id", F.col("id").cast(docs.schema["doc_id"].dataType)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_source_mix, op4_packing, op5_lm_score, op6_line_dedup, op7_topk, op8_toxicity, op9_simhash, op10_secrets)
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LOWER})) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM t""",
    "op2_sharding": f"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
        e AS (SELECT row, doc_id, bytes, d.range::INTEGER AS depth, h >> (60 - d.range)::INTEGER AS prefix FROM t, range(61) AS d),
        g AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS n FROM e GROUP BY depth, prefix),
        f AS (SELECT e.*, shard_bytes FROM e JOIN g USING (depth, prefix) WHERE shard_bytes <= {SHARD} OR n = 1)
        SELECT doc_id, bytes, depth || '-' || lower(to_hex(prefix)) AS shard_id, depth AS shard_depth, shard_bytes
        FROM f QUALIFY row_number() OVER (PARTITION BY row ORDER BY depth) = 1""",
    "op3_source_mix": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT source, source_size, source_size * 2 AS cap,
                     CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
              FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate FROM t),
        u AS (SELECT d.*, r.source_size, r.target, floor(r.rate)::BIGINT AS whole, r.rate - floor(r.rate) AS part, k.range AS seed,
                     ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || k.range::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
              FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN range(16) AS k),
        b AS (SELECT source, seed, abs(max(whole * source_size) + sum(CASE WHEN draw < part THEN size ELSE 0 END) - max(target)) AS off FROM u GROUP BY source, seed),
        c AS (SELECT source, seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS rn FROM b) WHERE rn = 1)
        SELECT doc_id, size, source_size, target, (whole + CASE WHEN draw < part THEN 1 ELSE 0 END) * size AS taken,
               whole + CASE WHEN draw < part THEN 1 ELSE 0 END AS copies
        FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND u.seed = c.seed""",
    "op6_line_dedup": rf"""
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM s),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key FROM l),
        g AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT k.doc_id, count(*) AS n_lines, count(g.key) AS n_dropped,
               sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN g USING (key) GROUP BY k.doc_id""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
