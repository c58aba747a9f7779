"""The registered queries on the smallest tables, and the pipeline against its operators' plain versions."""

import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyspark.llm import queries
from tests.llm.test_operators import UPPER, WORD, filled, plain_groups, plain_shingles

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op7_topk"])
def test_a_row_for_every_document(spark, name):
    ids = {r.doc_id for r in queries.QUERIES[name](spark, DATA).select("doc_id").collect()}
    assert ids == {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}


def test_held_out_quality(spark):
    rows = queries.op5_lm_score(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93


def test_run_against_a_plain_version(spark):
    """run() by plain Python: toxic by the score of op8, the largest id of equal texts, groups by Jaccard, targets, whole documents."""
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    out = corpus_pipeline.run(spark, DATA)
    pieces = out.collect()
    left = [f for f in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before]
    assert len(left) == 1 and os.listdir(f"{spark.conf.get('spark.checkpoint.dir')}/{left[0]}") == ["packing"]  # no other stage's files stay
    everything = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    text = {r.doc_id: r.text or "" for r in everything}
    source = {r.doc_id: r.source for r in everything}
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, DATA).filter("predicted = 1").collect()}
    keep = {}
    for i in sorted(set(text) - toxic):
        keep[text[i].translate(UPPER)] = i
    left = sorted(keep.values())
    groups = plain_groups([plain_shingles(text[i]) for i in left], 0.8)
    left = [i for k, i in enumerate(left) if groups[k] == k]
    sizes, taken = Counter(), Counter()
    for i in left:
        sizes[source[i]] += len(WORD.findall(text[i]))
    rows = defaultdict(list)
    for p in pieces:
        rows[p.row].append(p)
    encode = Tokenizer.from_file(queries.TOKENIZER)
    for some in rows.values():
        some.sort(key=lambda p: p.start)
        (i,) = {p.doc_id for p in some}
        assert [x for p in some for x in p.ids] == [*encode.encode(text[i], add_special_tokens=False).ids, 1]
        taken[source[i]] += len(WORD.findall(text[i]))
    copies = Counter(some[0].doc_id for some in rows.values())
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    for s, target in filled(sizes).items():
        rate = target / sizes[s] if sizes[s] else 1
        assert abs(taken[s] - target) <= max(len(WORD.findall(text[i])) for i in left if source[i] == s)
        assert all(int(rate) <= copies[i] <= int(rate) + 1 for i in left if source[i] == s)
    sequences = Counter()
    for p in pieces:
        sequences[p.sequence_id] += p.length
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in sequences.values())


def test_stages_one_by_one(spark, tmp_path):
    """Stages written and read as the check tool does, over an empty table and one of nulls as well."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (2, "", "en", "x", 0)], docs.schema)
    for k, table in enumerate((docs.limit(0), nulls)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, table, DATA).write.parquet(str(tmp_path / f"{k}{name}"))
            table = spark.read.parquet(str(tmp_path / f"{k}{name}"))
            assert name == "packing" or table.columns == docs.columns
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "1exact_dedup")).collect()] == [2]
