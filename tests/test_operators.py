"""Operators on small rows."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.core import numbered
from tallyspark.operators import checks, entities, filters, packages, spend, turnover
from tallyspark.operators.intervals import as_of
from tallyspark.plans import runner


def test_as_of(spark):
    points = spark.sql("SELECT * FROM VALUES (1, 'k', DATE'2020-06-01'), (2, 'k', DATE'2019-01-01'), (3, 'k', DATE'2021-02-01'), (4, 'k', CAST(NULL AS DATE)), (5, 'x', DATE'2020-01-01'), (6, NULL, DATE'2020-01-01') AS t(id, key, day)")
    spans = spark.sql("SELECT * FROM VALUES ('k', DATE'2020-01-01', DATE'2020-12-31', 'A'), ('k', DATE'2020-05-01', DATE'2020-07-01', 'B'), ('k', DATE'2021-03-01', DATE'2021-12-31', 'C') AS t(who, a, b, label)").withColumnRenamed("who", "key")
    for bound in (1_000_000, 0):
        out = as_of(points, spans, "key", "day", "a", "b", "label", max_broadcast=bound)
        assert {r.id: (r.label, r.source) for r in out.collect()} == {1: ("A", "dated"), 2: ("A", "nearest"), 3: ("C", "nearest"), 4: ("C", "latest"), 5: (None, None), 6: (None, None)}


def test_numbered(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    rows = sorted((r.h, r.n) for r in numbered(df, "h", "n", digits=1).collect())
    assert [n for _, n in rows] == list(range(1, 501))


def test_filters(spark):
    df = spark.sql("SELECT * FROM VALUES ('Acme', 'Firm', 'tax; oil', 5.0D, 50.0D, '2025-01-05', array('TAX', 'OIL')), ('Beta', NULL, 'tax', 20.0D, NULL, '2025-02-05', array('TAX')), (NULL, 'Firm', NULL, NULL, NULL, NULL, NULL) AS t(client, registrant, issue_text, income, expenses, posted, codes)")
    clients = lambda **k: [r.client for r in filters.select_filings(df, **k).collect()]
    assert clients() == ["Acme", "Beta", None] and clients(client="ACM") == ["Acme"] and clients(registrant="firm") == ["Acme", None]
    assert clients(issues=["tax", "oil"], joiner="and") == ["Acme"] and clients(issues=["tax", "oil"]) == ["Acme", "Beta"]
    assert clients(least=10, most=30) == ["Beta"]  # 5 and 50 don't make a range between them
    assert clients(first_day="2025-02-01", last_day="2025-02-05") == ["Beta"]
    assert filters.with_codes(df, "codes", ["TAX", "OIL"], {"TAX", "OIL"}, "and").count() == 1
    assert filters.with_codes(df, "codes", ["TAX", "OIL"], {"TAX", "OIL"}).count() == 2
    with pytest.raises(ValueError, match="BAD"):
        filters.with_codes(df, "codes", ["BAD"], {"TAX"})


def test_rosters(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    out = entities.resolve_roster(names("acme", "Ac", "Beta", "Zed", "acme"), names("ACME", "Accent", None), names("BETA"))
    assert sorted(tuple(r) for r in out.collect()) == [("Ac", "substring", 2), ("Beta", "client-only", 0), ("Zed", "none", 0), ("acme", "exact", 1)]
    asked = names("ACM", "ACME FUND", "BO", "BET").withColumnRenamed("name", "asked")
    assert sorted(tuple(r) for r in entities.unique_prefix(asked, names("ACME", "BETA", "BETTER", "A"), 3).collect()) == []
    assert sorted(tuple(r) for r in entities.unique_prefix(asked, names("ACME", "BETA", "BETTER", "B"), 3).collect()) == [("ACM", "ACME"), ("ACME FUND", "ACME")]
    held = entities.held_by(names("an", "x", "anana", "").withColumnRenamed("name", "asked"), names("Banana", "ox", "Ann", None)).collect()
    assert sorted(map(tuple, held)) == [("an", "Ann"), ("an", "Banana"), ("anana", "Banana"), ("x", "ox")]


def test_congress(spark):
    assert [r[0] for r in spark.sql("SELECT explode(array(2019, 2020, 2021, 2024)) AS y").select(packages.congress_of_year(F.col("y"))).collect()] == [116, 116, 117, 118]


def test_unknown_filers_count_as_outside(spark):
    rows = spark.createDataFrame([("r", "c", 1, 5.0, None), ("c", "c", 1, 3.0, True), ("s", "c", 1, None, False)], "registrant string, client string, q int, amount double, self_filed boolean")
    out = spend.canonical_spend(rows, ["registrant", "client", "q"], ["client", "q"], [F.col("amount")]).first()
    assert (out.inhouse, out.outside, out.naive, out.canonical) == (3.0, 5.0, 8.0, 5.0)


def test_terminations_and_moves(spark):
    rows = [("A", "C", 10, 5.0, "Q1", "u1"), ("A", "C", 11, 6.0, "2TY", "u2"), ("A", "C", 12, 7.0, "Q3", "u3"), ("C", "C", 11, None, "RR", "u4"), ("B", "C", 12, 9.0, "Q3", "u5"), ("B", "D", 11, 1.0, "2A", "u6")]
    df = spark.createDataFrame(rows, "registrant string, client string, qidx int, amount double, filing_type string, filing_uuid string")
    p = turnover.pair_quarters(df, [F.col("filing_uuid")]).withColumn("own", F.col("client"))
    (end,) = turnover.terminations(p, 11).collect()
    assert (end.registrant, end.cite, end.trailing, end.n_quarters, end.first_q, end.new_this_q, end.re_engaged) == ("A", "u2", 11.0, 3, 10, False, 1)
    assert sorted((r.registrant, r.client, r.registration_only, r.cite) for r in turnover.new_engagements(p, 11).collect()) == [("B", "D", False, "u6"), ("C", "C", True, "u4")]
    assert sorted((r.lost_by, r.won_by, r.hire_dq, r.move) for r in turnover.swaps(p, 11).collect()) == [("A", "B", 1, ""), ("A", "C", 0, "to-inhouse")]
    assert sorted(map(tuple, turnover.churn(p, 11).collect())) == [("A", 1, 11.0, 0, -1), ("B", 0, None, 1, 1), ("C", 0, None, 1, 1)]
    kinds = spark.createDataFrame([(k,) for k in ("1T", "4TY", "2@", "3@Y", "RR", "Q1", "5T", "1TA")], "k string")
    assert [r[0] for r in kinds.select(turnover.is_termination(F.col("k"))).collect()] == [True] * 4 + [False] * 4


def test_swaps_meet_in_blocks(spark, monkeypatch):
    """A client's rows are made by several tasks, each of two blocks; the pairs are read once."""
    monkeypatch.setattr(turnover, "BLOCK", 5, raising=False)
    monkeypatch.setattr(turnover, "CYCLE", 2, raising=False)
    ended, new = [f"e{k:02}" for k in range(17)], [f"n{k:02}" for k in range(13)]
    rows = [(r, "C", q, 1.0, t) for r in ended for q, t in ((4, "Q1"), (6, "2T"))] + [(r, "C", 5 + k % 3, 1.0, "Q1") for k, r in enumerate(new)]
    rows += [("both", "C", 6, 1.0, "2T"), ("late", "C", 8, 1.0, "Q4"), ("e", "lost only", 6, 1.0, "2T"), ("n", "won only", 6, 1.0, "Q1"), ("e", None, 6, 1.0, "2T"), ("n", None, 6, 1.0, "Q1")]
    df = spark.createDataFrame([(*r, f"u{k}") for k, r in enumerate(rows)], "registrant string, client string, qidx int, amount double, filing_type string, filing_uuid string")
    out = turnover.swaps(turnover.pair_quarters(df, [F.col("filing_uuid")]), 6)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    first = {r: 5 + k % 3 for k, r in enumerate(new)} | {"both": 6}
    want = [(a, b, first[b] - 6) for a in [*ended, "both"] for b in [*new, "both"] if a != b]
    assert sorted((r.lost_by, r.won_by, r.hire_dq) for r in got) == sorted(want)
    assert {r.client for r in got} == {"C"} and len({r.task for r in got}) > 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_gates(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    with pytest.raises(ValueError, match="2 rows against 1"):
        checks.same_rows(a, a.limit(1))
    parts = spark.createDataFrame([(1, 1.0), (1, 1.0), (3, 1.0)], "k int, v double")
    assert sorted((r.k, r.change) for r in checks.partitioned(parts, a, ["k"], "v").collect()) == [(2, "lost"), (3, "added")]


def test_runner(spark, tmp_path):
    for k in range(2):
        spark.range(k, 5).write.parquet(str(tmp_path / "nation.parquet" if k == 0 else tmp_path / "region.parquet"))
    got = {n: (rows, error) for n, rows, error in runner.run(spark, str(tmp_path), "sanity")}
    assert got["sanity_report"][0] is None and "supplier" in got["sanity_report"][1]
    blocks = "-- ==== A1: one ====\nSELECT 1 AS x;\n-- ==== A2 ====\nSELECT nothing;\n-- ==== B ====\nSELECT 2"
    out = list(runner.run_blocks(spark, blocks, "A"))
    assert out[0] == ("A1: one", [(1,)], None) and out[1][0] == "A2" and out[1][1] is None and "nothing" in out[1][2]
