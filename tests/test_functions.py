"""What engines do differently, and the text and name keys."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import core, names, text
from tallyspark.operators import entities, spend, turnover


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "key"), [("Foo, Inc.", "FOO"), ("US INC", None), ("A Co LLC", "A"), ("FOO L.L.C.", "FOO L L C"), ("Acme (fka Old) Corp", "ACME"), ("  ", None), ("The Co Company", "THE")])
def test_name_key(spark, raw, key):
    assert one(spark, names.name_key(F.col("a")), a=raw) == key


def test_filler_key_is_another_key(spark):
    assert one(spark, names.filler_key(F.col("a")), a="The L.L.C. of Foo-Bar, Inc.") == "OF FOOBAR"


@pytest.mark.parametrize(("raw", "value"), [("1,234.50", 1234.5), ("n/a", None), ("", None)])
def test_number(spark, raw, value):
    assert one(spark, core.number(F.col("a")), a=raw) == value


def test_half_even(spark):
    assert [one(spark, core.half_even(F.col("a")), a=x) for x in (3.7, 2.5, 3.5, -2.5)] == [4, 2, 4, -2]


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 9.0)], "x double, y double")
    assert df.agg(core.correlation(F.col("x"), F.col("y")).alias("r")).first().r is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], "x double, y double")
    assert df.agg(core.correlation(F.col("x"), F.col("y")).alias("r")).first().r == pytest.approx(1.0)


def test_tuples_with_null_count(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2), (2, None)], "a int, b int")
    assert df.agg(core.distinct_pairs(F.col("a"), F.col("b")).alias("n")).first().n == 3


def test_bills(spark):
    found = one(spark, text.bills(F.col("a")), a="H.R. 1234, s 45; H. Con. Res. 7 and S.J.RES.3, hr1234. His 5. H. R. 9")
    assert found == ["HR1234", "S45", "HCONRES7", "SJRES3", "HR1234", "HR9"]
    assert one(spark, text.bills(F.col("a")), a=None) == []


def test_phrases_longest_first(spark):
    found = one(spark, text.phrases_in(F.col("a"), ["health care", "health care costs", "crypto"]), a="Health  care\ncosts, health care; écrypto CRYPTO crypto")
    assert found == ["health care costs", "health care", "crypto"]


def test_tokens_and_pairs_match_plain_python(spark):
    raw = "The tax-credit 12.5 of H.R. AND clean energy is a clean-energy bill x 2024"
    plain = [t for t in re.findall(text.TOKEN, raw.lower()) if t not in text.STOPWORDS and not re.fullmatch(r"[0-9.]+", t)]
    assert one(spark, text.tokens(F.col("a")), a=raw) == plain
    assert one(spark, text.ngrams(text.tokens(F.col("a"))), a=raw) == plain + [f"{a} {b}" for a, b in zip(plain, plain[1:])]
    assert one(spark, text.ngrams(text.tokens(F.col("a"))), a="") == []


FILING = "filing_uuid string, filing_type string, registrant string, client string, filing_year int, filing_period string, income double, expenses double, posted string"


def test_versions_latest_or_earliest(spark):
    rows = [("a", "Q1", "R", "C", 2025, "first_quarter", 5.0, None, "2025-04-01"), ("b", "1A", "R", "C", 2025, "first_quarter", 7.0, None, "2025-05-01"), ("c", "RR", "R", "D", 2025, "first_quarter", None, None, "2025-01-01"), ("d", "1T", "R", "E", 2025, "first_quarter", 9.0, None, "2025-01-01")]
    df = spark.createDataFrame(rows, FILING)
    assert sorted(r.filing_uuid for r in spend.flag_versions(df).collect()) == ["b", "d"]
    assert sorted(r.filing_uuid for r in spend.flag_versions(df, keep="earliest").collect()) == ["a", "d"]
    flags = {r.filing_uuid: r.checkme for r in spend.flag_versions(df, clean=False).collect()}
    assert flags == {"a": "CHECK", "b": "CHECK", "c": "CHECK", "d": "CHECK"}


def test_conflicts_dropped(spark):
    df = spark.createDataFrame([("Acme Inc", "ACME"), ("Firm LLC", "Acme, Inc."), ("Firm LLC", "Other"), (None, None)], "registrant string, client string")
    assert sorted((r.registrant or "", r.client or "") for r in spend.drop_conflicts(df).collect()) == [("", ""), ("Acme Inc", "ACME"), ("Firm LLC", "Other")]


def test_three_methods(spark):
    rows = [("c1", 10.0, True, 1), ("c1", 4.0, False, 1), ("c2", 1.0, True, 1), ("c2", 4.0, False, 1), ("c3", 4.0, False, 1), ("c3", 9.0, False, 0)]
    df = spark.createDataFrame([(c, a, s, p, k) for k, (c, a, s, p) in enumerate(rows)], "client string, amount double, self_filed boolean, posted int, id int")
    out = {r.client: r for r in spend.canonical_spend(df, ["client", "self_filed"], ["client"], [F.col("posted").desc(), F.col("id")]).collect()}
    assert [(out[c].canonical, out[c].counted_twice, out[c].method) for c in ("c1", "c2", "c3")] == [(10.0, 4.0, spend.IN_HOUSE), (4.0, 1.0, spend.OVER), (4.0, 0.0, spend.OUTSIDE)]


def test_entity_ids_stay_ambiguous(spark):
    df = spark.createDataFrame([("client", "senate", "Foo Inc", "9"), ("client", "senate", "FOO", "10"), ("client", "senate", "FOO", "10"), ("client", "house", "Bar LLC", None)], "kind string, dataset string, raw_name string, source_id string")
    rows = {r.norm_key: r for r in entities.entities(entities.aliases(df)).collect()}
    assert rows["FOO"].entity_id == "client:10" and rows["FOO"].canonical_name == "FOO" and rows["FOO"].n_ids == 2
    assert rows["BAR"].entity_id == "client:BAR"


def test_swap_needs_another_firm(spark):
    rows = [("a", "x", 5, 1.0, "Q1"), ("a", "x", 6, 1.0, "2T"), ("b", "x", 7, 1.0, "Q1"), ("a", "y", 6, 1.0, "2TY")]
    df = spark.createDataFrame([(*r, str(k)) for k, r in enumerate(rows)], "registrant string, client string, qidx int, amount double, filing_type string, filing_uuid string")
    pairs = turnover.pair_quarters(df, [F.col("filing_uuid")])
    assert [(r.client, r.lost_by, r.won_by) for r in turnover.swaps(pairs, 6).collect()] == [("x", "a", "b")]
    assert {r.qidx: (r.terminations, r.new_engagements) for r in turnover.counts(pairs).collect()} == {5: (0, 1), 6: (2, 1), 7: (0, 1)}
    assert [(r.client, r.trailing) for r in turnover.terminations(pairs, 6).orderBy("client").collect()] == [("x", 2.0), ("y", 1.0)]


def test_keyness_counts_documents(spark):
    rows = [("own", "alpha beta")] * 5 + [("own", "alpha gamma")] * 3 + [("other", "beta gamma delta")] * 4 + [("other", "")] * 6
    df = spark.createDataFrame(rows, "source string, text string")
    out = {r.term: r for r in text.keyness(*text.compared(df, "text", F.col("source") == "own"), ["beta"], least_docs=3).collect()}
    assert set(out) == {"alpha", "gamma", "alpha beta", "alpha gamma"}  # beta is covered, alpha beta isn't
    background = {"beta": 4, "gamma": 4, "delta": 4, "beta gamma": 4, "gamma delta": 4}
    a0, x, y = sum(background.values()) + len(background), 8, 0
    gap = math.log((x + y + 1) / (8 + a0 - x - y - 1)) - math.log((y + y + 1) / (10 + a0 - y - y - 1))
    assert out["alpha"].z == pytest.approx(gap / math.sqrt(1 / (x + y + 1) + 1 / (y + y + 1)))
