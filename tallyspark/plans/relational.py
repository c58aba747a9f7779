"""Joins, aggregates, windows, set operations and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import correlation, half_even, latest_by, small, top_per_group
from ..operators.intervals import as_of
from . import query
from .tables import FILINGS, LATEST_SQL, filings, latest_order, money, table


@query(f"{FILINGS}, one AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY registrant, client, yr, q {LATEST_SQL}) = 1) SELECT registrant, client, yr, q, ok, ln, pk, round(amount, 2)::DOUBLE AS amount FROM one")
def latest_by_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of a filing's versions the latest."""
    one = latest_by(filings(spark, d), ["registrant", "client", "yr", "q"], latest_order())
    return one.select("registrant", "client", "yr", "q", "ok", "ln", "pk", money("amount").alias("amount"))


@query(f"{FILINGS} SELECT client, count(*) AS n, round(sum(amount), 2)::DOUBLE AS total, round(min(amount), 2)::DOUBLE AS least, round(max(amount), 2)::DOUBLE AS most, round(avg(amount), 2)::DOUBLE AS mean FROM filings GROUP BY 1 ORDER BY total DESC NULLS LAST, client LIMIT 25")
def top_clients(spark: SparkSession, d: str) -> DataFrame:
    """A1, O1, O2, O4, A24, A26."""
    a = F.col("amount")
    out = filings(spark, d).groupBy("client").agg(F.count(F.lit(1)).alias("n"), money(F.sum(a)).alias("total"), money(F.min(a)).alias("least"), money(F.max(a)).alias("most"), money(F.avg(a)).alias("mean"))
    return out.orderBy(F.col("total").desc_nulls_last(), "client").limit(25)


@query(f"{FILINGS} SELECT p_brand AS code, yr, q, count(DISTINCT ok) AS n_filings, count(DISTINCT registrant) AS n_firms, round(sum(amount), 2)::DOUBLE AS attributed FROM filings JOIN part ON pk = p_partkey GROUP BY 1, 2, 3")
def star_issue_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Amounts attributed to each issue, a ranking signal and not a total."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), F.col("p_brand").alias("code"))
    return filings(spark, d).join(p, "pk").groupBy("code", "yr", "q").agg(F.count_distinct("ok").alias("n_filings"), F.count_distinct("registrant").alias("n_firms"), money(F.sum("amount")).alias("attributed"))


@query(f"""{FILINGS}, senate AS (SELECT registrant, client, yr, q, round(sum(amount), 2)::DOUBLE AS s FROM filings WHERE ln % 2 = 1 GROUP BY ALL),
    house AS (SELECT registrant || '-' || client AS id, yr, q, round(sum(amount), 2)::DOUBLE AS h FROM filings WHERE ln % 2 = 0 GROUP BY ALL),
    split AS (SELECT split_part(id, '-', 1)::BIGINT AS registrant, split_part(id, '-', 2)::BIGINT AS client, yr, q, h FROM house)
    SELECT registrant, client, yr, q, s, h, round(s - h, 2)::DOUBLE AS gap, h = round(s * 10, 2)::DOUBLE AS ten_times FROM senate JOIN split USING (registrant, client, yr, q)""")
def cross_source_recon(spark: SparkSession, d: str) -> DataFrame:
    """Two sources joined through a compound id, four keys."""
    f, keys = filings(spark, d), ["registrant", "client", "yr", "q"]
    senate = f.filter("ln % 2 = 1").groupBy(*keys).agg(money(F.sum("amount")).alias("s"))
    house = f.filter("ln % 2 = 0").groupBy(F.concat_ws("-", "registrant", "client").alias("id"), "yr", "q").agg(money(F.sum("amount")).alias("h"))
    part = lambda k: F.split_part(F.col("id"), F.lit("-"), F.lit(k)).cast("long")
    house = house.select(part(1).alias("registrant"), part(2).alias("client"), "yr", "q", "h")
    return senate.join(house, keys).withColumns({"gap": money(F.col("s") - F.col("h")), "ten_times": F.col("h") == money(F.col("s") * 10)})


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    AND (c_nationkey, c_mktsegment) IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000)""")
def semi_join_in(spark: SparkSession, d: str) -> DataFrame:
    """IN of a subquery, and of a tuple."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rich = c.filter("c_acctbal > 9000").select("c_nationkey", "c_mktsegment")
    return c.join(o.filter("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left_semi").join(rich, ["c_nationkey", "c_mktsegment"], "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey, s_name FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09) x ON s_suppkey = l_suppkey WHERE l_suppkey IS NULL AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def anti_join_is_null(spark: SparkSession, d: str) -> DataFrame:
    """Without a match, and NOT IN."""
    s, li = table(spark, d, "supplier"), table(spark, d, "lineitem")
    out = s.join(li.filter("l_quantity > 49 AND l_discount > 0.09"), s.s_suppkey == li.l_suppkey, "left_anti")
    return out.join(s.filter("s_acctbal < 0").select("s_suppkey"), "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query(f"{FILINGS}, a AS (SELECT qidx, count(*) AS returned FROM filings WHERE flag = 'R' AND yr < 1998 GROUP BY 1), b AS (SELECT qidx, count(*) AS open FROM filings WHERE status = 'O' AND yr > 1995 GROUP BY 1) SELECT qidx, coalesce(returned, 0) AS returned, coalesce(open, 0) AS open FROM a FULL JOIN b USING (qidx)")
def full_outer_quarter(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    f = filings(spark, d)
    a = f.filter("flag = 'R' AND yr < 1998").groupBy("qidx").agg(F.count(F.lit(1)).alias("returned"))
    b = f.filter("status = 'O' AND yr > 1995").groupBy("qidx").agg(F.count(F.lit(1)).alias("open"))
    return a.join(b, "qidx", "full").na.fill(0, ["returned", "open"])


@query(f"{FILINGS}, c AS (SELECT p_brand || '/' || p_size AS code, qidx, count(*) AS n FROM filings JOIN part ON pk = p_partkey GROUP BY 1, 2) SELECT i.code, x.qidx, coalesce(n, 0) AS n FROM (SELECT DISTINCT code FROM c) i CROSS JOIN (SELECT DISTINCT qidx FROM c) x LEFT JOIN c USING (code, qidx)")
def spine_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """A dense grid of code and quarter; both lists come from the counted cells, the quarters are broadcast if few."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), F.concat_ws("/", "p_brand", "p_size").alias("code"))
    cells = filings(spark, d).join(p, "pk").groupBy("code", "qidx").agg(F.count(F.lit(1)).alias("n"))
    return cells.select("code").distinct().crossJoin(small(cells.select("qidx").distinct(), 10_000)).join(cells, ["code", "qidx"], "left").na.fill(0, ["n"])


@query(f"{FILINGS}, m AS (SELECT registrant, qidx, sum(amount) AS a FROM filings GROUP BY 1, 2) SELECT x.registrant, x.qidx, round((SELECT sum(y.a) FROM m y WHERE y.registrant = x.registrant AND y.qidx > x.qidx - 4 AND y.qidx <= x.qidx), 2)::DOUBLE AS trail4 FROM m x")
def trailing4_income(spark: SparkSession, d: str) -> DataFrame:
    """A correlated sum over a band as a window with a range frame."""
    m = filings(spark, d).groupBy("registrant", "qidx").agg(F.sum("amount").alias("a"))
    return m.select("registrant", "qidx", money(F.sum("a").over(Window.partitionBy("registrant").orderBy("qidx").rangeBetween(-3, 0))).alias("trail4"))


@query(f"""{FILINGS}, m AS (SELECT client, qidx, round(sum(amount), 2)::DOUBLE AS a FROM filings GROUP BY 1, 2)
    SELECT client, round(sum(a), 2)::DOUBLE AS total, (SELECT qidx FROM m y WHERE y.client = x.client ORDER BY a DESC, qidx LIMIT 1) AS peak, min(qidx) AS first_quarter, arg_min(a, qidx) AS first_amount FROM m x GROUP BY client""")
def peak_quarter(spark: SparkSession, d: str) -> DataFrame:
    """The correlated peak as a maximum by a struct."""
    m = filings(spark, d).groupBy("client", "qidx").agg(money(F.sum("amount")).alias("a"))
    return m.groupBy("client").agg(money(F.sum("a")).alias("total"), F.max_by("qidx", F.struct("a", -F.col("qidx"))).alias("peak"), F.min("qidx").alias("first_quarter"), F.min_by("a", F.struct("qidx")).alias("first_amount"))


@query(f"""{FILINGS}, s AS (SELECT client, min(posted::DATE) AS a, max(posted::DATE) AS b, min(issue) AS kind FROM filings GROUP BY client, year(posted)),
    l AS (SELECT o_orderkey, o_custkey AS client, o_orderdate::DATE AS t FROM orders),
    r AS (SELECT o_orderkey, s.kind, CASE WHEN s.client IS NULL THEN NULL WHEN t BETWEEN a AND b THEN 'dated' ELSE 'nearest' END AS source,
            row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN t BETWEEN a AND b THEN 0 ELSE least(abs(t - a), abs(t - b)) END, a, b, kind) AS rn
          FROM l LEFT JOIN s USING (client))
    SELECT o_orderkey, kind, source FROM r WHERE rn = 1""")
def asof_party(spark: SparkSession, d: str) -> DataFrame:
    """The interval that holds a date, else the nearest by either end; the first on ties. A client has one interval a year."""
    day = F.to_date("posted")
    s = filings(spark, d).groupBy("client", F.year(day).alias("year")).agg(F.min(day).alias("a"), F.max(day).alias("b"), F.min("issue").alias("kind"))
    points = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("client"), F.to_date("o_orderdate").alias("t"))
    return as_of(points, s, "client", "t", "a", "b", "kind").select("o_orderkey", "kind", "source")


@query(f"{FILINGS} SELECT yr, count(DISTINCT registrant) AS firms, count(DISTINCT (registrant, client)) AS pairs, count(DISTINCT (CASE WHEN flag = 'R' THEN registrant END, client)) AS pairs_with_null, count(DISTINCT registrant || '|' || CASE WHEN flag = 'R' THEN issue END) AS joined FROM filings GROUP BY yr")
def distinct_tuple(spark: SparkSession, d: str) -> DataFrame:
    """Tuples with a null part count, concatenations with one don't."""
    own = F.when(F.col("flag") == "R", F.col("registrant"))
    text = F.concat(F.col("registrant").cast("string"), F.lit("|"), F.when(F.col("flag") == "R", F.col("issue")))
    return filings(spark, d).groupBy("yr").agg(F.count_distinct("registrant").alias("firms"), F.count_distinct(F.struct("registrant", "client")).alias("pairs"), F.count_distinct(F.struct(own, "client")).alias("pairs_with_null"), F.count_distinct(text).alias("joined"))


@query(f"{FILINGS} SELECT issue, round(sum(amount) FILTER (WHERE yr = 1996), 2)::DOUBLE AS y1996, round(sum(amount) FILTER (WHERE yr = 1997), 2)::DOUBLE AS y1997, sum(CASE WHEN flag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned, bool_or(status = 'F') AS any_f, any_value(issue) AS label FROM filings GROUP BY issue HAVING y1997 > 0")
def filter_pivot_years(spark: SparkSession, d: str) -> DataFrame:
    """A5, A6, A7, A8, A11, F10."""
    at = lambda y: money(F.sum(F.when(F.col("yr") == y, F.col("amount"))))
    out = filings(spark, d).groupBy("issue").agg(at(1996).alias("y1996"), at(1997).alias("y1997"), F.count_if(F.col("flag") == "R").alias("returned"), F.bool_or(F.col("status") == "F").alias("any_f"), F.any_value("issue", True).alias("label"))
    return out.filter("y1997 > 0")


@query(f"{FILINGS}, m AS (SELECT registrant, qidx, round(sum(amount), 2)::DOUBLE AS a FROM filings GROUP BY 1, 2), s AS (SELECT registrant, median(a) AS mid FROM m GROUP BY 1 HAVING count(*) >= 3) SELECT registrant, qidx, a, round(mid, 2)::DOUBLE AS mid, round(a / mid, 3) AS ratio FROM m JOIN s USING (registrant) WHERE mid > 0 AND a >= 1.5 * mid")
def median_spike(spark: SparkSession, d: str) -> DataFrame:
    """Quarters far above a firm's median."""
    m = filings(spark, d).groupBy("registrant", "qidx").agg(money(F.sum("amount")).alias("a"))
    s = m.groupBy("registrant").agg(F.median("a").alias("mid"), F.count(F.lit(1)).alias("n")).filter("n >= 3 AND mid > 0").drop("n")
    return m.join(s, "registrant").filter("a >= 1.5 * mid").select("registrant", "qidx", "a", money("mid").alias("mid"), F.round(F.col("a") / F.col("mid"), 3).alias("ratio"))


@query(f"{FILINGS} SELECT registrant, string_agg(DISTINCT issue, '; ' ORDER BY issue) AS issues, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM filings GROUP BY 1")
def listagg_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values joined in order."""
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_set(c)), sep)
    return filings(spark, d).groupBy("registrant").agg(joined("issue", "; ").alias("issues"), joined("flag", ",").alias("flags"))


@query(f"{FILINGS} SELECT CASE WHEN grouping(flag) = 1 THEN 'ALL' ELSE flag END AS kind, count(*) AS n, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY ROLLUP (flag)")
def rollup_total(spark: SparkSession, d: str) -> DataFrame:
    """A null kind stays apart from the total."""
    out = filings(spark, d).rollup("flag").agg(F.grouping("flag").alias("g"), F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("flag")).alias("kind"), "n", "total")


@query(f"{FILINGS} SELECT yr, flag, count(*) AS n, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY GROUPING SETS ((yr), (flag))")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return spark.sql("SELECT yr, flag, count(*) AS n, round(sum(amount), 2)::DOUBLE AS total FROM {f} GROUP BY GROUPING SETS ((yr), (flag))", f=filings(spark, d))


@query(f"{FILINGS} SELECT yr, flag, status, count(*) AS n FROM filings GROUP BY ALL")
def group_by_all(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return spark.sql("SELECT yr, flag, status, count(*) AS n FROM {f} GROUP BY ALL", f=filings(spark, d))


@query(f"{FILINGS} SELECT issue, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct, (sum(count(*)) OVER ())::BIGINT AS everything FROM filings GROUP BY 1")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    """The window runs over one row per issue."""
    n = filings(spark, d).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).withColumn("everything", F.sum("n").over(Window.partitionBy()))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.col("everything"), 3))


@query(f"{FILINGS}, t AS (SELECT issue, registrant, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY 1, 2) SELECT issue, registrant, total, row_number() OVER (PARTITION BY issue ORDER BY total DESC NULLS LAST, registrant) AS rk FROM t QUALIFY rk <= 10")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Ranks over sums."""
    t = filings(spark, d).groupBy("issue", "registrant").agg(money(F.sum("amount")).alias("total"))
    out = top_per_group(t, ["issue"], [F.col("total").desc_nulls_last(), F.col("registrant")], 10)
    return out.withColumn("rk", F.col("rk").cast("long"))


_SHARES = """WITH e AS (SELECT event_type AS code, ts::DATE::VARCHAR AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2),
    s AS (SELECT code, day, n, n::DOUBLE / sum(n) OVER (PARTITION BY day) AS press, v / sum(v) OVER (PARTITION BY day) AS spend FROM e)"""


def _shares(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("code"), F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    day = Window.partitionBy("day")
    return e.select("code", "day", "n", (F.col("n") / F.sum("n").over(day)).alias("press"), (F.col("v") / F.sum("v").over(day)).alias("spend"))


@query(f"""{_SHARES}, x AS (SELECT *, lead(spend) OVER w AS nxt, lag(spend) OVER w AS prv FROM s WINDOW w AS (PARTITION BY code ORDER BY day)),
    r AS (SELECT code, sum(n)::BIGINT AS total, round(corr(press, spend), 6) AS r_now, round(corr(press, nxt), 6) AS r_lead, round(corr(press, prv), 6) AS r_lag FROM x GROUP BY code)
    SELECT *, CASE greatest(coalesce(abs(r_now), 0), coalesce(abs(r_lead), 0), coalesce(abs(r_lag), 0)) WHEN abs(r_lead) THEN 'leads' WHEN abs(r_lag) THEN 'lags' ELSE 'concurrent' END AS strongest FROM r""")
def lead_lag_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of shares at three shifts."""
    w = Window.partitionBy("code").orderBy("day")
    x = _shares(spark, d).withColumns({"nxt": F.lead("spend").over(w), "prv": F.lag("spend").over(w)})
    r = x.groupBy("code").agg(F.sum("n").alias("total"), *[F.round(correlation(F.col("press"), F.col(c)), 6).alias(a) for c, a in (("spend", "r_now"), ("nxt", "r_lead"), ("prv", "r_lag"))])
    size = lambda c: F.coalesce(F.abs(F.col(c)), F.lit(0.0))
    most = F.greatest(size("r_now"), size("r_lead"), size("r_lag"))
    return r.withColumn("strongest", F.when(most == F.abs("r_lead"), "leads").when(most == F.abs("r_lag"), "lags").otherwise("concurrent"))


@query(f"""{_SHARES}, p AS (SELECT code, day, n, percent_rank() OVER (PARTITION BY code ORDER BY press) AS pp, percent_rank() OVER (PARTITION BY code ORDER BY spend) AS sp, (sum(n) OVER (PARTITION BY code))::BIGINT AS code_total FROM s)
    SELECT code, day, n, code_total, round(pp, 4) AS pp, round(sp, 4) AS sp, CASE WHEN pp >= 0.75 AND sp <= 0.5 THEN 'loud press' ELSE 'quiet press' END AS divergence FROM p WHERE (pp >= 0.75 AND sp <= 0.5) OR (pp <= 0.25 AND sp >= 0.75)""")
def percent_rank_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Loud in one share, quiet in the other."""
    code = Window.partitionBy("code")
    p = _shares(spark, d).select("code", "day", "n", F.sum("n").over(code).alias("code_total"), F.percent_rank().over(code.orderBy("press")).alias("pp"), F.percent_rank().over(code.orderBy("spend")).alias("sp"))
    loud = (F.col("pp") >= 0.75) & (F.col("sp") <= 0.5)
    p = p.filter(loud | ((F.col("pp") <= 0.25) & (F.col("sp") >= 0.75)))
    return p.withColumn("divergence", F.when(loud, "loud press").otherwise("quiet press")).withColumns({"pp": F.round("pp", 4), "sp": F.round("sp", 4)})


@query(f"""{FILINGS}, t AS (SELECT issue, yr, q, round(sum(amount), 2)::DOUBLE AS total FROM filings GROUP BY 1, 2, 3),
    r AS (SELECT *, rank() OVER (PARTITION BY yr, q ORDER BY total DESC) AS rk, lag(total) OVER (PARTITION BY issue ORDER BY yr, q) AS prev FROM t)
    SELECT issue, yr, q, total, rk, prev, CASE WHEN prev <> 0 THEN round((total - prev) / prev * 100, 4) END AS pct FROM r""")
def rank_and_change(spark: SparkSession, d: str) -> DataFrame:
    """Rank in a quarter and change to the one before."""
    t = filings(spark, d).groupBy("issue", "yr", "q").agg(money(F.sum("amount")).alias("total"))
    t = t.withColumns({"rk": F.rank().over(Window.partitionBy("yr", "q").orderBy(F.col("total").desc())).cast("long"), "prev": F.lag("total").over(Window.partitionBy("issue").orderBy("yr", "q"))})
    return t.withColumn("pct", F.when(F.col("prev") != 0, F.round((F.col("total") - F.col("prev")) / F.col("prev") * 100, 4)))


@query(f"{FILINGS} SELECT issue, yr, round(sum(amount) FILTER (WHERE q = 1), 2)::DOUBLE AS q1, round(sum(amount) FILTER (WHERE q = 2), 2)::DOUBLE AS q2, round(sum(amount) FILTER (WHERE q = 3), 2)::DOUBLE AS q3, round(sum(amount) FILTER (WHERE q = 4), 2)::DOUBLE AS q4 FROM filings GROUP BY 1, 2")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    """A wide table; the pivot's values are given, so no extra pass finds them."""
    out = filings(spark, d).groupBy("issue", "yr").pivot("q", [1, 2, 3, 4]).agg(F.sum("amount"))
    return out.select("issue", "yr", *[money(F.col(f"`{k}`")).alias(f"q{k}") for k in (1, 2, 3, 4)])


@query("""WITH o AS (SELECT o_custkey AS client, unnest(CASE WHEN o_orderstatus = 'P' THEN [NULL] ELSE [o_orderstatus, left(o_orderpriority, 1)] END) AS code, o_orderstatus AS status, o_orderkey FROM orders),
    s AS (SELECT client, status, string_agg(DISTINCT coalesce(code, '-'), ';' ORDER BY coalesce(code, '-')) AS codes FROM o GROUP BY 1, 2)
    SELECT client, max(codes) FILTER (WHERE status = 'F') AS f, max(codes) FILTER (WHERE status = 'O') AS o, max(codes) FILTER (WHERE status = 'P') AS p FROM s GROUP BY 1""")
def pivot_lists(spark: SparkSession, d: str) -> DataFrame:
    """Nested codes unnested, rows without any kept, and pivoted to a list per status."""
    o = table(spark, d, "orders")
    nested = o.select(F.col("o_custkey").alias("client"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") != "P", F.array("o_orderstatus", F.left("o_orderpriority", F.lit(1)))).alias("codes"))
    rows = nested.select("client", "status", F.explode_outer("codes").alias("code"))
    out = rows.groupBy("client").pivot("status", ["F", "O", "P"]).agg(F.collect_set(F.coalesce("code", F.lit("-"))))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ";"))
    return out.select("client", *[listed(F.col(c)).alias(c.lower()) for c in ("F", "O", "P")])


@query(f"{FILINGS} SELECT client, qidx, registrant, ok, ln, pk, count(*) OVER (PARTITION BY client) AS n_client, bool_or(flag = 'R') OVER (PARTITION BY client, qidx) AS any_r, count(*) OVER (PARTITION BY client, qidx, registrant) > 1 AS repeated, max(posted) OVER (PARTITION BY client, qidx) = posted AS is_last FROM filings")
def window_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole-partition windows."""
    pair = Window.partitionBy("client", "qidx")
    return filings(spark, d).select(
        "client", "qidx", "registrant", "ok", "ln", "pk", F.count(F.lit(1)).over(Window.partitionBy("client")).alias("n_client"), F.bool_or(F.col("flag") == "R").over(pair).alias("any_r"),
        (F.count(F.lit(1)).over(Window.partitionBy("client", "qidx", "registrant")) > 1).alias("repeated"), (F.max("posted").over(pair) == F.col("posted")).alias("is_last"),
    )


@query("SELECT c_nationkey::BIGINT AS k, 'both' AS kind FROM customer UNION SELECT s_nationkey::BIGINT, 'both' FROM supplier UNION ALL SELECT n_nationkey::BIGINT, 'nation' FROM nation")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """U1, U2."""
    keys = lambda t, c: table(spark, d, t).select(F.col(c).cast("long").alias("k"), F.lit("both").alias("kind"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit("nation").alias("kind"))
    return keys("customer", "c_nationkey").union(keys("supplier", "s_nationkey")).distinct().unionByName(nation)


@query(f"{FILINGS}, a AS (SELECT DISTINCT client FROM filings WHERE flag = 'R' AND q = 2), b AS (SELECT DISTINCT client FROM filings WHERE issue LIKE '1-%' AND q = 1) SELECT coalesce(a.client, b.client) AS client, CASE WHEN a.client IS NULL THEN 'name' WHEN b.client IS NULL THEN 'number' ELSE 'both' END AS via FROM a FULL JOIN b ON a.client = b.client")
def key_set_via(spark: SparkSession, d: str) -> DataFrame:
    """How a key was found."""
    f = filings(spark, d)
    found = f.groupBy("client").agg(F.max(F.when((F.col("flag") == "R") & (F.col("q") == 2), 1)).alias("a"), F.max(F.when(F.col("issue").startswith("1-") & (F.col("q") == 1), 1)).alias("b"))
    return found.filter("a IS NOT NULL OR b IS NOT NULL").select("client", F.when(F.col("a").isNull(), "name").when(F.col("b").isNull(), "number").otherwise("both").alias("via"))


@query("""SELECT p_partkey, p_name, nullif(p_size, 1) AS size, coalesce(nullif(p_size, 1), -1) AS filled FROM part WHERE p_type ILIKE '%steel%' OR (p_brand LIKE 'Brand#1%' AND p_size BETWEEN 5 AND 20)
    OR regexp_matches(p_name, '[aeiou]{2}') AND p_size IN (3, 7) AND p_type NOT ILIKE '%brass%' AND p_brand NOT IN ('Brand#11', 'Brand#22') AND p_size IS NOT NULL""")
def predicates(spark: SparkSession, d: str) -> DataFrame:
    """F1 to F4, F13."""
    size, name, kind, brand = (F.col(c) for c in ("p_size", "p_name", "p_type", "p_brand"))
    third = name.rlike("[aeiou]{2}") & size.isin(3, 7) & ~kind.ilike("%brass%") & ~brand.isin("Brand#11", "Brand#22") & size.isNotNull()
    kept = table(spark, d, "part").filter(kind.ilike("%steel%") | (brand.like("Brand#1%") & size.between(5, 20)) | third)
    return kept.select("p_partkey", "p_name", F.nullif(size, F.lit(1)).alias("size"), F.coalesce(F.nullif(size, F.lit(1)), F.lit(-1)).alias("filled"))


@query(f"{FILINGS}, t AS (SELECT max(qidx) AS t FROM filings) SELECT registrant, count(*) AS n, count(*) FILTER (WHERE qidx = (SELECT t FROM t)) AS n_last FROM filings WHERE qidx >= (SELECT t FROM t) - 3 GROUP BY 1")
def scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    """A one-row side."""
    f = filings(spark, d)
    f = f.crossJoin(F.broadcast(f.agg(F.max("qidx").alias("t")))).filter("qidx >= t - 3")
    return f.groupBy("registrant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("qidx") == F.col("t")).alias("n_last"))


@query(f"{FILINGS} SELECT DISTINCT a.client, a.qidx, a.registrant AS one, b.registrant AS other FROM filings a JOIN filings b ON a.client = b.client AND a.qidx = b.qidx AND a.registrant <> b.registrant")
def theta_other_registrant(spark: SparkSession, d: str) -> DataFrame:
    """Equal keys and an inequality beside them."""
    f = filings(spark, d).select("client", "qidx", "registrant").distinct()
    a, b = f.withColumnRenamed("registrant", "one"), f.withColumnRenamed("registrant", "other")
    return a.join(b, ["client", "qidx"]).filter("one <> other")


@query("""SELECT e.event_id, coalesce(c.c_name, s.s_name) AS who FROM (SELECT event_id, user_id, event_id % 2 = 0 AS senate FROM events) e
    LEFT JOIN customer c ON senate AND c_custkey = user_id LEFT JOIN supplier s ON NOT senate AND s_suppkey = user_id""")
def conditional_left_join(spark: SparkSession, d: str) -> DataFrame:
    """A row's kind picks the table it joins."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 2 == 0).alias("senate"))
    c, s = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    out = e.join(c, F.col("senate") & (F.col("c_custkey") == F.col("user_id")), "left").join(s, ~F.col("senate") & (F.col("s_suppkey") == F.col("user_id")), "left")
    return out.select("event_id", F.coalesce("c_name", "s_name").alias("who"))


@query("""SELECT o_orderkey, o_totalprice::BIGINT AS price, rtrim(upper(o_orderstatus || ' ,.'), ' ,.') AS status, substr(o_orderpriority, 1, 1) AS first_char, left(o_orderpriority, 3) AS start,
    replace(o_orderpriority, '-', '') AS plain, ceil(o_totalprice / 1000)::BIGINT AS k, (o_orderkey // 7)::BIGINT AS seventh, greatest(o_custkey, o_orderkey % 100) AS g, least(o_custkey, o_orderkey % 100) AS l FROM orders""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """2.12, T15, T17: functions that engines spell or round differently."""
    status = F.expr("trim(TRAILING ' ,.' FROM upper(concat(o_orderstatus, ' ,.')))")
    key, price, rank = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", half_even(price).alias("price"), status.alias("status"), F.substr(rank, F.lit(1), F.lit(1)).alias("first_char"), F.left(rank, F.lit(3)).alias("start"),
        F.replace(rank, F.lit("-"), F.lit("")).alias("plain"), F.ceil(price / 1000).alias("k"), F.expr("o_orderkey div 7").alias("seventh"), F.greatest("o_custkey", key % 100).alias("g"), F.least("o_custkey", key % 100).alias("l"),
    )


@query("SELECT doc_id, md5(doc_id::VARCHAR || ':42') AS draw FROM documents ORDER BY draw, doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """a sample that reruns repeat, by the order of a seeded hash."""
    draw = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")).cast("binary"))
    return table(spark, d, "documents").select("doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(50)
