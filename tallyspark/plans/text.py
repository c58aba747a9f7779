"""Tagging, search, term statistics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.names import committee_key, filler_key, name_key
from ..functions.vectors import cosine, usable
from ..sources import scratch, sinks
from . import query
from .tables import table, texts

#: A small lexicon for the test tables: phrase and tag; a phrase may have several tags.
LEXICON = [("apache license", "LIC"), ("license", "LIC"), ("license", "LAW"), ("version 2.0", "LIC"), ("rights reserved", "LAW"), ("all rights reserved", "LAW"), ("the", "ENG"), ("und", "GER"), ("password", "SEC"), ("token", "SEC")]
_VALUES = ", ".join(f"('{k}', '{t}')" for k, t in LEXICON)
_PHRASES = [k for k, _ in LEXICON]
#: Word bounds as ASCII classes on both sides, as engines differ in what a word character is.
_BOUND = "(?:^|[^a-z0-9_])"


@query("""WITH t AS (SELECT o_orderkey, 'Support H.R. ' || o_orderkey % 9000 || '; oppose s ' || o_custkey || ' and H. Con. Res. ' || o_orderkey % 50 || ', s.j.res.7' AS txt FROM orders),
    m AS (SELECT o_orderkey, unnest(regexp_extract_all(upper(txt), '\\b((?:H|S)\\.?\\s*(?:J|CON)\\.?\\s*RES\\.?|(?:H|S)\\.?\\s*RES\\.?|H\\.?\\s*R\\.?|S\\.?)\\s*(\\d{1,5})\\b')) AS raw FROM t)
    SELECT regexp_replace(raw, '[^A-Z0-9]', '', 'g') AS bill, count(*) AS mentions, count(DISTINCT o_orderkey) AS orders FROM m GROUP BY 1""")
def bill_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every citation, normalised."""
    o = table(spark, d, "orders")
    part = lambda c: c.cast("string")
    txt = F.concat(F.lit("Support H.R. "), part(F.col("o_orderkey") % 9000), F.lit("; oppose s "), part(F.col("o_custkey")), F.lit(" and H. Con. Res. "), part(F.col("o_orderkey") % 50), F.lit(", s.j.res.7"))
    found = o.select("o_orderkey", F.explode(tx.bills(txt)).alias("bill"))
    return found.groupBy("bill").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("o_orderkey").alias("orders"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "keyword string, tag string")
    return tx.tag(texts(spark, d).select("doc_id", "text"), "text", lexicon, _PHRASES, unicode=False)


_TAGGED = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\b(?:all\s+rights\s+reserved|rights\s+reserved|apache\s+license|version\s+2\.0|password|license|token|the|und)\b') AS m FROM documents),
    k AS (SELECT DISTINCT doc_id, regexp_replace(u, '\s+', ' ', 'g') AS keyword FROM (SELECT doc_id, unnest(m) AS u FROM d)),
    lex(keyword, tag) AS (VALUES {_VALUES}), tags AS (SELECT DISTINCT doc_id, keyword, tag FROM k JOIN lex USING (keyword))"""


@query(f"{_TAGGED} SELECT doc_id, keyword, tag FROM tags")
def issue_tags(spark: SparkSession, d: str) -> DataFrame:
    """A text's distinct phrases and their codes; long phrases hide the short ones in them."""
    return _tags(spark, d)


@query(f"{_TAGGED} SELECT tag, keyword, count(DISTINCT doc_id) AS docs FROM tags GROUP BY 1, 2")
def facet_tags(spark: SparkSession, d: str) -> DataFrame:
    """A phrase may carry several tags."""
    return _tags(spark, d).groupBy("tag", "keyword").agg(F.count_distinct("doc_id").alias("docs"))


_TERMS = r"""WITH base AS (SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.\-]{1,28}[a-z0-9]'),
        lambda t: NOT list_contains(['STOP'], t) AND NOT regexp_full_match(t, '[0-9.]+')) AS w FROM documents),
    grams AS (SELECT doc_id, lang, source, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM base),
    terms AS (SELECT doc_id, lang, source, unnest(g) AS term FROM grams)""".replace("'STOP'", ", ".join(f"'{w}'" for w in tx.STOPWORDS))


def _z(own: str, covered: str = "") -> str:
    """Log odds of the terms of documents that are ``own`` against the others, from numbers of documents."""
    hidden = f"AND NOT list_has_all([{covered}], string_split(term, ' '))" if covered else ""
    return f"""t AS (SELECT term, count(*) AS docs FROM terms WHERE {own} GROUP BY 1), b AS (SELECT term, count(*) AS docs FROM terms WHERE NOT ({own}) GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM documents WHERE {own})::DOUBLE AS nt, (SELECT count(*) FROM documents WHERE NOT ({own}))::DOUBLE AS nb, (SELECT coalesce(sum(docs), 0) + count(*) FROM b)::DOUBLE AS a0),
    j AS (SELECT term, t.docs, coalesce(b.docs, 0) AS bd, t.docs::DOUBLE AS x, coalesce(b.docs, 0)::DOUBLE AS y, coalesce(b.docs, 0)::DOUBLE + 1 AS p, nt, nb, a0 FROM t LEFT JOIN b USING (term), n WHERE t.docs >= 4 {hidden}),
    z AS (SELECT term, docs, bd AS background_docs, round((ln((x + p) / (nt + a0 - x - p)) - ln((y + p) / (nb + a0 - y - p))) / sqrt(1 / (x + p) + 1 / (y + p)), 6) AS z FROM j)"""


@query(f"""{_TERMS}, {_z("source = 'src1'", "'die', 'der', 'und'")} SELECT * FROM z ORDER BY z DESC, term LIMIT 40""")
def keyness(spark: SparkSession, d: str) -> DataFrame:
    """Terms that one source's documents use more than the others', but for those a lexicon's words cover; the top forty."""
    counts, sizes = tx.compared(texts(spark, d), "text", F.col("source") == "src1")
    out = tx.keyness(counts, sizes, ["die", "der", "und"], least_docs=4)
    return out.withColumn("z", F.round("z", 6)).orderBy(F.col("z").desc(), "term").limit(40)


@query(f"{_TERMS}, top AS (SELECT term, count(*) AS n FROM terms WHERE term NOT LIKE '% %' GROUP BY 1 ORDER BY n DESC, term LIMIT 15) SELECT lang, term, count(*) AS docs FROM terms JOIN top USING (term) GROUP BY 1, 2")
def term_emergence(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent terms over a facet; one pass gives both levels."""
    df = tx.document_frequency(texts(spark, d), "text", ["lang"]).filter("term NOT LIKE '% %'")
    top = df.groupBy("term").agg(F.sum("docs").alias("n")).orderBy(F.col("n").desc(), "term").limit(15)
    return df.join(F.broadcast(top.select("term")), "term").select("lang", "term", "docs")


@query(f"""{_TAGGED}, hit AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'license|password'))
    SELECT doc_id FROM hit WHERE doc_id NOT IN (SELECT doc_id FROM tags WHERE tag = 'LIC')""")
def untagged_hits(spark: SparkSession, d: str) -> DataFrame:
    """Search hits that a tag misses."""
    hits = table(spark, d, "documents").filter(F.lower("text").rlike("license|password")).select("doc_id")
    return hits.join(_tags(spark, d).filter("tag = 'LIC'"), "doc_id", "left_anti")


@query("""WITH b AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    s AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM b),
    t AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM s)
    SELECT doc_id AS id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
    FROM s, t WHERE a + b > 0 ORDER BY score DESC, id LIMIT 20""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """X5."""
    return tx.bm25(texts(spark, d), "doc_id", "text", ["the", "license"]).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id").limit(20)


@query(f"""{_TERMS}, hits AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'license|password')), tagged AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\b(?:apache\\s+license|license|version\\s+2\\.0)\\b')),
    {_z("doc_id IN (SELECT doc_id FROM hits) AND doc_id NOT IN (SELECT doc_id FROM tagged)")} SELECT * FROM z ORDER BY z DESC, term LIMIT 40""")
def untagged_terms(spark: SparkSession, d: str) -> DataFrame:
    """The words of search hits that a tag misses; the top forty."""
    df = texts(spark, d)
    own = F.lower("text").rlike("license|password") & ~F.lower("text").rlike(r"\b(?:apache\s+license|license|version\s+2\.0)\b")
    return tx.keyness(*tx.compared(df, "text", own), least_docs=4).withColumn("z", F.round("z", 6)).orderBy(F.col("z").desc(), "term").limit(40)


@query("SELECT md5(text) AS hash, min(doc_id) AS first_doc, count(*) AS docs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def text_md5_map(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct text, for a model to read once."""
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("docs"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_doc FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, vec_id, len(v) AS dim, round(list_sum(v), 6) AS total FROM m JOIN v ON vec_id = first_doc WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0""")
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every document's vector by the map from documents to distinct texts; vectors with a gap are left out, and the others' length is checked on writing."""
    path = scratch.folder(spark, "vectors")
    sinks.save_vectors(usable(table(spark, d, "embeddings"), "embedding").select("vec_id", "embedding"), path, "embedding", 64)
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("vec_id"))
    out = docs.join(first, "hash").join(spark.read.parquet(path), "vec_id")
    return out.select("doc_id", "vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


@query(f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM v WHERE vec_id = 7) SELECT vec_id, round({_COS.format(a='v', b='q')}, 6) AS similarity FROM v, q WHERE vec_id <> 7 ORDER BY similarity DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """X11: every vector against one, a top-k per task."""
    e = table(spark, d, "embeddings")
    one = F.broadcast(e.filter("vec_id = 7").select(F.col("embedding").alias("q")))
    out = e.filter("vec_id <> 7").crossJoin(one).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return out.orderBy(F.col("similarity").desc(), "vec_id").limit(20)


@query(f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    m AS (SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v WHERE label = 3) GROUP BY i), q AS (SELECT list(a ORDER BY i) AS q FROM m)
    SELECT vec_id, round({_COS.format(a='v', b='q')}, 6) AS similarity FROM v, q ORDER BY similarity DESC, vec_id LIMIT 20""")
def more_like_this(spark: SparkSession, d: str) -> DataFrame:
    """Nearest to the mean of a record's vectors."""
    e = table(spark, d, "embeddings")
    mean = e.filter("label = 3").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    q = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda s: s["a"]).alias("q"))
    out = e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return out.orderBy(F.col("similarity").desc(), "vec_id").limit(20)


@query("SELECT doc_id, regexp_extract(text, '.{0,30}License.{0,40}') AS snippet FROM documents WHERE text LIKE '%License%'")
def context_snippet(spark: SparkSession, d: str) -> DataFrame:
    """What stands around a phrase on its line."""
    return table(spark, d, "documents").filter(F.col("text").like("%License%")).select("doc_id", F.regexp_extract("text", ".{0,30}License.{0,40}", 0).alias("snippet"))


@query("""WITH r AS (SELECT doc_id, lang, CASE WHEN n_chars < 300 THEN 'short' WHEN regexp_matches(lower(text), 'license') THEN 'license' WHEN lang = 'en' AND n_chars > 9000 THEN 'long english' WHEN lang = 'en' THEN 'english' ELSE 'other' END AS rule FROM documents),
    n AS (SELECT *, count(*) OVER (PARTITION BY rule) AS n, count(*) OVER (PARTITION BY rule, lang) AS nl FROM r)
    SELECT doc_id, CASE WHEN n < 10 THEN 'small' ELSE rule END AS rule, CASE WHEN nl >= 10 THEN rule || ' / ' || lang WHEN n >= 10 THEN rule ELSE 'small' END AS cluster FROM n""")
def rule_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that holds, small classes merged, a label of the deepest level with ten members."""
    from pyspark.sql import Window

    size = F.col("n_chars")
    rule = F.when(size < 300, "short").when(F.lower("text").rlike("license"), "license").when((F.col("lang") == "en") & (size > 9000), "long english").when(F.col("lang") == "en", "english").otherwise("other")
    r = table(spark, d, "documents").select("doc_id", "lang", rule.alias("rule"))
    counts = r.groupBy("rule", "lang").agg(F.count(F.lit(1)).alias("nl")).withColumn("n", F.sum("nl").over(Window.partitionBy("rule")))
    r = r.join(F.broadcast(counts), ["rule", "lang"])  # at most rules times languages
    label = F.when(F.col("nl") >= 10, F.concat_ws(" / ", "rule", "lang")).when(F.col("n") >= 10, F.col("rule")).otherwise("small")
    return r.select("doc_id", F.when(F.col("n") < 10, "small").otherwise(F.col("rule")).alias("rule"), label.alias("cluster"))


_NAMES = "(SELECT s_suppkey, s_name || CASE s_suppkey % 6 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' (fka Old) Co LLC' WHEN 2 THEN ' The Company' WHEN 3 THEN ' L.L.C.' WHEN 4 THEN ' & Sons Corp.' ELSE '' END AS raw FROM supplier)"


@query(f"""SELECT s_suppkey, raw, nullif(trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(raw), '\\([^)]*\\)', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g')), '(?:(?:^| )(?:LLC|INC|CO|CORP|COMPANY))+$', '')), '') AS key,
    nullif(regexp_replace(regexp_replace(upper(raw), '\\([^)]*\\)', ' ', 'g'), '[^A-Z0-9]+', '', 'g'), '') AS packed,
    list_aggregate(list_filter(string_split_regex(regexp_replace(upper(raw), '[[:punct:]]', '', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains(['THE', 'INC', 'CO', 'COMPANY', 'CORP', 'LLC'], w)), 'string_agg', ' ') AS filler FROM {_NAMES}""")
def norm_names(spark: SparkSession, d: str) -> DataFrame:
    """Three keys of one name; they differ on purpose."""
    k = F.col("s_suppkey") % 6
    end = F.when(k == 0, ", Inc.").when(k == 1, " (fka Old) Co LLC").when(k == 2, " The Company").when(k == 3, " L.L.C.").when(k == 4, " & Sons Corp.").otherwise("")
    raw = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", end).alias("raw"))
    return raw.select("s_suppkey", "raw", name_key(F.col("raw")).alias("key"), committee_key(F.col("raw")).alias("packed"), filler_key(F.col("raw")).alias("filler"))
