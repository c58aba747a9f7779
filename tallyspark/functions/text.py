"""Bill citations, phrase taggers, tokens and term statistics. JVM expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import small

# Fixed value: citations, resolutions before plain bills, so that H.J.Res. 5 isn't read as a bill of the House.
BILL = (
    r"(?iU)\b(H\.?\s*J\.?\s*RES\.?|S\.?\s*J\.?\s*RES\.?|H\.?\s*CON\.?\s*RES\.?|S\.?\s*CON\.?\s*RES\.?"
    r"|H\.?\s*RES\.?|S\.?\s*RES\.?|H\.?\s*R\.?|S\.?)\s*(\d{1,5})\b"
)


def cited(text: Column) -> Column:
    """Every citation in order, as written; repeats stay."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BILL), F.lit(0))


def bill_key(citation: Column) -> Column:
    """A citation's letters and number."""
    return F.regexp_replace(F.upper(citation), r"[^A-Z0-9]", "")


def bills(text: Column) -> Column:
    """Every citation in order, as letters and number without punctuation; repeats stay."""
    return F.transform(cited(text), bill_key)


def phrase_pattern(phrases: list[str], unicode: bool = True) -> str:
    """Phrases as whole words, longer ones first, any white space inside; a long phrase hides the short ones in it."""
    body = "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in sorted(set(phrases), key=lambda p: (-len(p), p)))
    return ("(?iU)" if unicode else "(?i)") + rf"(?<!\w)(?:{body})(?!\w)"


def phrases_in(text: Column, phrases: list[str], unicode: bool = True) -> Column:
    """The distinct phrases in a text, lower case, single blanks."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(phrase_pattern(phrases, unicode)), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.lower(m), r"(?U)\s+", " ")))


def tag(df: DataFrame, text_col: str, lexicon: DataFrame, phrases: list[str], unicode: bool = True) -> DataFrame:
    """df's other columns with keyword and tag, one row per distinct pair. lexicon: keyword, tag; a keyword may have several tags."""
    found = df.withColumn("keyword", F.explode(phrases_in(F.col(text_col), phrases, unicode))).drop(text_col)
    return found.join(small(lexicon, 100_000), "keyword").distinct()


# Words left out of term statistics.
STOPWORDS = """
a an the and or of to in on for with by from as at is are be been being this that
these those it its their his her our your they them we you he she i not no any all
some more most other such than then so if but into over under about above below up
down out off only own same too very can will just should now
issues issue related relating regarding concerning pertaining matters matter act
bill bills legislation legislative law laws house senate congress congressional
federal policy policies regulation regulations regulatory rule rules proposed
implementation support supporting oppose monitor monitoring general provisions
provision including include includes potential various affecting affect impact
efforts effort discussion discussions administration agency agencies department
committee reform reforms amendment amendments section funding appropriations
program programs national united states government public private sector industry
company companies inc llc corp corporation service services
""".split()
TOKEN = r"[a-z0-9][a-z0-9.\-]{1,28}[a-z0-9]"


def tokens(text: Column) -> Column:
    """Lower-case tokens of 3 to 30 characters, without stop words and numbers, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS) & ~t.rlike(r"^[0-9.]+$"))


def ngrams(words: Column) -> Column:
    """The tokens and the pairs of tokens next to each other after stop words are gone."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def document_frequency(df: DataFrame, text_col: str, by: list[str] | None = None) -> DataFrame:
    """term, docs (per ``by``): in how many texts a term occurs."""
    by = by or []
    terms = df.select(*by, F.explode(F.array_distinct(ngrams(tokens(F.col(text_col))))).alias("term"))
    return terms.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("docs"))


def keyness(counts: DataFrame, sizes: DataFrame, covered: list[str] = (), least_docs: int = 8) -> DataFrame:
    """term, docs, background_docs, z: log odds with the background as prior, over its standard error.

    counts: term, docs, background_docs, numbers of texts that have the term; sizes: one row, n_docs and
    n_background, numbers of texts. The prior's mass is the background's document frequencies and one per
    term it has. Terms of fewer than ``least_docs`` texts are left out, and those all of whose words are ``covered``.
    """
    both = F.when(F.col("docs") >= 0, F.col("background_docs"))  # of the same columns as the terms below, so that one shuffle serves both
    prior_mass = counts.agg((F.coalesce(F.sum(both), F.lit(0)) + F.count_if(both > 0)).alias("a0"))
    # one condition, as two would be taken apart and the words looked at in every text
    shown = F.when(F.col("docs") >= least_docs, ~F.forall(F.split("term", " "), lambda w: w.isin(list(covered))) if covered else F.lit(True)).otherwise(F.lit(False))
    joined = counts.filter(shown).crossJoin(F.broadcast(prior_mass)).crossJoin(F.broadcast(sizes))
    x, y = F.col("docs").cast("double"), F.col("background_docs").cast("double")
    prior = y + 1
    gap = F.ln((x + prior) / (F.col("n_docs") + F.col("a0") - x - prior)) - F.ln((y + prior) / (F.col("n_background") + F.col("a0") - y - prior))
    return joined.select("term", "docs", "background_docs", (gap / F.sqrt(1 / (x + prior) + 1 / (y + prior))).alias("z"))


def compared(df: DataFrame, text_col: str, own: Column) -> tuple[DataFrame, DataFrame]:
    """counts and sizes for keyness(): of the texts that are ``own`` against all others."""
    texts = df.withColumn("own", F.coalesce(own, F.lit(False)))
    side = lambda mine: F.coalesce(F.sum(F.when(F.col("own") if mine else ~F.col("own"), F.col("docs"))), F.lit(0))
    counts = document_frequency(texts, text_col, ["own"]).groupBy("term").agg(side(True).alias("docs"), side(False).alias("background_docs"))
    return counts, texts.agg(F.count_if("own").alias("n_docs"), F.count_if(~F.col("own")).alias("n_background"))


def bm25(df: DataFrame, id_col: str, text_col: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score of texts with any query word. One scan: only counts of the query's words leave it."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))

    def times(word: str) -> Column:
        return F.size(F.filter("w", lambda x: x == word))

    base = df.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("length"), *[times(q).alias(f"tf{k}") for k, q in enumerate(query)])
    totals = base.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))])
    parts = []
    for k in range(len(query)):
        tf, found = F.col(f"tf{k}"), F.col(f"df{k}")
        parts.append(F.ln(1 + (F.col("n") - found + 0.5) / (found + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean"))))
    any_ = sum((F.col(f"tf{k}") for k in range(1, len(query))), F.col("tf0")) > 0
    return base.filter(any_).crossJoin(F.broadcast(totals)).select("id", sum(parts[1:], parts[0]).alias("score"))
