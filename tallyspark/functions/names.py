"""Keys that names are matched by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a trailing run of is dropped from a name's key.
LEGAL_SUFFIXES = "LLC INC INCORPORATED LTD LIMITED LLP LP PLC CO CORP CORPORATION COMPANY PC PLLC SA AG GMBH NV BV PTY USA US".split()
# Words dropped anywhere by the second key.
FILLERS = "THE INC INCORPORATED LLC LLP LP LTD LIMITED CORP CORPORATION CO COMPANY PLLC PC PLC".split()


def name_key(raw: Column) -> Column:
    """Upper case, without parentheses' contents, punctuation as blanks, trailing legal words dropped; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(raw), r"\([^)]*\)", " "), r"[^A-Z0-9]+", " "))
    return F.nullif(F.trim(F.regexp_replace(plain, r"(?:(?:^| )(?:" + "|".join(LEGAL_SUFFIXES) + r"))+$", "")), F.lit(""))


def filler_key(raw: Column) -> Column:
    """Upper case, punctuation removed (not blanked), filler words dropped wherever they stand. A key of its own: not name_key()."""
    words = F.split(F.regexp_replace(F.upper(raw), r"\p{Punct}", ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(FILLERS)), " ")


def committee_key(raw: Column) -> Column:
    """Letters and digits only, without parentheses' contents."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.upper(raw), r"\([^)]*\)", " "), r"[^A-Z0-9]+", ""), F.lit(""))


# Words that a name is shown without, and spellings that title case gets wrong.
SHOWN_WITHOUT = "incorporated inc llc corp corporation company co ltd lp pllc plc na".split()
SPELT = {"Llc": "LLC", "Usa": "USA", "Us": "US", "Ai": "AI", "Dc": "DC"}


def title_case(name: Column) -> Column:
    """Names filed in capitals with capital initials only, but for some abbreviations; others as they are."""
    words = F.transform(F.split(F.initcap(F.lower(name)), " "), lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SPELT.items() for x in pair]), F.regexp_replace(w, "[.,;]+$", "")), w))
    return F.when(name == F.upper(name), F.array_join(words, " ")).otherwise(name)


def shorten(name: Column, most: int = 17) -> Column:
    """A name to label a chart with: without parentheses, what follows a comma, and legal words; two words, or the first cut, if longer than ``most``."""
    plain = F.regexp_replace(name, r"\(.*?\)", "")
    plain = F.element_at(F.split(plain, " d/b/a "), -1)
    plain = F.regexp_replace(F.split_part(plain, F.lit(","), F.lit(1)), r"(?i)\b(?:" + "|".join(SHOWN_WITHOUT) + r")\b\.?", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^[ ,.]+|[ ,.]+$", ""), r"\s+", " ")
    words = F.split(plain, " ")
    two = F.array_join(F.slice(words, 1, 2), " ")
    return F.when(F.length(plain) <= most, plain).when(F.length(two) <= most, two).otherwise(F.left(words[0], F.lit(most - 1)))


def family(name: Column, families: dict[str, list[str]]) -> Column:
    """The label of the first family one of whose words the name holds, without case; the name itself if there is none."""
    out = name
    for label, words in reversed(families.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.upper(name), F.lit(w.upper()))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out
