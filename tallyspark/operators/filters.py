"""Filters that a caller composes from optional terms."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(column: str, term: str) -> Column:
    """Case-insensitive pattern search."""
    return F.lower(F.col(column)).rlike(term.lower())


def select_filings(
    df: DataFrame,
    client: str | None = None,
    registrant: str | None = None,
    issues: list[str] | None = None,
    joiner: str = "or",
    first_day: str | None = None,
    last_day: str | None = None,
    least: float | None = None,
    most: float | None = None,
    amounts: tuple[str, ...] = ("income", "expenses"),
    issue_col: str = "issue_text",
    day_col: str = "posted",
) -> DataFrame:
    """df's rows that meet every given term.

    Names and issue terms are patterns without case; issue terms hold all ('and') or any ('or'). Days are
    inclusive. ``least`` and ``most`` must hold for one and the same of the amount columns. Null fails a term.
    """
    terms: list[Column] = [contains(c, t) for c, t in (("client", client), ("registrant", registrant)) if t]
    if issues:
        terms.append(reduce(and_ if joiner == "and" else or_, [contains(issue_col, t) for t in issues]))
    if first_day:
        terms.append(F.to_date(day_col) >= F.lit(first_day).cast("date"))
    if last_day:
        terms.append(F.to_date(day_col) <= F.lit(last_day).cast("date"))
    bounds = [(lambda c: c >= least) if least is not None else None, (lambda c: c <= most) if most is not None else None]
    bounds = [b for b in bounds if b]
    if bounds:
        terms.append(reduce(or_, [reduce(and_, [b(F.col(a)) for b in bounds]) for a in amounts]))
    return df.filter(reduce(and_, terms)) if terms else df


def with_codes(df: DataFrame, column: str, codes: list[str], known: set[str], joiner: str = "or") -> DataFrame:
    """df's rows whose array of codes holds all ('and') or any ('or') of ``codes``; a code that isn't known is an error."""
    if unknown := sorted(set(codes) - known):
        raise ValueError(f"unknown codes: {', '.join(unknown)}")
    asked = F.array(*[F.lit(c) for c in codes])
    return df.filter(F.size(F.array_except(asked, column)) == 0 if joiner == "and" else F.arrays_overlap(column, asked))
