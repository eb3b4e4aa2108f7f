"""Dates as texts print them, read token by token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def month_number(word: Column) -> Column:
    """1 to 12 for a month's name or its first three letters or more; null for other words."""
    at = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: m.startswith(F.lower(word))), True)
    return F.when((F.length(word) >= 3) & (at > 0), at)


def leading_date(text: Column) -> Column:
    """The date that a text begins with, after blanks and marks: 1st September 2026, Sep 1, 2026, Sep 2026 (its first day),
    01-09-2026, 1.9.26 (2026), 2026-09-01; null if it begins with none or with no valid one."""
    head = F.lower(F.regexp_extract(text, r"^[\s:,.(-]*((?:[^\W_]+[\s,./-]*){0,5})", 1))
    tokens = F.filter(F.regexp_extract_all(head, F.lit(r"\d+|[^\W\d_]+"), 0), lambda t: ~t.isin("st", "nd", "rd", "th", "of"))
    a, b, c = (F.get(tokens, F.lit(k)) for k in range(3))
    digits = lambda t, n: t.rlike(rf"^\d{{{n}}}$")
    year = lambda t: F.when(digits(t, 4), t).when(digits(t, 2), F.concat(F.lit("20"), t))
    day = lambda t: F.when(t.rlike(r"^\d{1,2}$"), t)
    number = lambda t: month_number(t).cast("string")
    date = lambda y, m, d: F.try_to_date(F.concat(y, F.lit("-"), m, F.lit("-"), d), "yyyy-M-d")
    return F.coalesce(
        F.when(digits(a, 4), date(a, day(b), day(c))),
        F.when(month_number(a).isNotNull(), F.coalesce(date(year(c), number(a), day(b)), date(F.when(digits(b, 4), b), number(a), F.lit("1")))),
        date(year(c), F.coalesce(number(b), day(b)), day(a)),
    )


def date_after(text: Column, cue: str) -> Column:
    """The first date that directly follows a cue (a pattern) in a text."""
    parts = F.split(text, cue)
    return F.get(F.filter(F.transform(F.slice(parts, 2, 1000), lambda p: leading_date(F.substring(p, 1, 40))), lambda x: x.isNotNull()), F.lit(0))
