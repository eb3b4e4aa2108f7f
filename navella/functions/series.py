"""Expressions over price series and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252
RISK_FREE = 0.065


def as_of(date: Column, value: Column, target: Column) -> Column:
    """Aggregate: (date, value) of the last date on or before target; null if there is none. A mergeable partial
    aggregate, so no join and no window is needed."""
    return F.max(F.when(date <= target, F.struct(date.alias("date"), value.alias("nav"))))


def cagr(first_date: Column, first: Column, last_date: Column, last: Column) -> Column:
    """Growth a year by the days between the dates; under a year the simple return; null without days or a start."""
    years = F.datediff(last_date, first_date) / 365.25
    return F.when((first > 0) & (years > 0), F.when(years < 1, last / first - 1).otherwise(F.pow(last / first, 1 / F.when(years > 0, years)) - 1))


def nearest_rank(p: float, n: Column) -> Column:
    """1-based rank of the nearest-rank quantile p of n sorted values, halves to even."""
    return F.rint(F.lit(p) * (n - 1)) + 1


def volatility(r: Column) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(TRADING_DAYS))


def annual_mean(r: Column) -> Column:
    return F.pow(1 + F.avg(r), F.lit(TRADING_DAYS)) - 1


def downside(r: Column) -> Column:
    """Deviation of the losses over all days."""
    return F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2)))) * F.sqrt(F.lit(TRADING_DAYS))


def over(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return F.try_divide(x, y)
