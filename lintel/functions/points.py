"""Lead points that are plain arithmetic on dates and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENCY_TYPE = "decimal(9,4)"

# Day limits of the scoring rules.
REJECTION_DAYS = 14
RECENCY_FULL_DAYS = 30
RECENCY_ZERO_DAYS = 180
CONTACT_DAYS = 30
VALUATION_HIGH = 2_000_000
VALUATION_MID = 500_000
OVERLOADED_SEALS = 40


def days_before(day: Column, as_of: Column) -> Column:
    """Age in days, null when the day is missing or lies in the future."""
    age = F.datediff(as_of, day)
    return F.when(age >= 0, age)


def recency_share(applied_date: Column, as_of: Column) -> Column:
    """1 up to 30 days, falling in a line to 0 at 180 days."""
    age = days_before(applied_date, as_of)
    span = RECENCY_ZERO_DAYS - RECENCY_FULL_DAYS
    falling = (F.lit(RECENCY_ZERO_DAYS) - age) / F.lit(span)
    share = (F.when(age <= RECENCY_FULL_DAYS, F.lit(1.0))
             .when(age < RECENCY_ZERO_DAYS, falling)
             .otherwise(F.lit(0.0)))
    return F.coalesce(share, F.lit(0.0))


def valuation_band(valuation: Column) -> Column:
    return (F.when(valuation > VALUATION_HIGH, F.lit("high"))
            .when(valuation >= VALUATION_MID, F.lit("mid"))
            .otherwise(F.lit("low")))
