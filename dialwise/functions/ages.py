"""Ages of records in days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges (inclusive) and labels of the age buckets, in days.
AGE_BUCKETS = [
    (7, "0_7"),
    (30, "7_30"),
    (90, "30_90"),
    (180, "90_180"),
    (365, "180_365"),
    (730, "365_730"),
    (None, "730_plus"),
]


def clamp_age(age: Column) -> Column:
    """Negative ages (records updated after the send) count as 0; null stays null."""
    return F.when(age < 0, F.lit(0.0)).otherwise(age)


def _bucketed(age: Column, values: list) -> Column:
    edges = [edge for edge, _ in AGE_BUCKETS]
    out = F.when(age.isNull(), None)
    for edge, value in zip(edges[:-1], values[:-1]):
        out = out.when(age <= edge, F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def age_bucket(age: Column) -> Column:
    """Label of the age bucket. Buckets are closed on the right: exactly 7 days is ``0_7``."""
    return _bucketed(age, [label for _, label in AGE_BUCKETS])


def age_bucket_order(age: Column) -> Column:
    """Position of the age bucket, 0 for the youngest."""
    return _bucketed(age, list(range(len(AGE_BUCKETS))))


def whole_days_between(earlier: Column, later: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, cut toward zero on both sides of it.

    Both are read as wall-clock times, so no daylight-saving hour can add or lose a day.
    """
    span = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), span)
