"""Weights that turn counts and ages into scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def posterior_mean(successes: Column, n: Column, alpha: float = 2.0, beta: float = 2.0) -> Column:
    """Mean of the Beta posterior of a success rate."""
    return (successes + F.lit(alpha)) / (n + F.lit(alpha + beta))


def volume_shrinkage(n: Column, k: float = 500.0) -> Column:
    """Factor below 1 that pulls groups with few attempts toward 0."""
    return n / (n + F.lit(k))


def recency_weight(age_days: Column, half_life_days: float | Column = 365.0) -> Column:
    """Weight that halves with every half-life of age; above 1 for negative ages."""
    if not isinstance(half_life_days, Column):
        half_life_days = F.lit(float(half_life_days))
    return F.exp(F.lit(-math.log(2.0)) * (age_days / half_life_days))
