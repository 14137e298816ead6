"""Column functions. Each takes and returns Spark columns, so the work stays in generated code."""

from dialwise.functions.ages import (
    AGE_BUCKETS,
    age_bucket,
    age_bucket_order,
    clamp_age,
    whole_days_between,
)
from dialwise.functions.chance import poisson_one, uniform
from dialwise.functions.rates import (
    delivered_flag,
    error_extents,
    normal_quantile,
    sample_size,
    two_proportion_z,
    upper_tail,
    wilson_bounds,
)
from dialwise.functions.weights import posterior_mean, recency_weight, volume_shrinkage

__all__ = [
    "AGE_BUCKETS",
    "age_bucket",
    "age_bucket_order",
    "clamp_age",
    "delivered_flag",
    "error_extents",
    "normal_quantile",
    "poisson_one",
    "posterior_mean",
    "recency_weight",
    "sample_size",
    "two_proportion_z",
    "uniform",
    "upper_tail",
    "volume_shrinkage",
    "whole_days_between",
    "wilson_bounds",
]
