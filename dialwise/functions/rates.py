"""Success flag, rate intervals and sample size."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses that mean the message arrived (a read message was delivered).
DELIVERED_STATUSES = ["delivered", "read"]


def normal_quantile(p: float) -> float:
    """Quantile of the standard normal distribution, known when the plan is built."""
    return NormalDist().inv_cdf(p)


def delivered_flag(status: Column) -> Column:
    """1 for a delivered message, 0 for another status, null for an unknown one."""
    return F.lower(status.cast("string")).isin(DELIVERED_STATUSES).cast("int")


def wilson_bounds(successes: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval of a proportion, within [0, 1]; NaN on both sides where ``n`` is 0."""
    z = normal_quantile(1 - alpha / 2)
    size = F.when(n > 0, n.cast("double"))
    share = successes / size
    scale = 1 + z * z / size
    middle = (share + z * z / (2 * size)) / scale
    reach = z * F.sqrt(share * (1 - share) / size + z * z / (4 * size * size)) / scale
    nothing = F.lit(float("nan"))
    low = F.when(size.isNull(), nothing).otherwise(F.greatest(F.lit(0.0), middle - reach))
    high = F.when(size.isNull(), nothing).otherwise(F.least(F.lit(1.0), middle + reach))
    return low, high


def error_extents(rate: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Lengths of the error bars below and above a rate; never negative, 0 where unknown."""

    def extent(length: Column) -> Column:
        finite = length.isNotNull() & ~F.isnan(length) & (F.abs(length) < float("inf"))
        return F.when(finite, F.greatest(F.lit(0.0), length)).otherwise(F.lit(0.0))

    return extent(rate - low), extent(high - rate)


def sample_size(
    p_control: Column, p_treatment: Column, alpha: float = 0.05, power: float = 0.8
) -> Column:
    """Units per arm for a one-sided test of two proportions.

    0 where a proportion is not strictly between 0 and 1, null where both are equal (no number
    of units shows a difference of nothing) or one is null.
    """
    z_alpha, z_power = normal_quantile(1 - alpha), normal_quantile(power)
    pooled = (p_control + p_treatment) / 2
    spread = z_alpha * F.sqrt(2 * pooled * (1 - pooled)) + z_power * F.sqrt(
        p_control * (1 - p_control) + p_treatment * (1 - p_treatment)
    )
    gap = p_treatment - p_control
    inside = (p_control > 0) & (p_control < 1) & (p_treatment > 0) & (p_treatment < 1)
    return (
        F.when(~inside, F.lit(0).cast("bigint"))
        .when(inside & (gap != 0), F.ceil(spread * spread / (gap * gap)).cast("bigint"))
    )


# Coefficients, highest power first, of the published rational approximation to the normal
# distribution (Hart 1968; double precision), and the point from which a continued fraction is used, with
# so many steps.
NORMAL_TOP = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
    221.213596169931, 220.206867912376,
]
NORMAL_BOTTOM = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
    637.333633378831, 793.826512519948, 440.413735824752,
]
NORMAL_FAR, NORMAL_STEPS = 5.0, 40


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal value exceeds ``z``, to about 9 digits however small it is."""
    x = F.abs(z.cast("double"))

    def power_sum(factors: list[float]) -> Column:
        total = F.lit(factors[0])
        for factor in factors[1:]:
            total = total * x + F.lit(factor)
        return total

    fraction = x
    for step in range(NORMAL_STEPS, 0, -1):
        fraction = x + F.try_divide(F.lit(float(step)), fraction)
    far = F.exp(-x * x / 2) / fraction / F.lit(math.sqrt(2 * math.pi))
    near = F.exp(-x * x / 2) * power_sum(NORMAL_TOP) / power_sum(NORMAL_BOTTOM)
    tail = F.when(x < NORMAL_FAR, near).otherwise(far)
    return F.when(z < 0, 1 - tail).otherwise(tail)


def two_proportion_z(
    successes_a: Column, n_a: Column, successes_b: Column, n_b: Column
) -> Column:
    """The statistic of the difference a - b of two proportions, with pooled variance.

    Null where an arm is empty or all outcomes are the same.
    """
    pooled = F.try_divide(successes_a + successes_b, n_a + n_b)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b))
    gap = F.try_divide(successes_a, n_a) - F.try_divide(successes_b, n_b)
    return F.when(spread > 0, gap / F.sqrt(spread))
