"""Decay of delivery with record age: quantile bins, logistic fit, half-life.

Ages are whole days cut to 0..2000, so one aggregation reduces all events to at most 2001 rows,
one per day of age. Bins, standardisation and fit work on that histogram and are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.operators.rates import success_total

MAX_AGE = 2000
_TINY = 1e-12
# A last Newton step beyond this means that the fit did not converge.
_SETTLED = 1e-6


def decay_histogram(events: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """Attempts and successes per day of age, from aged events with a known outcome."""
    age = F.least(F.greatest(F.col("age_days"), F.lit(0.0)), F.lit(float(max_age)))
    return (
        events.where(F.col("delivered").isNotNull() & F.col("age_days").isNotNull())
        .groupBy(age.alias("age"))
        .agg(F.count(F.lit(1)).alias("n"), success_total("delivered").alias("successes"))
    )


def decay_bins(events: DataFrame, bins: int = 50, max_age: int = MAX_AGE) -> DataFrame:
    """Up to ``bins`` quantile bins of age with mean age, attempts, successes and smoothed rate.

    Bins are closed on the right; equal edges merge, so there may be fewer bins.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges_below = F.size(F.filter("edges", lambda edge: edge < F.col("day.age")))
    return (
        decay_histogram(events, max_age)
        .agg(
            F.array_distinct(F.percentile("age", shares, F.col("n"))).alias("edges"),
            F.collect_list(F.struct("age", "n", "successes")).alias("days"),
        )
        .select("edges", F.explode("days").alias("day"))
        .groupBy(edges_below.alias("bin"))
        .agg(
            (F.sum(F.col("day.age") * F.col("day.n")) / F.sum("day.n")).alias("age_days"),
            F.sum("day.n").alias("n"),
            F.sum("day.successes").alias("successes"),
        )
        .withColumn("p", (F.col("successes") + 0.5) / (F.col("n") + 1.0))
    )


def _with_scale(bins: DataFrame) -> DataFrame:
    """One row: mean and spread of the bin ages, unweighted, and the bins as a list."""
    return bins.agg(
        F.avg("age_days").alias("age_mean"),
        F.stddev_pop("age_days").alias("age_std"),
        F.collect_list(F.struct("bin", "age_days", "n", "successes", "p")).alias("bins"),
    )


def _scaled(age: Column) -> Column:
    return (age - F.col("age_mean")) / F.greatest(F.col("age_std"), F.lit(_TINY))


def decay_bins_scaled(bins: DataFrame) -> DataFrame:
    """The bins with their age standardised over the bins."""
    return (
        _with_scale(bins)
        .select("age_mean", "age_std", F.inline("bins"))
        .withColumn("age_scaled", _scaled(F.col("age_days")))
    )


def _newton_step(points: Column, at: Column, ridge: float) -> Column:
    """One Newton step of the penalised binomial fit; ``at`` and the result hold const and slope."""

    def add(total: Column, point: Column) -> Column:
        x, weight = point["x"], point["weight"]
        mu = 1 / (1 + F.exp(-(at["const"] + at["slope"] * x)))
        pull, curve = weight * (point["p"] - mu), weight * mu * (1 - mu)
        return F.struct(
            (total["g0"] + pull).alias("g0"),
            (total["g1"] + pull * x).alias("g1"),
            (total["h00"] + curve).alias("h00"),
            (total["h01"] + curve * x).alias("h01"),
            (total["h11"] + curve * x * x).alias("h11"),
        )

    start = F.struct(*[F.lit(0.0).alias(s) for s in ("g0", "g1", "h00", "h01", "h11")])

    def move(total: Column) -> Column:
        # The penalty is per mean log-likelihood of the bins, so it grows with their number.
        penalty = F.size(points) * F.lit(ridge)
        g0 = total["g0"] - penalty * at["const"]
        g1 = total["g1"] - penalty * at["slope"]
        h00, h11, h01 = total["h00"] + penalty, total["h11"] + penalty, total["h01"]
        det = h00 * h11 - h01 * h01
        return F.struct(
            (at["const"] + F.try_divide(h11 * g0 - h01 * g1, det)).alias("const"),
            (at["slope"] + F.try_divide(h00 * g1 - h01 * g0, det)).alias("slope"),
        )

    return F.aggregate(points, start, add, move)


def decay_fit(bins: DataFrame, ridge: float = 1e-4, steps: int = 25) -> DataFrame:
    """Binomial fit of the smoothed rate on standardised age, weighted by attempts: one row.

    Minimises the mean negative log-likelihood over the bins plus ``ridge``/2 times the squared
    coefficients, the constant included. Newton steps run as an expression over the bins (at most
    a few dozen), so the fit is part of the plan and fetches nothing to the driver. ``last_step`` is
    the length of the last one: large if the steps did not converge.
    """
    points = F.transform(
        "bins",
        lambda b: F.struct(
            _scaled(b["age_days"]).alias("x"),
            b["p"].alias("p"),
            b["n"].cast("double").alias("weight"),
        ),
    )
    start = F.struct(F.lit(0.0).alias("const"), F.lit(0.0).alias("slope"))
    all_but_last = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(steps - 1, 1))),
        start,
        lambda at, _: _newton_step(F.col("points"), at, ridge),
    )
    return (
        _with_scale(bins)
        .withColumn("points", points)
        .withColumn("before", all_but_last)
        .withColumn("fit", _newton_step(F.col("points"), F.col("before"), ridge))
        .select(
            F.col("fit.const").alias("const"),
            F.col("fit.slope").alias("age_scaled"),
            "age_mean",
            "age_std",
            F.hypot(
                F.col("fit.const") - F.col("before.const"), F.col("fit.slope") - F.col("before.slope")
            ).alias("last_step"),
        )
    )


def half_life(fit: DataFrame, fallback_days: float = 365.0) -> DataFrame:
    """Slope per day and days until the odds halve; infinite without decay.

    ``half_life_days`` is the value to score with: the fallback where the odds do not halve. Both are
    null where the fit did not converge, so that a failed fit is never taken for an answer.
    """
    settled = ~F.coalesce(F.col("last_step") > _SETTLED, F.lit(False))
    per_day = F.col("age_scaled") / F.greatest(F.col("age_std"), F.lit(_TINY))
    odds = F.when(F.col("b_per_day") >= 0, F.lit(float("inf"))).otherwise(
        F.lit(math.log(0.5)) / F.col("b_per_day")
    )
    known = F.col("half_life_odds").isNotNull() & ~F.isnan("half_life_odds")
    finite = known & (F.abs("half_life_odds") < float("inf"))
    return (
        fit.select(F.when(settled, per_day).alias("b_per_day"), settled.alias("settled"))
        .withColumn("half_life_odds", odds)
        .withColumn(
            "half_life_days",
            F.when(finite, F.col("half_life_odds")).otherwise(
                F.when(F.col("settled"), F.lit(fallback_days))
            ),
        )
        .drop("settled")
    )
