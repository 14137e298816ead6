"""Daily profiles: partial sums that merge, and sketches of different people.

A profile holds the totals of a day by system, area code and age bucket; a sketch row holds a
HyperLogLog sketch of the people of a day and system. Both are small beside the events (days x systems x
area codes x buckets), both are computed per day, and both merge in any order: totals add up, sketches
unite. Rates, ranking, area rates, baseline and monitoring then read the profile instead of the events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.functions import AGE_BUCKETS, age_bucket_order, clamp_age
from dialwise.operators.ranking import event_profile, roll_up
from dialwise.operators.rates import best_first, with_rate

#: What a profile is kept by. ``age_bucket_order`` is null for events of unknown age.
DAY_KEYS = ["envio_data", "id_sistema_mask", "telefone_ddd", "age_bucket_order"]
#: Sketches have 2^LG_K registers; the relative standard error of an estimate is about 0.83 / sqrt(2^LG_K).
LG_K = 12


def daily_profile(events: DataFrame) -> DataFrame:
    """Totals per send day, system, area code and age bucket."""
    bucket = age_bucket_order(clamp_age(F.col("age_days")))
    return event_profile(events.withColumn("age_bucket_order", bucket), DAY_KEYS)


def merged(*profiles: DataFrame) -> DataFrame:
    """Profiles of disjoint events as one, whatever their order."""
    whole = profiles[0]
    for profile in profiles[1:]:
        whole = whole.unionByName(profile)
    return roll_up(whole, *DAY_KEYS)


def _rates(profile: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    counted = roll_up(profile, *keys).select(*keys, "n", "successes")
    return with_rate(counted, alpha).select(*keys, "n", "rate", "ci_low", "ci_high")


def system_rates(profile: DataFrame, alpha: float = 0.05) -> DataFrame:
    """As ``rates_by_system`` of the events behind the profile."""
    known = profile.where(F.col("id_sistema_mask").isNotNull())
    return best_first(_rates(known, ["id_sistema_mask"], alpha), "id_sistema_mask")


def age_rates(profile: DataFrame, alpha: float = 0.05) -> DataFrame:
    """As ``rates_by_age`` of the events behind the profile."""
    label = F.lit(None).cast("string")
    for order, (_, name) in enumerate(AGE_BUCKETS):
        label = F.when(F.col("age_bucket_order") == order, F.lit(name)).otherwise(label)
    aged = profile.where(F.col("age_bucket_order").isNotNull()).withColumn("age_bucket", label)
    return _rates(aged, ["age_bucket", "age_bucket_order"], alpha).orderBy("age_bucket_order")


def baseline(profile: DataFrame) -> DataFrame:
    """As ``baseline_rate`` of the events behind the profile."""
    return profile.agg(F.try_divide(F.sum("successes"), F.sum("flagged")).alias("baseline_p"))


def daily_rates(profile: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Events, known outcomes, delivery rate of the events and its interval per send day."""
    return _rates(profile, ["envio_data"], alpha)


def people_sketches(events: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """A sketch of the different people per send day and system."""
    return (
        events.where(F.col("cpf").isNotNull())
        .groupBy("envio_data", "id_sistema_mask")
        .agg(F.hll_sketch_agg("cpf", F.lit(lg_k)).alias("people"))
    )


def estimated_people(sketches: DataFrame, *keys: str) -> DataFrame:
    """About how many different people there are per group of ``keys``, from united sketches."""
    united = F.hll_sketch_estimate(F.hll_union_agg("people"))
    return sketches.groupBy(*keys).agg(united.alias("people"))


def error_bound(exact: Column, lg_k: int = LG_K, sigmas: float = 4.0) -> Column:
    """How far an estimate may be from the exact count at that many standard errors, 1 at least."""
    return F.greatest(F.lit(1.0), exact * F.lit(sigmas * 1.04 / (2 ** (lg_k / 2))))
