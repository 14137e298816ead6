"""Reliability ranking of the source systems and the bonus of area codes.

Both, and the baseline rate, are totals over events by system and area code. ``event_profile``
computes those totals in one pass; everything else here works on that small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.functions import clamp_age, posterior_mean, volume_shrinkage

PROFILE_KEYS = ["id_sistema_mask", "telefone_ddd"]
_MEASURES = ["n", "flagged", "successes", "aged_n", "aged_successes", "aged_days"]


@dataclass(frozen=True)
class ScoreParams:
    """Parameters of ranking and scoring."""

    prior_alpha: float = 2.0
    prior_beta: float = 2.0
    half_life_days: float | Column = 365.0
    volume_k: float = 500.0
    area_min_n: int = 200
    area_low: float = 0.2
    area_high: float = 0.8
    area_bonus: float = 0.05


def event_profile(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals per system and area code: rows, known outcomes, successes, and those of known age."""
    flag = F.col("delivered").cast("bigint")
    aged = F.col("age_days").isNotNull()
    zero = F.lit(0).cast("bigint")
    return events.groupBy(*(PROFILE_KEYS if keys is None else keys)).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("delivered").alias("flagged"),
        F.coalesce(F.sum(flag), zero).alias("successes"),
        F.count("age_days").alias("aged_n"),
        F.coalesce(F.sum(F.when(aged, flag)), zero).alias("aged_successes"),
        F.sum(clamp_age(F.col("age_days"))).alias("aged_days"),
    )


def roll_up(profile: DataFrame, *keys: str) -> DataFrame:
    """The profile with fewer keys."""
    return profile.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in _MEASURES])


def rank_profile(profile: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """System ranking from a profile; see :func:`system_ranking`."""
    successes, n = F.col("aged_successes"), F.col("aged_n")
    mean = posterior_mean(successes, n, params.prior_alpha, params.prior_beta)
    return (
        roll_up(profile.where(F.col("id_sistema_mask").isNotNull()), "id_sistema_mask")
        .where(n > 0)
        .select(
            "id_sistema_mask",
            n.alias("n"),
            successes.alias("successes"),
            (F.col("aged_days") / n).alias("mean_age_days"),
            mean.alias("posterior_mean"),
            (mean * volume_shrinkage(n, params.volume_k)).alias("score"),
        )
    )


def system_ranking(
    events: DataFrame,
    params: ScoreParams = ScoreParams(),
    system_col: str = "id_sistema_mask",
    delivered_col: str = "delivered",
    age_col: str = "age_days",
) -> DataFrame:
    """Systems by score, best first: smoothed delivery rate, pulled down where volume is low.

    Counts only events with a known age; negative ages enter the mean as 0.
    """
    named = events.select(
        F.col(system_col).alias("id_sistema_mask"),
        F.col(delivered_col).alias("delivered"),
        F.col(age_col).alias("age_days"),
    )
    ranked = rank_profile(event_profile(named, ["id_sistema_mask"]), params)
    return ranked.orderBy(F.desc("score"), "id_sistema_mask").withColumnRenamed(
        "id_sistema_mask", system_col
    )


def area_rates_of_profile(profile: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """Rate per area code from a profile; see :func:`area_rates`."""
    return (
        roll_up(profile.where(F.col("telefone_ddd").isNotNull()), "telefone_ddd")
        .where(F.col("n") >= params.area_min_n)
        .select("telefone_ddd", "n", F.try_divide("successes", "flagged").alias("rate"))
    )


def area_rates(events: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """Delivery rate per area code with enough events. Unknown outcomes count in ``n`` only."""
    rates = area_rates_of_profile(event_profile(events, ["telefone_ddd"]), params)
    return rates.orderBy(F.desc("rate"), "telefone_ddd")


def _nearest_rank(ladder: str, share: float):
    """Element of an ascending array at the rank nearest to ``share``; null if it is empty."""
    steps = F.size(ladder) - 1
    place = F.floor(steps * F.lit(share) + 0.5).cast("int") + 1
    return F.when(steps >= 0, F.element_at(ladder, place))


def area_quantiles(rates: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """The low and high nearest-rank quantiles of the area rates, 0 without any area."""
    return rates.agg(F.sort_array(F.collect_list("rate")).alias("ladder")).select(
        F.coalesce(_nearest_rank("ladder", params.area_low), F.lit(0.0)).alias("q_low"),
        F.coalesce(_nearest_rank("ladder", params.area_high), F.lit(0.0)).alias("q_high"),
    )


def area_bonus(rates: DataFrame, params: ScoreParams = ScoreParams()) -> DataFrame:
    """Bonus of the best and malus of the worst area codes; the others are left out.

    Area codes are a short fixed list (two digits), so their table fits one row.
    """
    rate = F.col("area.rate")
    bonus = F.when(rate >= F.col("q_high"), F.lit(params.area_bonus)).when(
        rate <= F.col("q_low"), F.lit(-params.area_bonus)
    )
    return (
        rates.agg(
            F.sort_array(F.collect_list("rate")).alias("ladder"),
            F.collect_list(F.struct("telefone_ddd", "rate")).alias("areas"),
        )
        .select(
            F.explode("areas").alias("area"),
            _nearest_rank("ladder", params.area_low).alias("q_low"),
            _nearest_rank("ladder", params.area_high).alias("q_high"),
        )
        .select("area.telefone_ddd", bonus.alias("ddd_bonus"))
        .where(F.col("ddd_bonus").isNotNull())
    )


def baseline_rate(events: DataFrame) -> DataFrame:
    """Mean of the success flag over all events with a known outcome."""
    return events.agg(F.avg("delivered").alias("baseline_p"))
