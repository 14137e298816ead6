"""The whole way from dispatch log and phone dimension to the phones to message."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.operators.appearances import candidates
from dialwise.operators.attribution import attribute_system
from dialwise.operators.decay import decay_bins, decay_fit, half_life
from dialwise.operators.experiment import CONTROL, TREATMENT, arm_of, random_phones
from dialwise.operators.ranking import (
    ScoreParams,
    area_bonus,
    area_rates_of_profile,
    event_profile,
    rank_profile,
)
from dialwise.operators.rates import aged_events
from dialwise.operators.scoring import score_phones
from dialwise.session import frozen


def learned_tables(
    events: DataFrame, params: ScoreParams = ScoreParams()
) -> tuple[DataFrame, DataFrame]:
    """System ranking and area bonus, both from one pass over the events.

    The profile (systems x area codes) is frozen, so neither table runs the attribution again.
    """
    profile = frozen(event_profile(events))
    ranking = rank_profile(profile, params)
    return ranking, area_bonus(area_rates_of_profile(profile, params), params)


def fitted_half_life(events: DataFrame, fallback_days: float = 365.0) -> Column:
    """The half-life to score with, fitted to the events: a scalar subquery, so no job runs here."""
    fit = decay_fit(decay_bins(aged_events(events)))
    return half_life(fit, fallback_days).select("half_life_days").scalar()


def choose_phones(
    dispatch: DataFrame,
    appearances: DataFrame,
    now: datetime,
    params: ScoreParams = ScoreParams(),
    top: int | None = 2,
) -> DataFrame:
    """The ``top`` best phones of every person: attribute, learn, score, rank."""
    events = attribute_system(dispatch, appearances, attributes=["telefone_ddd"])
    ranking, bonus = learned_tables(events, params)
    return score_phones(candidates(appearances), ranking, now, params, bonus, top=top)


def experiment_picks(
    candidate_rows: DataFrame,
    ranking: DataFrame,
    now: datetime,
    params: ScoreParams = ScoreParams(),
    bonus: DataFrame | None = None,
    k: int = 2,
    seed: int = 42,
) -> DataFrame:
    """The phones each arm sends to: by chance for control, by score for treatment."""
    arm = arm_of(F.col("cpf"), seed)
    by_chance = random_phones(candidate_rows.where(arm == CONTROL), k, seed)
    by_score = score_phones(
        candidate_rows.where(arm == TREATMENT), ranking, now, params, bonus, top=k
    )
    columns = ["arm", "cpf", "telefone", "rank"]
    return (
        by_chance.withColumn("arm", F.lit(CONTROL))
        .select(*columns)
        .unionByName(by_score.withColumn("arm", F.lit(TREATMENT)).select(*columns))
    )
