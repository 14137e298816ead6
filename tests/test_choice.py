"""The whole way on small data, by hand."""

import math
from datetime import datetime, timedelta

import pytest
from frames import appearances, dispatch
from pyspark.sql import functions as F

from dialwise.operators.appearances import candidates
from dialwise.operators.attribution import attribute_system
from dialwise.operators.ranking import ScoreParams, area_bonus, area_rates, system_ranking
from dialwise.operators.scoring import score_phones
from dialwise.plans.choice import (
    choose_phones,
    experiment_picks,
    fitted_half_life,
    learned_tables,
)

NOW = datetime(2024, 6, 1)


def small_world(spark):
    """System 1 delivers always, system 2 half the time, system 3 never."""
    sent, listed = [], []
    for phone in range(60):
        system = phone % 3 + 1
        owner = phone // 3
        listed.append((phone, str(11 + phone % 2), system, datetime(2024, 1, 1), owner))
        for attempt in range(10):
            works = system == 1 or (system == 2 and attempt % 2 == 0)
            sent.append(
                (
                    phone * 100 + attempt,
                    owner,
                    phone,
                    datetime(2024, 2, 1) + timedelta(days=attempt),
                    "delivered" if works else "failed",
                )
            )
    return dispatch(spark, sent), appearances(spark, listed)


def test_better_systems_are_chosen(spark):
    sent, listed = small_world(spark)
    top = choose_phones(sent, listed, NOW)
    found = {}
    for row in top.collect():
        found.setdefault(row["cpf"], {})[row["rank"]] = row["id_sistema_mask"]
    assert found == {owner: {1: 1, 2: 2} for owner in range(20)}
    everything = choose_phones(sent, listed, NOW, top=None)
    assert everything.count() == 60 and everything.where("rank = 3").count() == 20


def test_learned_tables_are_those_of_the_single_operators(spark):
    sent, listed = small_world(spark)
    events = attribute_system(sent, listed)
    params = ScoreParams(area_min_n=1)
    ranking, bonus = learned_tables(events, params)
    for small, plain in (
        (ranking, system_ranking(events, params)),
        (bonus, area_bonus(area_rates(events, params), params)),
    ):
        assert small.count() > 0
        assert small.exceptAll(plain).isEmpty() and plain.exceptAll(small).isEmpty()


def test_result_of_scoring_one_person_is_that_of_scoring_all(spark):
    sent, listed = small_world(spark)
    ranking, bonus = learned_tables(attribute_system(sent, listed))
    rows = candidates(listed)
    everyone = score_phones(rows, ranking, NOW, bonus=bonus)
    one = score_phones(rows.where("cpf = 7"), ranking, NOW, bonus=bonus)
    assert everyone.where("cpf = 7").exceptAll(one).isEmpty() and one.count() == 3


def test_half_life_flows_from_the_fit(spark):
    sent, listed = small_world(spark)
    def value(events):
        return spark.range(1).select(fitted_half_life(events)).first()[0]

    assert value(attribute_system(sent, listed).limit(0)) == 365.0
    ages = spark.range(0, 400_000).select(
        F.col("id"), (F.col("id") % 1500).cast("double").alias("age_days")
    )
    chance = 1 / (1 + F.exp(-(2.0 - 0.002 * F.col("age_days"))))
    decaying = ages.withColumn("delivered", (F.rand(5) < chance).cast("int"))
    found = value(decaying)
    assert found == pytest.approx(math.log(2) / 0.002, rel=0.05)


def test_experiment_picks(spark):
    sent, listed = small_world(spark)
    ranking, bonus = learned_tables(attribute_system(sent, listed))
    picks = experiment_picks(candidates(listed), ranking, NOW, bonus=bonus)
    rows = picks.collect()
    assert len(rows) == 40 and {r["rank"] for r in rows} == {1, 2}
    arms = {}
    for row in rows:
        arms.setdefault(row["cpf"], set()).add(row["arm"])
    assert all(len(a) == 1 for a in arms.values()) and len(arms) == 20
    treated = [r for r in rows if r["arm"] == "tratamento"]
    assert {r["telefone"] % 3 + 1 for r in treated} == {1, 2}
