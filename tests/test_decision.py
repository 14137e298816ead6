"""The decision after the experiment: test, sequential looks, opt-outs, resampling by person."""

import math
import random
from datetime import date, timedelta
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from dialwise.functions import two_proportion_z, upper_tail
from dialwise.operators import experiment as ex

TRIES = "arm string, cpf long, envio_data date, delivered int"
DAY = date(2024, 1, 1)


def test_upper_tail_matches_the_normal_distribution(spark):
    points = [-40.0, -9.0, -7.2, -3.0, -0.1, 0.0, 0.5, 1.6448536269514722, 4.0, 7.05, 7.1, 9.5, 20.0]
    rows = spark.createDataFrame([(z,) for z in points], "z double")
    rows = rows.select("z", upper_tail(F.col("z")).alias("p"))
    for z, p in rows.collect():
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9, abs=1e-300)
    assert spark.createDataFrame([(None,)], "z double").select(upper_tail(F.col("z"))).first()[0] is None


def test_two_proportions(spark):
    row = spark.range(1).select(two_proportion_z(*[F.lit(x) for x in (60, 100, 40, 100)]).alias("z")).first()
    assert row["z"] == pytest.approx(0.2 / math.sqrt(0.25 * 0.02))
    for counts in ((0, 0, 4, 9), (0, 5, 0, 9), (5, 5, 9, 9)):
        assert spark.range(1).select(two_proportion_z(*[F.lit(x) for x in counts])).first()[0] is None


def primary(spark, rows):
    return spark.createDataFrame(rows, "arm string, pessoas long, alcancados long")


def test_only_a_better_treatment_rejects(spark):
    better = ex.primary_test(primary(spark, [(ex.CONTROL, 1000, 900), (ex.TREATMENT, 1000, 930)])).first()
    assert better["rejects"] and better["diff"] == pytest.approx(0.03)
    z = 0.03 / math.sqrt(0.915 * 0.085 * 0.002)
    assert better["z"] == pytest.approx(z) and better["p_value"] == pytest.approx(NormalDist().cdf(-z))
    worse = ex.primary_test(primary(spark, [(ex.CONTROL, 1000, 930), (ex.TREATMENT, 1000, 900)])).first()
    assert not worse["rejects"] and worse["p_value"] > 0.99
    for rows in ([], [(ex.CONTROL, 10, 5)], [(ex.CONTROL, 10, 10), (ex.TREATMENT, 9, 9)]):
        nothing = ex.primary_test(primary(spark, rows)).first()
        assert nothing["p_value"] is None and nothing["rejects"] is False


def test_a_person_counts_from_the_first_attempt_and_the_first_delivery(spark):
    rows = [
        ("tratamento", 1, DAY, 0), ("tratamento", 1, DAY + timedelta(2), 1), ("tratamento", 1, DAY + timedelta(3), 1),
        ("tratamento", 2, DAY + timedelta(1), 1), ("controle", 3, DAY, 1), ("controle", 4, DAY + timedelta(2), None),
        ("controle", 5, None, 1),
    ]
    looks = ex.sequential_monitor(spark.createDataFrame(rows, TRIES), 100).orderBy("envio_data").collect()
    got = [(r["pessoas_c"], r["alcancados_c"], r["pessoas_t"], r["alcancados_t"]) for r in looks]
    assert got == [(1, 1, 1, 0), (1, 1, 2, 1), (2, 1, 2, 2)]
    assert ex.sequential_monitor(spark.createDataFrame([], TRIES), 100).count() == 0


def test_daily_looks_keep_the_level_and_find_a_difference(spark):
    """Experiments without a difference, each looked at on 40 days, hardly ever cross the bound."""
    rng = random.Random(11)

    def tries(lift, seeds):
        rows = []
        for seed in seeds:
            for i in range(1200):
                arm = (ex.CONTROL, ex.TREATMENT)[i % 2]
                p = 0.5 + (lift if i % 2 else 0)
                rows.append((seed, arm, i, DAY + timedelta(i // 30), int(rng.random() < p)))
        return rows

    def crossed(rows, seeds):
        frame = spark.createDataFrame(rows, f"seed int, {TRIES}").cache()
        stops = 0
        for seed in seeds:
            looks = ex.sequential_monitor(frame.where(F.col("seed") == seed).drop("seed"), 1200)
            stops += looks.agg(F.max("stop")).first()[0]
        return stops

    assert crossed(tries(0.0, range(8)), range(8)) <= 1
    assert crossed(tries(0.25, range(2)), range(2)) == 2


def test_opt_outs_count_people_once(spark):
    rows = [("controle", 1, DAY, 1), ("controle", 1, DAY + timedelta(1), 1), ("controle", 2, DAY, 0),
            ("tratamento", 3, DAY, 1), ("tratamento", 4, None, 1), ("tratamento", None, DAY, 1)]
    said = [(1, DAY + timedelta(3)), (1, DAY + timedelta(4)), (2, DAY - timedelta(1)), (3, DAY + timedelta(40)),
            (4, DAY), (None, DAY), (9, DAY), (3, None)]
    left = ex.opt_outs(spark.createDataFrame(rows, TRIES), spark.createDataFrame(said, "cpf long, dia date"))
    got = {r["arm"]: (r["pessoas"], r["saidas"], r["taxa_saidas"]) for r in left.collect()}
    assert got == {"controle": (2, 1, 0.5), "tratamento": (2, 0, 0.0)}


def clusters(rng, spark, people=400):
    """People with their own rate and 1 to 20 dispatches: rows of a person depend on each other."""
    rows = []
    for person in range(people):
        rate = rng.choice([0.1, 0.9])
        arm = (ex.CONTROL, ex.TREATMENT)[person % 2]
        rows += [(person, arm, int(rng.random() < rate)) for _ in range(rng.randrange(1, 21))]
    return spark.createDataFrame(rows, "unit long, arm string, y int")


def test_intervals_by_person_cover_where_those_by_dispatch_do_not(spark):
    rng = random.Random(21)
    covered = naive = 0
    for seed in range(5):
        units = clusters(rng, spark)
        row = ex.clustered_rate_diff(units, n_boot=200, seed=seed).first()
        covered += row["ci_low"] <= 0 <= row["ci_high"]
        by_row = units.withColumn("unit", F.monotonically_increasing_id())
        wrong = ex.bootstrap_rate_diff(by_row, n_boot=200, seed=seed).first()
        naive += wrong["ci_low"] <= 0 <= wrong["ci_high"]
        assert row["ci_high"] - row["ci_low"] > 1.8 * (wrong["ci_high"] - wrong["ci_low"])
    assert covered >= 4 and covered >= naive


def test_resampling_without_an_arm_or_rows_gives_nan(spark):
    units = spark.createDataFrame([(1, ex.CONTROL, 1), (2, ex.CONTROL, 0)], "unit long, arm string, y int")
    for rows in (units, units.limit(0)):
        row = ex.clustered_rate_diff(rows, n_boot=20).first()
        assert all(math.isnan(x) for x in row)
