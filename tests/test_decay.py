import math
import random

import pytest
from pyspark.sql import functions as F

from dialwise.operators import decay as dc
from dialwise.operators.rates import aged_events

BIN = "bin int, age_days double, n bigint, successes bigint, p double"


def logit_bins(spark, const, slope, noise=0.0, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(50):
        age = 40.0 * i
        p = 1 / (1 + math.exp(-(const + slope * age + rng.gauss(0, noise))))
        rows.append((i, age, 1000 + 13 * i, 0, p))
    return spark.createDataFrame(rows, BIN)


def events(spark, rows):
    return spark.createDataFrame(rows, "age_days double, delivered int")


def test_fit_recovers_a_known_decay(spark):
    fit = dc.decay_fit(logit_bins(spark, 2.0, -0.0014), ridge=0.0)
    row = dc.half_life(fit).first()
    assert row["b_per_day"] == pytest.approx(-0.0014, abs=1e-12)
    assert row["half_life_odds"] == pytest.approx(495.105, abs=1e-3)
    assert row["half_life_days"] == row["half_life_odds"]


def test_fit_agrees_with_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    bins = logit_bins(spark, 1.0, -0.001, noise=0.3)
    scaled = dc.decay_bins_scaled(bins)
    points = VectorAssembler(inputCols=["age_scaled"], outputCol="features").transform(scaled)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="p", weightCol="n", regParam=0.0, tol=1e-12
    ).fit(points)
    row = dc.decay_fit(bins, ridge=0.0).first()
    assert row["const"] == pytest.approx(model.intercept, rel=1e-8)
    assert row["age_scaled"] == pytest.approx(model.coefficients[0], rel=1e-8)


def test_ridge_solves_the_penalised_problem(spark):
    bins = logit_bins(spark, 1.0, -0.001, noise=0.3)
    ridge = 25.0
    row = dc.decay_fit(bins, ridge=ridge).first()
    points = dc.decay_bins_scaled(bins).collect()
    for name, factor in (("const", lambda p: 1.0), ("age_scaled", lambda p: p["age_scaled"])):
        pull = sum(
            p["n"]
            * (p["p"] - 1 / (1 + math.exp(-(row["const"] + row["age_scaled"] * p["age_scaled"]))))
            * factor(p)
            for p in points
        )
        assert pull / len(points) == pytest.approx(ridge * row[name], rel=1e-8)
    free = dc.decay_fit(bins, ridge=0.0).first()
    assert abs(row["age_scaled"]) < abs(free["age_scaled"])


def test_no_decay_means_an_infinite_half_life_and_the_fallback(spark):
    row = dc.half_life(dc.decay_fit(logit_bins(spark, 0.0, 0.001))).first()
    assert math.isinf(row["half_life_odds"]) and row["half_life_days"] == 365.0
    none = dc.half_life(dc.decay_fit(spark.createDataFrame([], BIN)), 400.0).first()
    assert none["half_life_days"] == 400.0


def bins_by_hand(rows, bins=50):
    ages = sorted(a for a, _ in rows)
    edges = []
    for i in range(1, bins):
        place = (len(ages) - 1) * (i / bins)
        low = math.floor(place)
        high = min(low + 1, len(ages) - 1)
        edge = ages[low] + (ages[high] - ages[low]) * (place - low)
        if edge not in edges:
            edges.append(edge)
    groups = {}
    for age, flag in rows:
        groups.setdefault(sum(e < age for e in edges), []).append((age, flag))
    return {
        b: (sum(a for a, _ in g) / len(g), len(g), sum(f for _, f in g)) for b, g in groups.items()
    }


@pytest.mark.parametrize("spread", [3, 40, 2500])
def test_bins_agree_with_binning_row_by_row(spark, spread):
    rng = random.Random(spread)
    rows = [(float(rng.randrange(spread)), rng.randrange(2)) for _ in range(700)]
    clipped = [(min(a, 2000.0), f) for a, f in rows]
    unknown = [(5.0, None), (None, 1)]
    found = dc.decay_bins(aged_events(events(spark, rows + unknown))).collect()
    want = bins_by_hand(clipped)
    assert {r["bin"] for r in found} == set(want)
    for row in found:
        mean, n, s = want[row["bin"]]
        assert (row["n"], row["successes"]) == (n, s)
        assert row["age_days"] == pytest.approx(mean)
        assert row["p"] == pytest.approx((s + 0.5) / (n + 1))


def test_histogram_is_at_most_one_row_per_day(spark):
    frame = spark.range(50_000).select(
        (F.col("id") % 9000).cast("double").alias("age_days"), F.lit(1).alias("delivered")
    )
    assert dc.decay_histogram(frame).count() == 2001


def test_scaled_bins_have_mean_zero_and_unit_spread(spark):
    scaled = dc.decay_bins_scaled(logit_bins(spark, 1.0, -0.001))
    mean, spread = scaled.agg(F.avg("age_scaled"), F.stddev_pop("age_scaled")).first()
    assert mean == pytest.approx(0, abs=1e-12) and spread == pytest.approx(1)
    one = dc.decay_bins_scaled(logit_bins(spark, 1.0, -0.001).limit(1)).first()
    assert one["age_scaled"] == 0.0


def test_a_fit_that_did_not_converge_has_no_half_life(spark):
    fit = spark.createDataFrame(
        [(0.1, -0.5, 100.0, 50.0, 1e-9), (0.1, -0.5, 100.0, 50.0, 3.0), (None, None, None, None, None)],
        "const double, age_scaled double, age_mean double, age_std double, last_step double",
    )
    good, bad, none = dc.half_life(fit).collect()
    assert good["half_life_days"] == good["half_life_odds"] > 0
    assert bad["half_life_days"] is None and bad["half_life_odds"] is None
    assert none["half_life_days"] == 365.0
