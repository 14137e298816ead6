import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dialwise.functions import (
    age_bucket,
    age_bucket_order,
    clamp_age,
    delivered_flag,
    error_extents,
    poisson_one,
    posterior_mean,
    recency_weight,
    sample_size,
    uniform,
    volume_shrinkage,
    whole_days_between,
    wilson_bounds,
)


def column(spark, values, kind, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("x"))).collect()]


def test_delivered_flag(spark):
    values = ["delivered", "READ", "Read", "failed", None, ""]
    assert column(spark, values, "string", delivered_flag) == [1, 1, 1, 0, None, 0]


def wilson(spark, pairs):
    frame = spark.createDataFrame(pairs, "s bigint, n bigint")
    low, high = wilson_bounds(F.col("s"), F.col("n"))
    return [tuple(r) for r in frame.select(low, high).collect()]


def test_wilson_bounds(spark):
    pairs = [(0, 10), (10, 10), (5, 10), (1, 1_000_000)]
    found = wilson(spark, pairs)
    for (s, n), (low, high) in zip(pairs, found):
        assert 0.0 <= low <= s / n + 1e-12 and s / n - 1e-12 <= high <= 1.0
    # The bounds are the rates from which the observed one is exactly z standard errors away.
    z = 1.959963984540054
    for (s, n), bounds in zip(pairs[2:], found[2:]):
        for bound in bounds:
            assert abs(s / n - bound) == pytest.approx(z * math.sqrt(bound * (1 - bound) / n))
    assert found[0][1] == pytest.approx(z**2 / (10 + z**2))
    nothing = wilson(spark, [(0, 0), (3, -1)])
    assert all(math.isnan(x) for pair in nothing for x in pair)


def test_error_extents_are_never_negative(spark):
    rows = [(0.5, 0.4, 0.7), (0.5, 0.6, 0.4), (float("nan"), 0.1, 0.2), (None, 0.1, 0.2)]
    frame = spark.createDataFrame(rows, "r double, l double, h double")
    low, high = error_extents(F.col("r"), F.col("l"), F.col("h"))
    found = [tuple(round(x, 9) for x in r) for r in frame.select(low, high).collect()]
    assert found == [(0.1, 0.2), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_age_buckets_are_closed_on_the_right(spark):
    ages = [0.0, 7.0, 7.5, 30.0, 90.0, 180.0, 365.0, 730.0, 731.0, None]
    labels = ["0_7", "0_7", "7_30", "7_30", "30_90", "90_180", "180_365", "365_730", "730_plus"]
    assert column(spark, ages, "double", age_bucket) == [*labels, None]
    orders = [0, 0, 1, 1, 2, 3, 4, 5, 6, None]
    assert column(spark, ages, "double", age_bucket_order) == orders


def test_clamp_age(spark):
    assert column(spark, [-3.0, 0.0, 4.5, None], "double", clamp_age) == [0.0, 0.0, 4.5, None]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_whole_days_are_cut_toward_zero(spark, zone):
    now = F.lit("2018-12-07 12:00:00").cast("timestamp_ntz")
    moments = [
        datetime(2018, 12, 1, 0),
        datetime(2018, 12, 7, 0),
        datetime(2018, 12, 9, 0),
        datetime(2018, 11, 3, 12),
        None,
    ]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        days = column(spark, moments, "timestamp_ntz", lambda c: whole_days_between(c, now))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert days == [6, 0, -1, 34, None]


def test_weights(spark):
    halves = column(spark, [0.0, 365.0, 730.0, -365.0], "double", recency_weight)
    assert halves == pytest.approx([1.0, 0.5, 0.25, 2.0])
    frame = spark.createDataFrame([(8, 10)], "s bigint, n bigint")
    row = frame.select(
        posterior_mean(F.col("s"), F.col("n")), volume_shrinkage(F.col("n"), 500)
    ).first()
    assert tuple(row) == pytest.approx((10 / 14, 10 / 510))


def test_sample_size(spark):
    rows = [(0.9085, 0.9185), (0.0, 0.5), (0.5, 1.0), (0.5, 0.5), (None, 0.5)]
    frame = spark.createDataFrame(rows, "c double, t double")
    found = [r[0] for r in frame.select(sample_size(F.col("c"), F.col("t"))).collect()]
    assert found == [9770, 0, 0, None, None]


def test_uniform_is_repeatable_and_even(spark):
    ids = spark.range(20_000)
    u = uniform(7, F.col("id"))
    one = ids.select("id", u.alias("u"))
    assert one.exceptAll(ids.repartition(5).select("id", u.alias("u"))).isEmpty()
    mean, low, high = one.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(mean - 0.5) < 0.01 and 0.0 <= low < 0.01 and 0.99 < high < 1.0


def test_poisson_one(spark):
    counts = spark.range(50_000).select(poisson_one(uniform(1, F.col("id"))).alias("k"))
    mean, spread, none = counts.agg(
        F.avg("k"), F.var_pop("k"), F.avg((F.col("k") == 0).cast("int"))
    ).first()
    assert abs(mean - 1) < 0.02 and abs(spread - 1) < 0.04 and abs(none - math.exp(-1)) < 0.01
