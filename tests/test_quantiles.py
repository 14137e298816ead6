import random

import pytest
from pyspark.sql import functions as F

from dialwise.operators import quantiles as qt

POINTS = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]


def by_hand(values, q):
    values = sorted(values)
    place = (len(values) - 1) * q
    low = int(place)
    high = min(low + (place > low), len(values) - 1)
    return values[low] * (1 - (place - low)) + values[high] * (place - low)


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_points_of_groups_match_sorting(spark, bits):
    rng = random.Random(bits)
    rows = [(g, rng.randrange(-(10 ** rng.randrange(1, 15)), 10**6)) for g in ("a", "b", None) for _ in range(300)]
    rows += [("one", 7), ("nulls", None), ("same", 3), ("same", 3), ("ends", 2**53), ("ends", -(2**53))]
    table = spark.createDataFrame(rows, "g string, v long")
    got = {r["g"]: r for r in qt.exact_quantiles(table, ["g"], "v", POINTS, bits=bits).collect()}
    assert set(got) == {"a", "b", None, "one", "same", "ends"}
    for g, row in got.items():
        values = [v for k, v in rows if k == g]
        assert row["size"] == len(values)
        assert row["quantiles"] == pytest.approx([by_hand(values, q) for q in POINTS], rel=1e-12)


def test_same_as_the_built_in_and_counts(spark):
    table = spark.range(40_000).selectExpr("id % 3 AS g", "id % 2 AS h", "id * id % 9973 - 5000 AS v", "id % 4 AS n")
    want = table.groupBy("g", "h").agg(
        F.percentile("v", F.array(*[F.lit(q) for q in POINTS]), F.col("n")).alias("q"), F.sum("n").alias("s")
    )
    got = qt.exact_quantiles(table, ["g", "h"], "v", POINTS, count="n")
    found = {(r["g"], r["h"]): [r["size"], *r["quantiles"]] for r in got.collect()}
    want = {(r["g"], r["h"]): [r["s"], *r["q"]] for r in want.collect()}
    assert set(found) == set(want) and len(found) == 6
    for group, points in want.items():
        assert found[group] == pytest.approx(points)


def test_without_keys_without_rows_and_wrong_points(spark):
    rows = spark.createDataFrame([(5,), (None,), (1,), (9,)], "v long")
    row = qt.exact_quantiles(rows, [], "v", [0.5]).first()
    assert (row["size"], row["quantiles"]) == (3, [5.0])
    assert qt.exact_quantiles(rows.limit(0), [], "v", [0.5]).count() == 0
    for points in ([], [1.5], [-0.1]):
        with pytest.raises(ValueError):
            qt.exact_quantiles(rows, [], "v", points)


def test_no_task_holds_more_than_a_level(spark):
    """A group of 200,000 different values: the widest window partition is one level of digits."""
    held = []
    real = qt.frozen
    try:
        qt.frozen = lambda df, stem: held.append((stem, real(df, stem))) or held[-1][1]
        rows = spark.range(200_000).selectExpr("id * 1000003 AS v")
        row = qt.exact_quantiles(rows, [], "v", [0.25, 0.75], bits=8).first()
    finally:
        qt.frozen = real
    assert row["quantiles"] == [1000003 * 49_999.75, 1000003 * 149_999.25]
    counted = held[0][1]
    assert counted.count() == 200_000 and len(held) == 9
    for _, ranks in held[1:]:
        assert ranks.count() <= 4
    level = counted.groupBy(F.shiftrightunsigned("v", 56)).count()
    assert level.count() <= 256
