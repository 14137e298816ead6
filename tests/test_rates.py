import pytest
from pyspark.sql import functions as F

from dialwise.operators import ranking as rk
from dialwise.operators import rates as rt
from dialwise.operators.experiment import baseline_segments, with_sample_size

EVENT = (
    "id_sistema_mask bigint, contato_telefone bigint, telefone_ddd string, age_days double,"
    " delivered int"
)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def test_unknown_outcomes_count_as_attempts(spark):
    rows = [(1, 10, "21", 0.0, 1), (1, 10, "21", 0.0, None), (2, 10, "21", 0.0, None)]
    rates = by_key(rt.rates_by_system(events(spark, rows)), "id_sistema_mask")
    assert (rates[1]["n"], rates[1]["rate"]) == (2, 0.5)
    assert (rates[2]["n"], rates[2]["rate"], rates[2]["ci_low"]) == (1, 0.0, 0.0)
    assert rt.rates_by_system(events(spark, rows)).columns == [
        "id_sistema_mask",
        "n",
        "rate",
        "ci_low",
        "ci_high",
    ]


def test_rate_and_mean_have_different_denominators(spark):
    rows = [(1, 10, "21", 0.0, 1), (1, 10, "21", 0.0, None), (1, 10, "21", 0.0, 0)]
    frame = events(spark, rows)
    params = rk.ScoreParams(area_min_n=1)
    area = rk.area_rates(frame, params).first()
    assert (area["n"], area["rate"]) == (3, 0.5)
    assert rk.baseline_rate(frame).first()[0] == 0.5
    assert rt.rates_by_system(frame).first()["rate"] == pytest.approx(1 / 3)


def test_rates_are_sorted_by_rate_then_volume(spark):
    rows = [(1, 1, "21", 0.0, 1)] + [(2, 1, "21", 0.0, 1)] * 2 + [(3, 1, "21", 0.0, 0)] * 5
    found = [r["id_sistema_mask"] for r in rt.rates_by_system(events(spark, rows)).collect()]
    assert found == [2, 1, 3]


def test_multi_system_rates_equal_the_plain_join(spark):
    rows = [(s, p, "21", 0.0, ((s or 5) + p) % 2) for s in (1, 2, None) for p in range(6)] * 3
    # Phone 3 is listed twice, so a join counts its events twice.
    dim = spark.createDataFrame(
        [(0, 1), (1, 2), (2, 5), (3, 2), (3, 4), (4, None)],
        "telefone_numero bigint, telefone_sistemas_quantidade bigint",
    )
    frame = events(spark, rows)
    joined = frame.join(dim, F.col("contato_telefone") == F.col("telefone_numero"), "left")
    plain = rt.rate_with_interval(
        joined.where("telefone_sistemas_quantidade >= 2"), ["id_sistema_mask"]
    )
    multi = rt.rates_by_system_multi(frame, dim)
    assert multi.exceptAll(plain).isEmpty() and plain.exceptAll(multi).isEmpty()
    both = by_key(rt.rates_by_system_compared(frame, dim), "id_sistema_mask")
    alone = by_key(rt.rates_by_system(frame), "id_sistema_mask")
    beside = by_key(multi, "id_sistema_mask")
    assert set(both) == {1, 2}
    for system, row in both.items():
        assert (row["n"], row["rate"], row["ci_low"]) == tuple(alone[system][1:4])
        assert (row["n_multi"], row["rate_multi"], row["ci_low_multi"]) == tuple(
            beside[system][1:4]
        )
    single = by_key(
        rt.rates_by_system_compared(frame, dim.where("telefone_numero = 0")), "id_sistema_mask"
    )
    assert single[1]["n_multi"] is None and single[1]["ci_high_multi"] is None


def test_rates_by_age_clamps_and_orders(spark):
    rows = [(1, 1, "21", a, 1) for a in (-5.0, 3.0, 8.0, 731.0, None)]
    found = [(r["age_bucket"], r["n"]) for r in rt.rates_by_age(events(spark, rows)).collect()]
    assert found == [("0_7", 2), ("7_30", 1), ("730_plus", 1)]


def test_system_ranking(spark):
    rows = (
        [(1, 1, "21", 10.0, 1)] * 8
        + [(1, 1, "21", -10.0, 0)] * 2
        + [(2, 1, "21", 4.0, 1)]
        + [(1, 1, "21", None, 1), (None, 1, "21", 1.0, 1), (3, 1, "21", None, 1)]
    )
    ranking = rk.system_ranking(events(spark, rows)).collect()
    assert [r["id_sistema_mask"] for r in ranking] == [1, 2]
    first = ranking[0]
    assert (first["n"], first["successes"], first["mean_age_days"]) == (10, 8, 8.0)
    assert first["posterior_mean"] == pytest.approx(10 / 14)
    assert first["score"] == pytest.approx(10 / 14 * 10 / 510)
    scores = [r["score"] for r in ranking]
    assert scores == sorted(scores, reverse=True)


def test_system_ranking_with_other_column_names(spark):
    frame = events(spark, [(1, 1, "21", 1.0, 1)]).withColumnsRenamed(
        {"id_sistema_mask": "fonte", "delivered": "ok", "age_days": "idade"}
    )
    row = rk.system_ranking(
        frame, system_col="fonte", delivered_col="ok", age_col="idade"
    ).first()
    assert row["fonte"] == 1 and row["n"] == 1


def area_table(spark, rates):
    rows = [(f"{i:02d}", 500, r) for i, r in enumerate(rates)]
    return spark.createDataFrame(rows, "telefone_ddd string, n bigint, rate double")


@pytest.mark.parametrize(
    "rates,low,high",
    [
        ([], 0.0, 0.0),
        ([0.3], 0.3, 0.3),
        ([0.1, 0.2], 0.1, 0.2),
        ([0.3, 0.1, 0.2], 0.1, 0.3),
        ([0.1, 0.2, 0.3, 0.4], 0.2, 0.3),
        ([0.1, 0.2, 0.3, 0.4, 0.5], 0.2, 0.4),
        ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 0.2, 0.5),
    ],
)
def test_nearest_rank_quantiles(spark, rates, low, high):
    assert tuple(rk.area_quantiles(area_table(spark, rates)).first()) == (low, high)


def test_area_bonus(spark):
    def bonus(rates):
        found = rk.area_bonus(area_table(spark, rates)).collect()
        return {r["telefone_ddd"]: r["ddd_bonus"] for r in found}

    assert bonus([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) == {
        "00": -0.05,
        "01": -0.05,
        "04": 0.05,
        "05": 0.05,
    }
    assert bonus([0.4, 0.4, 0.4]) == {"00": 0.05, "01": 0.05, "02": 0.05}
    assert bonus([]) == {}


def test_area_rates_need_volume(spark):
    rows = [(1, 1, "21", 0.0, 1)] * 200 + [(1, 1, "11", 0.0, 1)] * 199 + [(1, 1, None, 0.0, 1)] * 300
    assert [r["telefone_ddd"] for r in rk.area_rates(events(spark, rows)).collect()] == ["21"]


def test_profile_gives_the_same_tables_as_the_events(spark):
    rows = [
        (s, 1, d, a, f)
        for s in (1, 2, None)
        for d in ("21", "11", None)
        for a in (-1.0, 5.0, None)
        for f in (0, 1, None)
    ]
    frame = events(spark, rows)
    profile = rk.event_profile(frame)
    params = rk.ScoreParams(area_min_n=1)
    for small, large in (
        (rk.rank_profile(profile), rk.system_ranking(frame)),
        (rk.area_rates_of_profile(profile, params), rk.area_rates(frame, params)),
    ):
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_sample_sizes_per_segment(spark):
    rows = [(1, 1, "21", 0.0, 1)] * 9 + [(1, 1, "21", 0.0, 0)] + [(2, 1, "11", 0.0, None)]
    plan = with_sample_size(baseline_segments(rk.event_profile(events(spark, rows))))
    found = {(r["segmento"], r["valor"]): r for r in plan.collect()}
    assert set(found) == {
        ("todos", "todos"),
        ("sistema", "1"),
        ("sistema", "2"),
        ("ddd", "21"),
        ("ddd", "11"),
    }
    whole = found["todos", "todos"]
    assert whole["baseline_p"] == 0.9 and whole["p_t"] == 0.91 and whole["n_per_group"] > 0
    assert found["sistema", "2"]["baseline_p"] is None
    assert found["sistema", "2"]["n_per_group"] is None
    sure = with_sample_size(spark.createDataFrame([(0.985,), (1.0,)], "baseline_p double"))
    assert [(r["p_t"], r["n_per_group"]) for r in sure.collect()][1] == (0.99, 0)


