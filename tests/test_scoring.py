import random
from datetime import datetime

import pytest

from dialwise.operators import scoring as sc
from dialwise.operators.ranking import ScoreParams

NOW = datetime(2024, 6, 1)
CANDIDATE = (
    "cpf bigint, telefone bigint, id_sistema_mask bigint,"
    " registro_data_atualizacao timestamp_ntz, telefone_ddd string"
)


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATE)


def ranking(spark, scores):
    return spark.createDataFrame(list(scores.items()), "id_sistema_mask bigint, score double")


def bonus(spark, values):
    return spark.createDataFrame(list(values.items()), "telefone_ddd string, ddd_bonus double")


def test_score_is_system_times_recency_times_area(spark):
    rows = [
        (1, 10, 1, datetime(2023, 6, 2), "21"),
        (1, 11, 9, datetime(2024, 6, 1), "21"),
        (1, 12, 1, datetime(2024, 6, 1), "99"),
        (1, 13, 1, datetime(2024, 6, 3), None),
    ]
    scored = sc.score_candidates(
        candidates(spark, rows),
        ranking(spark, {1: 0.8}),
        NOW,
        ScoreParams(half_life_days=365.0),
        bonus(spark, {"21": 0.05}),
    )
    found = {r["telefone"]: r for r in scored.collect()}
    assert found[10]["age_days"] == 365.0
    assert found[10]["final_score"] == pytest.approx(0.8 * 0.5 * 1.05)
    assert found[11]["final_score"] == 0.0
    assert found[12]["final_score"] == pytest.approx(0.8)
    assert found[13]["recency_weight"] > 1
    clamped = sc.score_candidates(
        candidates(spark, rows), ranking(spark, {1: 0.8}), NOW, clamp_future=True
    )
    assert {r["telefone"]: r["recency_weight"] for r in clamped.collect()}[13] == 1.0


def test_best_record_of_a_phone(spark):
    rows = [
        (1, 10, 1, datetime(2024, 1, 1), "21"),
        (1, 10, 2, datetime(2024, 1, 1), "21"),
        (1, 10, 3, datetime(2020, 1, 1), "21"),
        (2, 10, 3, datetime(2020, 1, 1), "21"),
    ]
    scored = sc.score_candidates(
        candidates(spark, rows), ranking(spark, {1: 0.5, 2: 0.5, 3: 0.5}), NOW
    )
    best = {r["cpf"]: r["id_sistema_mask"] for r in sc.best_row_per_phone(scored).collect()}
    assert best == {1: 1, 2: 3}


def test_ranks_and_top_two(spark):
    rows = [
        (1, 10, 1, NOW, "21"),
        (1, 10, 2, NOW, "21"),
        (1, 11, 2, NOW, "21"),
        (1, 12, 3, NOW, "21"),
        (2, 10, 3, NOW, "21"),
    ]
    scores = ranking(spark, {1: 0.9, 2: 0.5, 3: 0.7})
    ranked = sc.score_phones(candidates(spark, rows), scores, NOW)
    assert ranked.columns == [*sc.SCORED_COLUMNS, "rank"]
    found = {(r["cpf"], r["telefone"]): r["rank"] for r in ranked.collect()}
    assert found == {(1, 10): 1, (1, 12): 2, (1, 11): 3, (2, 10): 1}
    top = sc.score_phones(candidates(spark, rows), scores, NOW, top=2)
    assert {(r["cpf"], r["telefone"]): r["rank"] for r in top.collect()} == {
        k: v for k, v in found.items() if v <= 2
    }
    check = sc.top_check(top, candidates(spark, rows))
    assert check.where("ok").count() == 2
    broken = sc.top_check(top.where("rank = 1"), candidates(spark, rows))
    assert [r["cpf"] for r in broken.where("NOT ok").collect()] == [1]


def test_other_column_names_and_no_area(spark):
    frame = candidates(spark, [(1, 10, 1, NOW, "21"), (1, 11, 1, datetime(2023, 1, 1), "21")])
    own = frame.drop("telefone_ddd").withColumnsRenamed(
        {
            "cpf": "pessoa",
            "telefone": "fone",
            "id_sistema_mask": "fonte",
            "registro_data_atualizacao": "em",
        }
    )
    names = sc.CandidateColumns("pessoa", "fone", "fonte", "em", None)
    scores = ranking(spark, {1: 0.9}).withColumnRenamed("id_sistema_mask", "fonte")
    areas = bonus(spark, {"21": 0.05})
    for top in (None, 1):
        out = sc.score_phones(own, scores, NOW, bonus=areas, top=top, columns=names)
        assert out.columns == ["pessoa", "fone", "fonte", "em", "final_score", "rank"]
        assert out.where("rank = 1").first()["final_score"] == pytest.approx(0.9)


def test_regrouped_top_two(spark):
    rows = [
        (1, 10, 1, 0.5, datetime(2024, 1, 1), "21"),
        (1, 10, 2, 0.9, datetime(2023, 1, 1), "11"),
        (1, 11, 3, 0.7, datetime(2024, 1, 1), "21"),
        (1, 12, 3, 0.1, datetime(2024, 1, 1), "21"),
    ]
    frame = spark.createDataFrame(
        rows,
        "cpf bigint, telefone bigint, id_sistema_mask bigint, final_score double,"
        " registro_data_atualizacao timestamp_ntz, telefone_ddd string",
    )
    found = {r["telefone"]: r for r in sc.top_phones_regrouped(frame).collect()}
    assert set(found) == {10, 11}
    assert found[10]["final_score"] == 0.9 and found[10]["id_sistema_mask"] == 2
    assert found[10]["registro_data_atualizacao"] == datetime(2024, 1, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_of_groups_that_span_partitions(spark, seed):
    """One group holds most rows, with many equal scores; small partitions force it to span."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice([0.1, 0.5, 0.9])) for i in range(3000)]
    rows += [(100 + i, i, 0.5) for i in range(40)]
    frame = spark.createDataFrame(rows, "cpf bigint, telefone bigint, final_score double")
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "13",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ranked = sc.rank_phones(frame.repartition(5)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    for person in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == person), key=lambda r: (-r[2], r[1]))
        want.update({(person, r[1]): i for i, r in enumerate(own, 1)})
    assert {(r["cpf"], r["telefone"]): r["rank"] for r in ranked} == want
    assert len(ranked) == len(rows)


def test_score_falls_with_age(spark):
    rows = [(1, i, 1, datetime(2024 - i, 1, 1), "21") for i in range(6)]
    ranked = sc.score_phones(candidates(spark, rows), ranking(spark, {1: 0.9}), NOW)
    assert [r["telefone"] for r in ranked.orderBy("rank").collect()] == list(range(6))


def test_large_ranking_is_not_broadcast(spark):
    from dialwise.session import broadcast_if_small

    small, large = spark.range(100), spark.range(101)
    marked, same = broadcast_if_small(small, large, max_rows=100)
    assert same is large
    plan = spark.range(10).join(marked, "id")
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
