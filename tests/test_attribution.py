import random
from datetime import date, datetime

import pytest
from frames import appearances, attribute_by_hand, dispatch, some_time
from pyspark.sql import functions as F

from dialwise.operators.appearances import candidates, explode_appearances, people_with_phones
from dialwise.operators.attribution import attribute_system, enrich_dispatch
from dialwise.schemas import EVENTS, PHONE_DIM


def attributed(spark, sent, listed, **options):
    events = attribute_system(dispatch(spark, sent), appearances(spark, listed), **options)
    return {r["id_disparo"]: r for r in events.collect()}


def test_columns_and_types_are_those_of_the_contract(spark):
    events = attribute_system(dispatch(spark, []), appearances(spark, []))
    assert [(f.name, f.dataType) for f in events.schema] == [(f.name, f.dataType) for f in EVENTS]


def test_latest_valid_record_wins_over_later_ones(spark):
    sent = [(1, 7, 10, datetime(2024, 3, 10, 9), "delivered")]
    listed = [
        (10, "21", 1, datetime(2024, 3, 1), 7),
        (10, "21", 2, datetime(2024, 3, 10), 7),
        (10, "21", 3, datetime(2024, 3, 11), 7),
    ]
    row = attributed(spark, sent, listed)[1]
    assert (row["id_sistema_mask"], row["age_days"], row["delivered"]) == (2, 0.0, 1)


def test_an_update_during_the_send_day_is_not_valid_but_has_age_zero(spark):
    sent = [(1, 7, 10, datetime(2024, 3, 10, 18), "failed")]
    alone = [(10, "21", 1, datetime(2024, 3, 10, 10), 7)]
    row = attributed(spark, sent, alone)[1]
    assert (row["id_sistema_mask"], row["age_days"]) == (1, 0.0)
    with_older = [*alone, (10, "21", 2, datetime(2024, 1, 1), 7)]
    assert attributed(spark, sent, with_older)[1]["id_sistema_mask"] == 2
    next_day = [(1, 7, 10, datetime(2024, 3, 11), "failed")]
    assert attributed(spark, next_day, with_older)[1]["id_sistema_mask"] == 1


def test_fallback_and_null_dates(spark):
    sent = [(1, 7, 10, datetime(2024, 3, 10), None)]
    listed = [(10, "21", 1, None, 7), (10, "21", 2, datetime(2025, 1, 1), 7)]
    first = attributed(spark, sent, listed)[1]
    assert (first["id_sistema_mask"], first["age_days"]) == (1, None)
    last = attributed(spark, sent, listed, null_dates="last")[1]
    assert last["id_sistema_mask"] == 2 and last["age_days"] < 0
    only_null = attributed(spark, sent, listed[:1], null_dates="last")[1]
    assert (only_null["id_sistema_mask"], only_null["registro_data_atualizacao"]) == (1, None)
    with pytest.raises(ValueError):
        attributed(spark, sent, listed, null_dates="middle")


def test_null_and_unknown_phones_keep_their_rows(spark):
    sent = [
        (1, 7, None, datetime(2024, 3, 10), "read"),
        (2, 7, 99, datetime(2024, 3, 10), "READ"),
        (3, 7, 10, None, ""),
    ]
    listed = [(None, "21", 5, datetime(2024, 1, 1), 7), (10, "21", 6, datetime(2024, 1, 1), 7)]
    rows = attributed(spark, sent, listed)
    assert rows[1]["id_sistema_mask"] is None and rows[1]["telefone_ddd"] is None
    assert rows[2]["id_sistema_mask"] is None and rows[2]["delivered"] == 1
    assert rows[3]["id_sistema_mask"] == 6 and rows[3]["age_days"] is None


def test_repeated_ids_collapse_into_the_better_attribution(spark):
    sent = [
        (1, 7, 10, datetime(2024, 3, 10), "failed"),
        (1, 8, 11, datetime(2024, 3, 10), "read"),
        (None, 7, 10, datetime(2024, 3, 10), "failed"),
        (None, 8, 11, datetime(2024, 3, 10), "read"),
    ]
    listed = [(10, "21", 1, datetime(2025, 1, 1), 7), (11, "21", 2, datetime(2024, 1, 1), 8)]
    rows = attributed(spark, sent, listed)
    assert len(rows) == 2
    assert rows[1]["id_sistema_mask"] == 2 and rows[None]["id_sistema_mask"] == 2
    kept = attribute_system(
        dispatch(spark, sent), appearances(spark, listed), unique_ids=True
    )
    assert kept.count() == 4


def test_a_shuffle_by_id_is_saved_by_promise_only(spark):
    listed = appearances(spark, [(10, "21", 1, datetime(2024, 1, 1), 7)])
    sent = dispatch(spark, [(1, 7, 10, datetime(2024, 3, 10), "read")])

    def shuffles_by_id(**promise):
        plan = attribute_system(sent, listed, **promise)._jdf.queryExecution()
        return "hashpartitioning(id_disparo" in plan.executedPlan().toString()

    assert shuffles_by_id() and not shuffles_by_id(unique_ids=True)


def test_attributes_of_a_phone_do_not_depend_on_those_asked_for(spark):
    listed = appearances(
        spark,
        [(10, "99", 1, datetime(2024, 1, 1), 7), (10, "11", 1, datetime(2024, 1, 1), 7)],
    ).withColumn("telefone_ddi", F.when(F.col("telefone_ddd") == "99", "1").otherwise("55"))
    sent = dispatch(spark, [(1, 7, 10, datetime(2024, 3, 10), "read")])
    whole = attribute_system(sent, listed).first()["telefone_ddd"]
    alone = attribute_system(sent, listed, attributes=["telefone_ddd"]).first()["telefone_ddd"]
    assert whole == alone == "99"


def test_of_updates_on_one_day_the_smaller_system_wins(spark):
    day, later = datetime(2024, 3, 1), datetime(2024, 3, 1, 15)
    listed = [(10, "21", 5, later, 7), (10, "21", 4, day, 7), (11, "21", 5, day, 7), (11, "21", 4, later, 7)]
    sent = [(i, 7, phone, when, "read") for i, (phone, when) in enumerate(
        (p, w) for p in (10, 11) for w in (datetime(2024, 2, 1), datetime(2024, 3, 9)))]
    rows = attributed(spark, sent, listed)
    assert [rows[i]["id_sistema_mask"] for i in range(4)] == [4, 4, 4, 4]


@pytest.mark.parametrize("seed,null_dates", [(1, "first"), (2, "last"), (3, "first")])
def test_agrees_with_building_every_pair(spark, seed, null_dates):
    rng = random.Random(seed)
    phones = [*range(8), None]
    sent = [
        (i, rng.randrange(5), rng.choice(phones), some_time(rng), "read") for i in range(300)
    ]
    listed = [
        (
            rng.choice([*range(6), None]),
            "21",
            rng.choice([1, 2, 3, 4, None]),
            None if rng.random() < 0.1 else some_time(rng),
            1,
        )
        for _ in range(60)
    ]
    want = attribute_by_hand(sent, listed, null_dates)
    rows = attributed(spark, sent, listed, null_dates=null_dates)
    assert {k: (r["id_sistema_mask"], r["registro_data_atualizacao"]) for k, r in rows.items()} == {
        k: v[:2] for k, v in want.items()
    }
    enriched = enrich_dispatch(dispatch(spark, sent), appearances(spark, listed), null_dates)
    assert enriched.count() == len(sent)
    for row in enriched.collect():
        mine = [a for a in listed if a[0] == row["contato_telefone"] and a[0] is not None]
        noon = datetime.combine(row["envio_data"], datetime.min.time())
        assert row["fan_out"] == len(mine)
        assert row["valid_at_send"] == sum(a[3] is not None and a[3] <= noon for a in mine)
        assert row["prefer"] == int(want[row["id_disparo"]][2])


def test_result_does_not_depend_on_partitions_or_order(spark):
    rng = random.Random(9)
    sent = [(i, 1, rng.randrange(4), some_time(rng), "read") for i in range(80)]
    listed = [(rng.randrange(4), "21", rng.randrange(3), some_time(rng), 1) for _ in range(40)]
    base = attributed(spark, sent, listed)
    rng.shuffle(sent)
    rng.shuffle(listed)
    again = attribute_system(
        dispatch(spark, sent).repartition(7), appearances(spark, listed).repartition(3)
    )
    assert {r["id_disparo"]: r for r in again.collect()} == base


def test_a_phone_with_a_third_of_all_rows_builds_no_pairs(spark):
    """40,000 dispatches x 40,000 appearances of one phone would be 1.6 billion pairs."""
    n, hot = 120_000, 40_000
    start = F.lit("2020-01-01").cast("timestamp_ntz")

    def day(column, days):
        return start + F.make_dt_interval(F.pmod(column, F.lit(days)).cast("int"))

    def phone(column):
        return F.when(column < hot, F.lit(0)).otherwise(column % 9000 + 1).cast("bigint")

    ids = spark.range(n, numPartitions=16)
    sent = ids.select(
        F.col("id").alias("id_disparo"),
        (F.col("id") % 100).alias("cpf"),
        phone(F.col("id")).alias("contato_telefone"),
        day(F.col("id") * 7, 1500).alias("envio_datahora"),
        F.lit("read").alias("status_disparo"),
    )
    attributes = [
        F.lit("x").alias(c)
        for c in (
            "telefone_ddi",
            "telefone_ddd",
            "telefone_tipo",
            "telefone_qualidade",
            "validacao_telefone",
        )
    ]
    listed = ids.select(
        phone(F.col("id")).alias("telefone_mascarado"),
        *attributes,
        (F.col("id") % 11).alias("id_sistema_mask"),
        day(F.col("id") * 3, 1400).alias("registro_data_atualizacao"),
        F.lit(1).cast("bigint").alias("cpf_aparicao"),
    )
    events = attribute_system(sent, listed, unique_ids=True)
    assert events.count() == n
    busy = events.where("contato_telefone = 0").collect()
    assert len(busy) == hot
    # Every day below 1400 has an update of the busy phone, so ages are 0 until updates stop.
    for row in busy:
        offset = (row["envio_data"] - date(2020, 1, 1)).days
        assert row["age_days"] == max(0, offset - 1399)


def phone_dim(spark, rows):
    """Rows (phone, list of (system, updated, owner) or None)."""
    return spark.createDataFrame(
        [(p, "55", "21", "CELULAR", "BR", "BOA", a, 0, 0, 0, "VALIDO") for p, a in rows], PHONE_DIM
    )


def test_explode_keeps_phones_without_appearances(spark):
    moment = datetime(2024, 1, 1)
    dim = phone_dim(
        spark, [(1, None), (2, []), (3, [(9, moment, 5)]), (4, [(9, moment, 5), (8, None, 6)])]
    )
    flat = explode_appearances(dim)
    rows = sorted(
        (r["telefone_mascarado"], r["id_sistema_mask"] or 0, r["cpf_aparicao"])
        for r in flat.collect()
    )
    assert rows == [(1, 0, None), (2, 0, None), (3, 9, 5), (4, 8, 6), (4, 9, 5)]
    assert [(r["cpf"], r["telefone"]) for r in candidates(flat).orderBy("telefone").collect()] == [
        (5, 3),
        (5, 4),
    ]


def test_candidates_drop_nulls_but_not_nan(spark):
    moment = datetime(2024, 1, 1)
    listed = appearances(
        spark, [(1, None, 1, moment, 1), (2, "21", 1, None, 1), (3, "21", None, moment, 1)]
    ).withColumn("id_sistema_mask", F.col("id_sistema_mask").cast("double"))
    nan = listed.limit(1).withColumn("id_sistema_mask", F.lit(float("nan")))
    kept = candidates(listed.unionByName(nan)).collect()
    assert [r["telefone"] for r in kept] == [1, 1]


def test_people_with_phones_counts_each_phone_once(spark):
    rows = [(1, 10), (1, 11), (1, 12), (1, 12), (2, 10), (2, 10), (2, 10)]
    frame = spark.createDataFrame(rows, "cpf bigint, telefone bigint")
    assert [tuple(r) for r in people_with_phones(frame).collect()] == [(1, 3)]
