"""What the plans do at scale: pruning, pushdown, group limits, joins, skew."""

import re

import pytest
from pyspark.sql import functions as F

from dialwise.operators import scoring as sc
from dialwise.operators.attribution import attribute_system
from dialwise.operators import rates as rt
from dialwise.operators.rates import rates_by_system
from dialwise.plans import tables as t
from dialwise.plans.catalogue import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str, column: str) -> list[str]:
    return [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if column in s]


@pytest.fixture
def settings(spark):
    before = {}

    def change(**values):
        for name, value in values.items():
            name = name.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# A store's queries read its files; its plans run while it is updated.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"events_incremental", "profile_system_rates"}))
def test_no_query_pairs_rows_without_a_key(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read_and_filters_reach_the_scan(spark, settings):
    settings(spark__sql__maxMetadataStringLength="2000")
    plan = plan_of(rates_by_system(t.events(spark, SF_DIR)))
    (lines,) = scans(plan, "l_orderkey")
    assert lines.split(",") == [
        "l_orderkey:bigint",
        "l_suppkey:bigint",
        "l_shipdate:timestamp_ntz",
    ]
    # The attributes of the phone are not used by this query, so customers give only their key.
    assert scans(plan, "c_custkey") == ["c_custkey:bigint"]
    assert "o_totalprice" not in plan


def test_choices_per_group_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["top2_phones"](spark, SF_DIR))
    assert len(re.findall(r"WindowGroupLimit .*Partial", plan)) == 2
    assert len(re.findall(r"WindowGroupLimit .*Final", plan)) == 2
    picks = plan_of(QUERIES["ab_control_pick"](spark, SF_DIR))
    assert len(re.findall(r"WindowGroupLimit .*Partial", picks)) == 1


def test_copies_of_an_id_are_cut_before_the_shuffle(spark):
    events = attribute_system(t.dispatch(spark, SF_DIR), t.appearances(spark, SF_DIR))
    assert re.search(r"WindowGroupLimit \[id_disparo.*Partial", plan_of(events))


def test_attribution_needs_no_job_and_no_sorting_aggregation(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = plan_of(t.events(spark, SF_DIR))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert "SortAggregate" not in plan


def test_a_task_of_the_attribution_holds_the_days_of_its_phones_once(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(t.events(spark, SF_DIR))
    days = r"HashAggregate\(keys=\[phone#\d+\], functions=\[min\(system.*\n\W*Exchange hashpartitioning\(phone#"
    assert len(re.findall(days, plan)) == 1
    assert len(re.findall(r"Sort \[phone#", plan)) == 1
    # Neither the lines nor the appearances are sorted for their joins.
    assert not re.search(r"Sort \[(telefone_numero|l_orderkey)#", plan)


def test_rows_that_the_attribution_sorts_hold_a_dispatch_and_its_answer_only(spark, settings):
    """A phone that holds most dispatches is sorted by one task, first for the join and then by id."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__debug__maxToStringFields="200")
    plan = plan_of(t.events(spark, SF_DIR))

    def columns(above: str) -> set[str]:
        (listed,) = re.findall(above + r"[^\n]*\n[^\n]*Project \[([^\n]*)\]\n", plan)
        return {re.search(r"(\w+)#\d+L?$", c)[1] for c in re.split(r", (?=[^()]*(?:\(|$))", listed)}

    sent = {"id_disparo", "cpf", "contato_telefone", "envio_datahora", "status_disparo"}
    joined = columns(r"Exchange hashpartitioning\(contato_telefone#\d+L?, spread#\d+L?, \d+\)")
    assert joined == sent | {"spread"}
    told_apart = columns(r"Sort \[id_disparo")
    assert told_apart == sent | {"prefer", "id_sistema_mask", "registro_data_atualizacao"}


@pytest.mark.parametrize("attributes", [(), ("telefone_ddd",)])
def test_attribution_scans_each_table_once(spark, settings, tmp_path, attributes):
    settings(spark__sql__maxMetadataStringLength="2000", spark__sql__autoBroadcastJoinThreshold="-1")
    t.dispatch(spark, SF_DIR).write.parquet(f"{tmp_path}/log")
    t.appearances(spark, SF_DIR).write.parquet(f"{tmp_path}/listed")
    log, listed = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("log", "listed"))
    plan = plan_of(attribute_system(log, listed, attributes=attributes))
    assert len(scans(plan, "id_disparo")) == len(scans(plan, "telefone_mascarado")) == 1
    # The dispatches move once to their phones, and once more to their ids.
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert sorted(moved) == ["contato_telefone", "contato_telefone", "id_disparo", "phone", "phone"]


def test_a_layout_by_phone_joins_without_an_exchange(spark):
    layout = rt.phone_layout(t.events(spark, SF_DIR), t.phone_system_counts(spark, SF_DIR))
    joined = rt._by_phone_and_system(layout.totals, layout.systems, 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(joined) and "Bucketed: true" in plan_of(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_learned_tables_are_broadcast(spark):
    plan = plan_of(QUERIES["score_candidates"](spark, SF_DIR))
    assert re.search(r"BroadcastHashJoin \[id_sistema_mask", plan)
    assert re.search(r"BroadcastHashJoin \[area", plan)


def test_top_of_a_sorted_table_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_systems"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_cpf"](spark, SF_DIR))


def test_no_window_without_a_key(spark):
    for name in ("score_phones", "attribute_system", "ddd_bonus", "decay_bins", "sample_size"):
        plan = plan_of(QUERIES[name](spark, SF_DIR))
        assert not re.search(r"Window .*\n.*Sort .*\n.*Exchange SinglePartition", plan)


def test_a_hot_phone_and_day_is_split_by_the_join(spark, settings):
    """A third of all dispatches go to one phone on one day; the join splits that partition."""
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    hot = F.col("id") % 3 == 0
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.when(hot, F.lit(5)).otherwise(F.col("id") % 300).cast("int")
    )
    ids = spark.range(0, 300_000, 1, 12)
    sent = ids.select(
        F.col("id").alias("id_disparo"),
        (F.col("id") % 1000).alias("cpf"),
        F.when(hot, F.lit(7)).otherwise(F.col("id") % 5000).cast("bigint").alias("contato_telefone"),
        day.alias("envio_datahora"),
        F.lit("read").alias("status_disparo"),
    )
    listed = spark.range(5000).select(
        F.col("id").alias("telefone_mascarado"),
        *[
            F.lit("x").alias(c)
            for c in (
                "telefone_ddi",
                "telefone_ddd",
                "telefone_tipo",
                "telefone_qualidade",
                "validacao_telefone",
            )
        ],
        (F.col("id") % 9).alias("id_sistema_mask"),
        F.lit("2023-12-01").cast("timestamp_ntz").alias("registro_data_atualizacao"),
        F.lit(1).cast("bigint").alias("cpf_aparicao"),
    )
    events = attribute_system(sent, listed, unique_ids=True)
    # The ids keep the rows of the hot partition from shrinking to nothing in the shuffle.
    counted = events.groupBy("id_sistema_mask").agg(
        F.count("id_disparo").alias("n"), F.max("id_disparo")
    )
    assert sum(r["n"] for r in counted.collect()) == 300_000
    assert "SortMergeJoin(skew=true)" in plan_of(counted)


def test_a_person_with_most_phones_is_ranked_in_several_tasks(spark, settings):
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    phones = spark.range(0, 60_000, 1, 8).select(
        F.lit(1).cast("bigint").alias("cpf"),
        F.col("id").alias("telefone"),
        (F.col("id") % 7).cast("double").alias("final_score"),
    )
    ranked = sc.rank_phones(phones)
    ends = ranked.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    assert tuple(ends) == (1, 60_000, 60_000)
    spread = ranked.where("rank % 5000 = 1").count()
    assert spread == 12
