from datetime import datetime

import pytest
from frames import appearances, dispatch
from pyspark.sql import functions as F

from dialwise.operators.attribution import attribute_system
from dialwise.schemas import ContractError, PHONE_DIM, check_contract
from dialwise.session import new_table_path, shared_folder
from dialwise.sources import (
    AmbiguousTable,
    TableNotFound,
    find_table,
    lookup_candidates,
    parquet,
    read_dispatch,
    read_events,
    read_phone_dim,
    write_candidates,
    write_events,
)


def sent(spark):
    return dispatch(spark, [(i, 1, 10, datetime(2024, 1, 1 + i % 3), "read") for i in range(9)])


def test_all_shards_of_a_table_are_read(spark, tmp_path):
    sent(spark).repartition(3).write.parquet(f"{tmp_path}/a/base_disparo_mascarado")
    assert read_dispatch(spark, f"{tmp_path}/a").count() == 9
    one, two = sent(spark).limit(4), sent(spark).limit(5)
    for i, part in enumerate((one, two)):
        shard = f"{tmp_path}/b/nested/x_base_disparo_mascarado-{i}.parquet"
        part.toPandas().to_parquet(_parent(shard), coerce_timestamps="us")
    assert read_dispatch(spark, f"{tmp_path}/b").count() == 9


def _parent(path):
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    return path


def test_files_without_the_parquet_ending_are_found(spark, tmp_path):
    shard = _parent(f"{tmp_path}/c/base_disparo_mascarado-000")
    sent(spark).toPandas().to_parquet(shard, coerce_timestamps="us")
    (tmp_path / "c" / "schema.yml").write_text("x")
    assert read_dispatch(spark, f"{tmp_path}/c").count() == 9


def test_folders_named_after_the_table_are_found_at_depth(spark, tmp_path):
    sent(spark).repartition(2).write.parquet(f"{tmp_path}/d/raw/2024_base_disparo_mascarado.parquet")
    assert read_dispatch(spark, f"{tmp_path}/d").count() == 9
    assert read_dispatch(spark, f"{tmp_path}").count() == 9


def rows(spark, path, n):
    _parent(path)
    spark.range(n).toPandas().to_parquet(path)


def test_no_shard_is_dropped_and_no_other_table_is_read(spark, tmp_path):
    rows(spark, f"{tmp_path}/a/t-000.parquet", 4)
    rows(spark, f"{tmp_path}/a/sub/t-001.parquet", 6)
    assert find_table(spark, f"{tmp_path}/a", "t").count() == 10
    rows(spark, f"{tmp_path}/b/base_disparo-000.parquet", 4)
    spark.range(6).write.parquet(f"{tmp_path}/b/base_disparo-new")
    assert find_table(spark, f"{tmp_path}/b", "base_disparo").count() == 10
    rows(spark, f"{tmp_path}/c/1/2/3/4/tab_part7.parquet", 3)
    assert find_table(spark, f"{tmp_path}/c", "tab").count() == 3
    rows(spark, f"{tmp_path}/d/tab.parquet", 10)
    rows(spark, f"{tmp_path}/d/old/tab_backup.parquet", 10)
    assert find_table(spark, f"{tmp_path}/d", "tab").count() == 10
    spark.range(5).write.parquet(f"{tmp_path}/e/part")
    spark.range(7).write.parquet(f"{tmp_path}/e/partsupp")
    assert find_table(spark, f"{tmp_path}/e", "part").count() == 5


def test_partition_columns_of_a_folder_survive_and_prune(spark, tmp_path):
    days = spark.range(30).selectExpr("id", "id % 5 AS day", "id % 2 AS part")
    days.write.partitionBy("day").parquet(f"{tmp_path}/raw/log")
    days.where("day < 2").write.partitionBy("day").parquet(f"{tmp_path}/late/log-new")
    found = find_table(spark, str(tmp_path), "log")
    assert set(found.columns) == {"id", "day", "part"} and found.count() == 42
    one = find_table(spark, f"{tmp_path}/raw", "log").where("day = 3")
    assert "PartitionFilters: [isnotnull(day" in plan_of(one) and one.count() == 6
    (tmp_path / "raw" / "empty" / "log").mkdir(parents=True)
    assert find_table(spark, str(tmp_path), "log").count() == 42


def test_folders_of_the_table_are_not_listed(spark, tmp_path, monkeypatch):
    days = spark.range(40).selectExpr("id", "id % 20 AS day")
    days.write.partitionBy("day").parquet(f"{tmp_path}/raw/log")
    seen = []
    real = parquet._entries

    def entries(spark, folder):
        for entry in real(spark, folder):
            seen.append(entry[0])
            yield entry

    monkeypatch.setattr(parquet, "_entries", entries)
    assert find_table(spark, str(tmp_path), "log").count() == 40
    # The way to the table, and its first file, which shows that it is not empty.
    assert len(seen) <= 5


def scanned(df) -> tuple[int, int]:
    """Rows that the scan of a plan gave, and files that it read."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    metrics = node.metrics()
    return tuple(metrics.apply(m).value() for m in ("numOutputRows", "numFiles"))


def test_a_lookup_reads_only_row_groups_that_may_hold_the_person(spark):
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "pmod(xxhash64(id), 50000) * 2 AS cpf", "id AS telefone", "id % 9 AS id_sistema_mask",
        "TIMESTAMP_NTZ'2024-01-01' AS registro_data_atualizacao", "'21' AS telefone_ddd",
    )
    hot = spark.range(60_000).selectExpr(
        "70000L AS cpf", "id AS telefone", "1L AS id_sistema_mask",
        "TIMESTAMP_NTZ'2024-01-01' AS registro_data_atualizacao", "'21' AS telefone_ddd",
    )
    table = rows.unionByName(hot)
    path = write_candidates(table, new_table_path(spark, "candidates"), row_group=64 << 10)
    files = len(spark.read.parquet(path).inputFiles())
    for person in (10, 99_998, 70_000):
        found = lookup_candidates(spark, path, [person])
        assert found.count() == table.where(F.col("cpf") == person).count() > 0
        read, opened = scanned(lookup_candidates(spark, path, [person]))
        assert opened <= files
        assert read < (110_000 if person == 70_000 else 40_000)
    # Odd persons lie between the smallest and largest of a row group; the Bloom filter knows better.
    assert scanned(lookup_candidates(spark, path, [10_001]))[0] == 0
    assert lookup_candidates(spark, path, []).count() == 0


def test_names_of_several_tables_are_an_error(spark, tmp_path):
    rows(spark, f"{tmp_path}/sales_2023x.parquet", 1)
    rows(spark, f"{tmp_path}/sales_old.parquet", 1)
    with pytest.raises(AmbiguousTable, match="sales_2023x.*sales_old"):
        find_table(spark, str(tmp_path), "sales")


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(TableNotFound):
        find_table(spark, str(tmp_path), "nothing")


def test_contracts_list_every_problem(spark, tmp_path):
    bad = sent(spark).drop("cpf").withColumn("envio_datahora", F.lit("x"))
    with pytest.raises(ContractError, match="missing column cpf; column envio_datahora is string"):
        from dialwise.schemas import DISPATCH

        check_contract(bad, DISPATCH, "dispatch")
    dim = spark.createDataFrame([], PHONE_DIM)
    assert check_contract(dim, PHONE_DIM, "dim") is dim
    no_owner = dim.withColumn(
        "telefone_aparicoes",
        F.transform("telefone_aparicoes", lambda a: a.dropFields("cpf")),
    )
    with pytest.raises(ContractError, match="missing field telefone_aparicoes.cpf"):
        check_contract(no_owner, PHONE_DIM, "dim")
    with pytest.raises(ContractError, match="is string"):
        check_contract(dim.withColumn("telefone_aparicoes", F.lit("x")), PHONE_DIM, "dim")


def test_phone_dimension_round_trip(spark, tmp_path):
    rows = [(1, "55", "21", "C", "BR", "BOA", [(9, datetime(2024, 1, 1), 5)], 1, 1, 1, "V")]
    spark.createDataFrame(rows, PHONE_DIM).write.parquet(f"{tmp_path}/dim_telefone_mascarado")
    assert read_phone_dim(spark, str(tmp_path)).first()["telefone_aparicoes"][0]["id_sistema"] == 9


@pytest.mark.parametrize("by_day", [False, True])
def test_events_round_trip(spark, by_day):
    listed = appearances(spark, [(10, "21", 1, datetime(2023, 1, 1), 1)])
    events = attribute_system(sent(spark), listed)
    path = write_events(events, new_table_path(spark, "events"), by_day)
    assert path.startswith(shared_folder(spark))
    back = read_events(spark, path)
    assert back.columns == events.columns
    assert back.exceptAll(events).isEmpty() and events.exceptAll(back).isEmpty()
    if by_day:
        day = back.where(F.col("envio_data") == "2024-01-02")
        assert "PartitionFilters: [isnotnull(envio_data" in plan_of(day)
        assert day.count() == 3


def plan_of(df):
    return df._jdf.queryExecution().toString()
