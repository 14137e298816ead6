import pytest
from oracle_check import compare, connect

import __spark_entry__ as driver
from dialwise.plans.catalogue import QUERIES
from dialwise.plans.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_counterpart():
    # The fit with effects has no SQL; tests/test_logit.py compares it with MLlib.
    assert set(QUERIES) - {"decay_effects"} == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    assert compare(con, ORACLE[name], QUERIES[name](spark, SF_DIR)) is None


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns == [
        "cpf",
        "telefone",
        "id_sistema_mask",
        "registro_data_atualizacao",
        "telefone_ddd",
        "final_score",
        "rank",
    ]
    assert rows.count() > 0
