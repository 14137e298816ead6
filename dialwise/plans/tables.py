"""Dispatch log and phone dimension derived from the order tables.

Every order is a dispatch to its customer's phone; every line of an order is an appearance of that
phone in the system of the supplier's nation; a fifth as many people as customers own the phones. All
of it grows with the tables. Unusual inputs are set by the keys: some dispatches repeat an id, have no
phone or a time of day, and a tenth go to one phone; some updates have no date or a time of day.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.functions import uniform
from dialwise.operators.attribution import attribute_system

# The instant at which phones are scored; all dates in the tables lie before it.
NOW = datetime(2002, 1, 1)


# Declared, so that opening a table reads no file.
_SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz,"
        " o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_shipdate timestamp_ntz"
    ),
    "events": "ts timestamp_ntz, user_id bigint, event_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _people(spark: SparkSession, sf_dir: str) -> Column:
    counted = table(spark, sf_dir, "customer").selectExpr("greatest(1, count(1) div 5) AS people")
    return counted.scalar()


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "again", F.expr("explode(IF(o_orderkey % 101 = 0, array(0, 1), array(0)))")
    )
    sent = orders.selectExpr(
        "o_orderkey AS id_disparo",
        "o_custkey",
        """CASE WHEN again = 1 THEN o_custkey + 1
                WHEN o_orderkey % 97 = 0 THEN NULL
                WHEN o_orderkey % 10 = 0 THEN 1
                ELSE o_custkey END AS contato_telefone""",
        """IF(o_orderkey % 3 = 0,
              o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)), o_orderdate)
             AS envio_datahora""",
        """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                WHEN o_orderstatus = 'F' THEN 'delivered'
                WHEN o_orderstatus = 'O' THEN 'READ'
                ELSE 'failed' END AS status_disparo""",
        "CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS descricao_falha",
    )
    return sent.withColumn("cpf", F.col("o_custkey") % _people(spark, sf_dir)).drop("o_custkey")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone, system, update date and owner of every appearance; copies add nothing.

    The narrow orders are hashed, so the lines, four times as many, are not sorted for the join.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return (
        lines.join(suppliers, "l_suppkey")
        .join(orders.hint("shuffle_hash"), "l_orderkey")
        .selectExpr(
            "o_custkey AS telefone_numero",
            "CAST(s_nationkey AS BIGINT) AS id_sistema",
            """CASE WHEN (o_custkey + s_nationkey) % 53 = 0 THEN NULL
                    WHEN (o_custkey + s_nationkey) % 11 = 0 THEN l_shipdate + INTERVAL 10 HOURS
                    ELSE l_shipdate END AS registro_data_atualizacao""",
        )
        .distinct()
        .withColumn("cpf", F.col("telefone_numero") % _people(spark, sf_dir))
    )


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS telefone_numero",
        "'55' AS telefone_ddi",
        "CAST(c_nationkey AS STRING) AS telefone_ddd",
        "c_mktsegment AS telefone_tipo",
        "CASE WHEN c_acctbal < 0 THEN 'RUIM' ELSE 'BOA' END AS telefone_qualidade",
        "CASE WHEN c_acctbal < -500 THEN 'INVALIDO' ELSE 'VALIDO' END AS validacao_telefone",
    )


def phone_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per phone with its list of appearances, null for a phone that has none.

    A list holds distinct (system, date) pairs of one phone: at most 25 nations times the days of
    the calendar.
    """
    lists = (
        _listings(spark, sf_dir)
        .groupBy("telefone_numero")
        .agg(
            F.expr("collect_list(struct(id_sistema, registro_data_atualizacao, cpf))").alias(
                "telefone_aparicoes"
            )
        )
    )
    return (
        phones(spark, sf_dir)
        .join(lists, "telefone_numero", "left")
        .selectExpr(
            "*",
            "'BR' AS telefone_nacionalidade",
            """CAST(coalesce(size(telefone_aparicoes), 0) AS BIGINT)
                 AS telefone_aparicoes_quantidade""",
            """CAST(coalesce(size(array_distinct(telefone_aparicoes.cpf)), 0) AS BIGINT)
                 AS telefone_proprietarios_quantidade""",
            """CAST(coalesce(size(array_distinct(telefone_aparicoes.id_sistema)), 0) AS BIGINT)
                 AS telefone_sistemas_quantidade""",
        )
    )


def phone_system_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones with the number of systems that know them, without building the lists."""
    systems = (
        _listings(spark, sf_dir)
        .groupBy("telefone_numero")
        .agg(F.count_distinct("id_sistema").alias("systems"))
    )
    return (
        phones(spark, sf_dir)
        .join(systems, "telefone_numero", "left")
        .selectExpr(
            "telefone_numero", "coalesce(systems, 0) AS telefone_sistemas_quantidade"
        )
    )


def appearances(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    """The dimension in flat form, as ``explode_appearances`` gives it, without building lists.

    ``hashed`` has a task hash its phones, so that their many appearances are not sorted for the join.
    """
    owners = phones(spark, sf_dir)
    return (
        (owners.hint("shuffle_hash") if hashed else owners)
        .join(_listings(spark, sf_dir), "telefone_numero", "left")
        .withColumnsRenamed(
            {
                "telefone_numero": "telefone_mascarado",
                "id_sistema": "id_sistema_mask",
                "cpf": "cpf_aparicao",
            }
        )
    )


def events(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    """The attributed events with the named phone attributes."""
    return attribute_system(
        dispatch(spark, sf_dir), appearances(spark, sf_dir, hashed=True), attributes=attributes
    )


def decaying_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose outcome is drawn anew so that delivery falls with the age of the record."""
    chance = 1 / (1 + F.exp(-(F.lit(2.0) - F.lit(0.0014) * F.col("age_days"))))
    drawn = (uniform(42, F.col("id_disparo")) < chance).cast("int")
    aged = F.col("age_days").isNotNull()
    return events(spark, sf_dir).withColumn(
        "delivered", F.when(aged, drawn).otherwise(F.col("delivered"))
    )
