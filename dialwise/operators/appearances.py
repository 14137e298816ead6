"""The phone dimension in flat form: one row per phone, system, date and owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_appearances(phone_dim: DataFrame) -> DataFrame:
    """One row per appearance of a phone; a phone with no list or an empty one keeps a row."""
    return (
        phone_dim.withColumn("aparicao", F.explode_outer("telefone_aparicoes"))
        .select(
            F.col("telefone_numero").alias("telefone_mascarado"),
            "telefone_ddi",
            "telefone_ddd",
            "telefone_tipo",
            "telefone_nacionalidade",
            "telefone_qualidade",
            "telefone_aparicoes_quantidade",
            "telefone_proprietarios_quantidade",
            "telefone_sistemas_quantidade",
            "validacao_telefone",
            F.col("aparicao.id_sistema").alias("id_sistema_mask"),
            F.col("aparicao.registro_data_atualizacao").alias("registro_data_atualizacao"),
            F.col("aparicao.cpf").alias("cpf_aparicao"),
        )
    )


def candidates(appearances: DataFrame) -> DataFrame:
    """Phones that may be chosen for a person: appearances with owner, phone, system and date."""
    return appearances.select(
        F.col("cpf_aparicao").alias("cpf"),
        F.col("telefone_mascarado").alias("telefone"),
        "id_sistema_mask",
        "registro_data_atualizacao",
        "telefone_ddd",
    ).where(
        F.col("cpf").isNotNull()
        & F.col("telefone").isNotNull()
        & F.col("id_sistema_mask").isNotNull()
        & F.col("registro_data_atualizacao").isNotNull()
    )


def people_with_phones(candidate_rows: DataFrame, at_least: int = 3) -> DataFrame:
    """People with ``at_least`` different phones."""
    return (
        candidate_rows.groupBy("cpf")
        .agg(F.count_distinct("telefone").alias("n_telefones"))
        .where(F.col("n_telefones") >= at_least)
    )
