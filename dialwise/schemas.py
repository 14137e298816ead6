"""Table contracts: what the operators expect of their inputs and promise of their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Names and types of the columns of the input tables and of the attributed events.

APPEARANCE = T.StructType(
    [
        T.StructField("id_sistema", T.LongType()),
        T.StructField("registro_data_atualizacao", T.TimestampNTZType()),
        T.StructField("cpf", T.LongType()),
    ]
)

DISPATCH = T.StructType(
    [
        T.StructField("id_disparo", T.LongType()),
        T.StructField("cpf", T.LongType()),
        T.StructField("contato_telefone", T.LongType()),
        T.StructField("envio_datahora", T.TimestampNTZType()),
        T.StructField("status_disparo", T.StringType()),
    ]
)

PHONE_DIM = T.StructType(
    [
        T.StructField("telefone_numero", T.LongType()),
        T.StructField("telefone_ddi", T.StringType()),
        T.StructField("telefone_ddd", T.StringType()),
        T.StructField("telefone_tipo", T.StringType()),
        T.StructField("telefone_nacionalidade", T.StringType()),
        T.StructField("telefone_qualidade", T.StringType()),
        T.StructField("telefone_aparicoes", T.ArrayType(APPEARANCE)),
        T.StructField("telefone_aparicoes_quantidade", T.LongType()),
        T.StructField("telefone_proprietarios_quantidade", T.LongType()),
        T.StructField("telefone_sistemas_quantidade", T.LongType()),
        T.StructField("validacao_telefone", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("id_disparo", T.LongType()),
        T.StructField("cpf", T.LongType()),
        T.StructField("contato_telefone", T.LongType()),
        T.StructField("id_sistema_mask", T.LongType()),
        T.StructField("registro_data_atualizacao", T.DateType()),
        T.StructField("envio_datahora", T.TimestampNTZType()),
        T.StructField("envio_data", T.DateType()),
        T.StructField("age_days", T.DoubleType()),
        T.StructField("telefone_ddi", T.StringType()),
        T.StructField("telefone_ddd", T.StringType()),
        T.StructField("telefone_tipo", T.StringType()),
        T.StructField("telefone_qualidade", T.StringType()),
        T.StructField("validacao_telefone", T.StringType()),
        T.StructField("status_disparo", T.StringType()),
        T.StructField("delivered", T.IntegerType()),
    ]
)

# Attributes of the phone itself, repeated on each of its appearances.
PHONE_ATTRIBUTES = [
    "telefone_ddi",
    "telefone_ddd",
    "telefone_tipo",
    "telefone_qualidade",
    "validacao_telefone",
]

_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_KIND_CHECKS = {
    T.TimestampNTZType: _TIME_TYPES,
    T.DateType: _TIME_TYPES,
    T.ArrayType: (T.ArrayType,),
}


class ContractError(ValueError):
    """A table lacks a column an operator needs, or holds it in an unusable type."""


def check_contract(df: DataFrame, contract: T.StructType, name: str) -> DataFrame:
    """Return ``df`` unchanged, or fail with every missing or mistyped column listed.

    Ids and labels may have any atomic type (masked ids are often strings); dates and lists
    must be dates and lists. Columns beyond the contract are allowed.
    """
    have = {f.name: f.dataType for f in df.schema}
    problems = []
    for want in contract:
        got = have.get(want.name)
        if got is None:
            problems.append(f"missing column {want.name}")
        elif not isinstance(got, _KIND_CHECKS.get(type(want.dataType), (T.DataType,))):
            problems.append(f"column {want.name} is {got.simpleString()}")
        elif isinstance(want.dataType, T.ArrayType):
            problems += _list_problems(want, got)
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))
    return df


def _list_problems(want: T.StructField, got: T.ArrayType) -> list[str]:
    if not isinstance(got.elementType, T.StructType):
        return [f"column {want.name} must be a list of structs"]
    inner = set(got.elementType.fieldNames())
    return [
        f"missing field {want.name}.{f}"
        for f in want.dataType.elementType.fieldNames()
        if f not in inner
    ]
