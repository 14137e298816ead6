"""Small hand-written tables and a brute-force attribution to compare with."""

from __future__ import annotations

from datetime import date, datetime, timedelta

DISPATCH = (
    "id_disparo bigint, cpf bigint, contato_telefone bigint, envio_datahora timestamp_ntz,"
    " status_disparo string"
)
APPEARANCE = (
    "telefone_mascarado bigint, telefone_ddi string, telefone_ddd string, telefone_tipo string,"
    " telefone_qualidade string, validacao_telefone string, id_sistema_mask bigint,"
    " registro_data_atualizacao timestamp_ntz, cpf_aparicao bigint"
)


def dispatch(spark, rows):
    """Rows (id, cpf, phone, sent, status)."""
    return spark.createDataFrame(rows, DISPATCH)


def appearances(spark, rows):
    """Rows (phone, area, system, updated, owner)."""
    return spark.createDataFrame(
        [(p, "55", area, "CELULAR", "BOA", "VALIDO", s, u, o) for p, area, s, u, o in rows],
        APPEARANCE,
    )


def midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


def attribute_by_hand(sent, listed, null_dates="first"):
    """{id: (system, update day, valid)}, by building every pair, as the rule is written."""
    best = {}
    far = date(1, 1, 1)
    for ident, _, phone, when, _ in sent:
        pairs = [a for a in listed if phone is not None and a[0] == phone] or [(None,) * 5]
        for _, _, system, updated, _ in pairs:
            valid = updated is not None and updated <= midnight(when.date())
            day = updated.date() if updated else None
            if day is None:
                recency = -(10**9) if null_dates == "first" else 10**9
            else:
                recency = -(day - far).days
            key = (not valid, recency, -1 if system is None else system)
            if ident not in best or key < best[ident][0]:
                best[ident] = (key, (system, day, valid))
    return {ident: value for ident, (_, value) in best.items()}


def some_time(rng, start=date(2024, 1, 1), days=60):
    moment = midnight(start + timedelta(days=rng.randrange(days)))
    return moment if rng.random() < 0.5 else moment + timedelta(hours=rng.randrange(1, 24))
