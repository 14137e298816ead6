"""Attribute each dispatch to the source record that was current when it was sent.

The rule, per dispatch: among the appearances of its phone updated on or before the send day take
the latest; if there is none, take the latest of all.

A left join on the phone followed by a choice per dispatch would build every pair of a phone's
dispatches and appearances, which grows with the square of a busy phone. Here each table is read once.
The appearances of a phone become its history: one state per day on which its answer changes (the best
record so far, and how many were usable), sorted and cut into blocks. That is one row per phone, never
longer than the calendar. Dispatches join it by phone, one row to one row, and each looks up the block
and then the state of its send day. A phone that holds most dispatches is one history and many rows of
the other side, which AQE splits; dispatches without a phone spread by chance. The plan is the same for
all inputs, and no job runs before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.functions import delivered_flag
from dialwise.schemas import DISPATCH, EVENTS, PHONE_ATTRIBUTES

# Stands for a system that is null in minima, where it comes first.
_NO_SYSTEM = "-9223372036854775808"


def with_send_day(dispatch: DataFrame) -> DataFrame:
    """Add the success flag and the date part of the send time."""
    return dispatch.withColumns(
        {
            "delivered": delivered_flag(F.col("status_disparo")),
            "envio_data": F.to_date("envio_datahora"),
        }
    )


# An update during a day is not on or before the midnight that starts this day, so it can serve
# only from the next day on.
_USABLE_FROM = """
CASE WHEN CAST(registro_data_atualizacao AS TIMESTAMP_NTZ)
          > CAST(CAST(registro_data_atualizacao AS DATE) AS TIMESTAMP_NTZ)
     THEN date_add(CAST(registro_data_atualizacao AS DATE), 1)
     ELSE CAST(registro_data_atualizacao AS DATE) END
"""

# Places appearances without a date before or after all others, if none was valid at the send.
_LATEST_FIRST = {
    "first": "coalesce(-unix_date(updated), -2147483647)",
    "last": "coalesce(-unix_date(updated), 2147483647)",
}


# States per block of a history: a lookup reads the first days of all blocks, then one block.
_BLOCK = 64
# Dispatches without a phone fall into as many groups, so that they don't meet in one task.
_NO_PHONE = 1024


def _per_day(appearances: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Per phone, first usable day and update day: the smallest system and the number of rows.

    Without attributes all columns have a fixed width, so this is a hash aggregation with map-side
    combine. Its key is one struct, so that rows which lie by phone already still move between its two
    halves: a task then holds the days once, not in two hash tables and the sort of the windows. The
    attributes are those of the smallest row of all attributes, whichever are asked for.
    """
    best = [F.min(F.struct(*PHONE_ATTRIBUTES)).alias("of_phone")] if attributes else []
    rows = (
        appearances.where("telefone_mascarado IS NOT NULL")
        .selectExpr(
            "telefone_mascarado AS phone",
            f"{_USABLE_FROM} AS dia",
            "CAST(registro_data_atualizacao AS DATE) AS updated",
            f"coalesce(id_sistema_mask, {_NO_SYSTEM}) AS system",
            *(PHONE_ATTRIBUTES if attributes else ()),
        )
    )
    keys = ["phone", "dia", "updated"]
    totals = [F.min("system").alias("system"), F.count(F.lit(1)).alias("listed"), *best]
    if attributes:
        return rows.groupBy(*keys).agg(*totals)
    keyed = rows.select(F.struct(*keys).alias("phone"), "system")
    return keyed.groupBy("phone").agg(*totals).select("phone.*", "system", "listed")


def phone_histories(
    appearances: DataFrame, null_dates: str = "first", attributes: Sequence[str] = ()
) -> DataFrame:
    """One row per phone of the dimension:

    ``any``, its best appearance when none is valid, ``fan_out``, the number of its appearances,
    ``blocks``, its states in order of days (``day``, ``usable``, the number of appearances valid from
    that day on, and ``valid``, the best of them), and the named attributes. The choice is by latest
    update day, then smallest system, among the valid ones and among all alike.
    """
    if null_dates not in _LATEST_FIRST:
        raise ValueError(f"null_dates must be 'first' or 'last', not {null_dates!r}")
    phone = "PARTITION BY phone"
    so_far = f"{phone} ORDER BY dia NULLS FIRST, updated ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    choice = f"struct({_LATEST_FIRST[null_dates]} AS first, system, updated)"
    days = _per_day(appearances, attributes)
    if not attributes:
        # The order of the windows, made before their rows grow by the choice.
        days = days.repartition("phone").sortWithinPartitions("phone", "dia", "updated")
    states = (
        days.withColumn("choice", F.expr(choice))
        .selectExpr(
            "*",
            # Rows without a day are never valid.
            f"sum(IF(dia IS NULL, 0L, listed)) OVER ({so_far}) AS usable",
            f"min(IF(dia IS NULL, NULL, choice)) OVER ({so_far}) AS valid",
            f"(row_number() OVER ({phone} ORDER BY dia NULLS FIRST, updated) - 1) div {_BLOCK} AS block",
        )
    )
    best = [F.min("of_phone").alias("of_phone")] if attributes else []
    state = F.when(F.col("dia").isNotNull(), F.struct(F.col("dia").alias("day"), "usable", "valid"))
    blocks = states.groupBy("phone", "block").agg(
        F.min("choice").alias("any"),
        F.sum("listed").alias("fan_out"),
        F.min("dia").alias("day"),
        # Two rows of a day differ in what is usable, so the order is total.
        F.array_sort(F.collect_list(state)).alias("states"),
        *best,
    )
    held = F.when(F.col("day").isNotNull(), F.struct("day", "block", "states"))
    return blocks.groupBy("phone").agg(
        F.min("any").alias("any"),
        F.sum("fan_out").alias("fan_out"),
        F.array_sort(F.collect_list(held)).alias("blocks"),
        *best,
    ).select("phone", "any", "fan_out", "blocks", *[f"of_phone.{a}" for a in attributes])


def _last_until(states: str, day: str) -> str:
    """The last of ``states``, sorted by day, that is not after ``day``; null without one."""
    return f"try_element_at(filter({states}, s -> s.day <= {day}), -1)"


def state_on(day: str, history: str = "") -> str:
    """SQL of the state that a history (its columns, named with the prefix ``history``) has on a day."""
    return _last_until(_last_until(f"{history}blocks", day) + ".states", day)


def enrich_dispatch(
    dispatch: DataFrame,
    appearances: DataFrame,
    null_dates: str = "first",
    attributes: Sequence[str] = PHONE_ATTRIBUTES,
) -> DataFrame:
    """Each dispatch with its flag, its send day, what its phone's appearances say about that day
    (``choice``, the winning one, ``prefer``, 1 if it was valid then, ``fan_out``, how many there are,
    ``valid_at_send``, how many were valid) and the named attributes of the phone.

    Like a left join: a dispatch without a phone, or with one the dimension lacks, keeps its row.
    """
    return answered(dispatch, phone_histories(appearances, null_dates, attributes), attributes)


def answered(
    dispatch: DataFrame, histories: DataFrame, attributes: Sequence[str] = PHONE_ATTRIBUTES
) -> DataFrame:
    """As :func:`enrich_dispatch`, from histories that hold the named attributes.

    What follows from a dispatch is added after the join, so that the rows it moves and sorts are narrow.
    """
    lonely = F.when(
        F.col("contato_telefone").isNull(), F.pmod(F.xxhash64("id_disparo", "cpf"), F.lit(_NO_PHONE)) + 1
    ).otherwise(F.lit(0))
    # 0 for every phone, but no constant, so that it stays a key of the join: both sides then come from
    # their shuffles, which adaptive execution needs to split a phone that holds most dispatches.
    by_phone = histories.withColumnRenamed("phone", "contato_telefone").withColumn(
        "spread", F.expr("fan_out % 1")
    )
    joined = dispatch.withColumn("spread", lonely).join(by_phone, ["contato_telefone", "spread"], "left")
    found = (
        with_send_day(joined)
        .withColumn("state", F.expr(state_on("envio_data")))
        .withColumn("won", F.expr("coalesce(state.valid, any)"))
    )
    answers = {
        "choice": f"""struct(nullif(won.system, {_NO_SYSTEM}) AS id_sistema_mask,
                             won.updated AS registro_data_atualizacao)""",
        "prefer": "CAST(state.valid IS NOT NULL AS INT)",
        "fan_out": "coalesce(fan_out, 0L)",
        "valid_at_send": "coalesce(state.usable, 0L)",
    }
    return found.select(
        *with_send_day(dispatch).columns, *[F.expr(e).alias(name) for name, e in answers.items()], *attributes
    )


def attribute_system(
    dispatch: DataFrame,
    appearances: DataFrame,
    null_dates: str = "first",
    attributes: Sequence[str] = PHONE_ATTRIBUTES,
    unique_ids: bool = False,
) -> DataFrame:
    """The attributed events: one row per ``id_disparo``, with the winning system and its age.

    ``null_dates`` says where appearances without a date stand when no appearance was valid at
    the send: ``"first"`` (the default) prefers them to records dated after it, ``"last"`` does
    not. ``attributes`` names the phone attributes to carry along.

    Rows that share an id collapse into the one with the better attribution: a shuffle by id with
    a group limit before it. ``unique_ids=True`` promises that ids don't repeat and saves it.
    """
    histories = phone_histories(appearances, null_dates, attributes)
    return events_of_histories(dispatch, histories, null_dates, attributes, unique_ids)


def events_of_histories(
    dispatch: DataFrame,
    histories: DataFrame,
    null_dates: str = "first",
    attributes: Sequence[str] = PHONE_ATTRIBUTES,
    unique_ids: bool = False,
) -> DataFrame:
    """As :func:`attribute_system`, from histories built with the same ``null_dates``.

    The rows that are told apart by id hold the dispatch and its answer; the rest is added to those left.
    """
    found = answered(dispatch, histories, attributes)
    chosen = found.select(*DISPATCH.fieldNames(), "prefer", "choice.*", *attributes)
    if not unique_ids:
        chosen = _one_row_per_id(chosen, null_dates)
    events = with_send_day(chosen).withColumn("age_days", F.expr(_AGE))
    left_out = set(PHONE_ATTRIBUTES) - set(attributes)
    return events.select(*[c for c in EVENTS.fieldNames() if c not in left_out])


_AGE = "CAST(datediff(envio_data, registro_data_atualizacao) AS DOUBLE)"


def _one_row_per_id(chosen: DataFrame, null_dates: str) -> DataFrame:
    """Of the rows that share an id, the one with the better attribution."""
    nulls = null_dates.upper()
    place = F.expr(
        f"""row_number() OVER (
              PARTITION BY id_disparo
              ORDER BY prefer DESC, registro_data_atualizacao DESC NULLS {nulls},
                       id_sistema_mask, envio_datahora, contato_telefone, cpf, status_disparo)"""
    )
    return chosen.withColumn("place", place).where("place = 1")
