"""Score candidate phones, keep the best record of each and rank the phones of every person.

The reference function scores one person per call. Here all people are scored in one job, and one
person is a filter on the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialwise.functions import clamp_age, recency_weight, whole_days_between
from dialwise.operators.ranking import ScoreParams
from dialwise.session import broadcast_if_small, frozen

SCORED_COLUMNS = [
    "cpf",
    "telefone",
    "id_sistema_mask",
    "registro_data_atualizacao",
    "telefone_ddd",
    "final_score",
]


@dataclass(frozen=True)
class CandidateColumns:
    """Names of the candidate columns, for tables that call them otherwise."""

    person: str = "cpf"
    phone: str = "telefone"
    system: str = "id_sistema_mask"
    updated: str = "registro_data_atualizacao"
    area: str | None = "telefone_ddd"

    def renames(self) -> dict[str, str]:
        names = [self.person, self.phone, self.system, self.updated, self.area]
        return {own: ours for own, ours in zip(names, SCORED_COLUMNS) if own is not None}


def score_candidates(
    candidates: DataFrame,
    ranking: DataFrame,
    now: datetime,
    params: ScoreParams = ScoreParams(),
    bonus: DataFrame | None = None,
    clamp_future: bool = False,
) -> DataFrame:
    """Add ``age_days``, ``recency_weight``, ``base_score`` and ``final_score`` to candidates.

    ``final_score`` is system score x recency weight x (1 + area bonus). A system without a rank
    scores 0, an area without a bonus gets none. Records dated after ``now`` weigh more than 1
    unless ``clamp_future`` is set.

    ``ranking`` and ``bonus`` have one row per system and per area code; they are broadcast when
    a count shows that they are small.
    """
    learned = [ranking.select("id_sistema_mask", F.col("score").alias("system_score"))]
    if bonus is not None:
        learned.append(bonus.selectExpr("CAST(telefone_ddd AS STRING) AS area", "ddd_bonus"))
    systems, *areas = broadcast_if_small(*learned)
    age = whole_days_between(F.col("registro_data_atualizacao"), instant(now)).cast("double")
    out = (
        candidates.join(systems, "id_sistema_mask", "left")
        .withColumns(
            {
                "system_score": F.coalesce("system_score", F.lit(0.0)),
                "age_days": clamp_age(age) if clamp_future else age,
            }
        )
        .withColumn("recency_weight", recency_weight(F.col("age_days"), params.half_life_days))
        .withColumn("base_score", F.col("system_score") * F.col("recency_weight"))
    )
    if not areas:
        return out.withColumn("final_score", F.col("base_score"))
    return (
        out.withColumn("area", F.col("telefone_ddd").cast("string"))
        .join(areas[0], "area", "left")
        .drop("area")
        .withColumn("ddd_bonus", F.coalesce("ddd_bonus", F.lit(0.0)))
        .withColumn("final_score", F.col("base_score") * (1 + F.col("ddd_bonus")))
    )


def instant(now: datetime) -> Column:
    """A wall-clock literal, whatever time zones the driver and the session have."""
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def best_row_per_phone(scored: DataFrame) -> DataFrame:
    """The best record of each phone of a person: highest score, then latest update.

    Spark keeps one row per phone and task before the shuffle, so copies of a phone stay cheap.
    """
    same_phone = Window.partitionBy("cpf", "telefone").orderBy(
        F.desc_nulls_last("final_score"),
        F.desc_nulls_last("registro_data_atualizacao"),
        "id_sistema_mask",
        "telefone_ddd",
    )
    return (
        scored.select(*SCORED_COLUMNS)
        .withColumn("place", F.row_number().over(same_phone))
        .where("place = 1")
        .drop("place")
    )


def _best_phone_first() -> list[Column]:
    return [F.desc_nulls_last("final_score"), F.asc("telefone")]


def top_phones(phones: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` best phones of every person with their rank.

    Spark keeps ``k`` rows per person and task before the shuffle, so nobody's list is too long.
    """
    person = Window.partitionBy("cpf").orderBy(*_best_phone_first())
    return (
        phones.withColumn("rank", F.row_number().over(person))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def rank_phones(phones: DataFrame) -> DataFrame:
    """Every phone of every person with its rank 1..n."""
    return rank_in_groups(phones, "cpf", _best_phone_first(), "rank")


def rank_in_groups(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group 1..n by ``order``, however large a group is.

    A window would sort a whole group in one task. Instead the rows are sorted globally by group
    and ``order``: the range exchange spreads a large group over several partitions. While they
    stream by, the rows are numbered within their group and partition, and then frozen: the one
    shuffle of the rows. Groups that span partitions are at most one per partition boundary; a
    small table tells how many rows of them lie in the partitions before. ``group`` must not be
    null.
    """
    sorted_rows = df.orderBy(group, *order)
    numbered = sorted_rows.mapInArrow(
        _number_runs(group, name), T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    )
    placed = frozen(numbered.withColumn("_part", F.spark_partition_id()), "ranked")
    in_group = Window.partitionBy(group)
    before = in_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = placed.groupBy("_part").agg(F.min(group).alias("first"), F.max(group).alias("last"))
    # At most two groups per partition reach its edges: its first one and its last one.
    at_edge = edges.select("_part", F.explode(F.array_distinct(F.array("first", "last"))).alias(group))
    spanning = (
        placed.join(F.broadcast(at_edge), ["_part", group])
        .groupBy(group, "_part")
        .agg(F.max(name).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(before))
        .where("_before > 0")
        .select(group, "_part", "_before")
    )
    return (
        placed.join(F.broadcast(frozen(spanning, "spanning")), [group, "_part"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def _number_runs(group: str, name: str):
    """Number the rows of each run of equal groups from 1, batch by batch."""

    def run(batches):
        last, so_far = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(group).dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code)))) + 1
            if codes.dictionary[int(code[0])] == last:
                place[: starts[1] if len(starts) > 1 else len(code)] += so_far
            last, so_far = codes.dictionary[int(code[-1])], int(place[-1])
            columns = [*batch.columns, pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return run


def score_phones(
    candidates: DataFrame,
    ranking: DataFrame,
    now: datetime,
    params: ScoreParams = ScoreParams(),
    bonus: DataFrame | None = None,
    clamp_future: bool = False,
    top: int | None = None,
    columns: CandidateColumns = CandidateColumns(),
) -> DataFrame:
    """Score, keep the best record per phone and rank; only the ``top`` best where given.

    Without an area column no bonus applies and the result has no area either.
    """
    own = columns.renames()
    named = candidates.select(*own).withColumnsRenamed(own)
    if columns.area is None:
        named, bonus = named.withColumn("telefone_ddd", F.lit(None).cast("string")), None
    systems = ranking.withColumnRenamed(columns.system, "id_sistema_mask")
    phones = best_row_per_phone(
        score_candidates(named, systems, now, params, bonus, clamp_future)
    )
    ranked = rank_phones(phones) if top is None else top_phones(phones, top)
    out = ranked if columns.area is not None else ranked.drop("telefone_ddd")
    return out.withColumnsRenamed({ours: name for name, ours in own.items()})


def top_phones_regrouped(scored: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` best phones from rows that may list a phone more than once.

    Takes the highest score and the latest update of each phone, and the system and area code
    of its best row.
    """
    best = F.struct(
        "final_score",
        "registro_data_atualizacao",
        "id_sistema_mask",
        "telefone_ddd",
    )
    phones = (
        scored.groupBy("cpf", "telefone")
        .agg(
            F.max("final_score").alias("final_score"),
            F.max("registro_data_atualizacao").alias("registro_data_atualizacao"),
            F.max(best).alias("best"),
        )
        .select(
            "cpf",
            "telefone",
            "final_score",
            "registro_data_atualizacao",
            "best.id_sistema_mask",
            "best.telefone_ddd",
        )
    )
    return top_phones(phones, k).drop("rank")


def top_check(top: DataFrame, phones: DataFrame, k: int = 2) -> DataFrame:
    """Per person: phones owned, rows chosen, different phones chosen, and whether that is right.

    Right are ``k`` different phones, or all of them where a person has fewer.
    """
    chosen = top.groupBy("cpf").agg(
        F.count(F.lit(1)).alias("linhas_top2"),
        F.count_distinct("telefone").alias("telefones_distintos"),
    )
    owned = phones.groupBy("cpf").agg(F.count_distinct("telefone").alias("telefones"))
    due = F.least(F.col("telefones"), F.lit(k))
    zero = F.lit(0).cast("bigint")
    return (
        owned.join(chosen, "cpf", "left")
        .withColumns(
            {
                "linhas_top2": F.coalesce("linhas_top2", zero),
                "telefones_distintos": F.coalesce("telefones_distintos", zero),
            }
        )
        .withColumn("ok", (F.col("linhas_top2") == due) & (F.col("telefones_distintos") == due))
    )
