"""Exact quantiles of groups of any size, by radix selection.

``percentile`` keeps every distinct value of a group in one buffer. Here a group is narrowed down level
by level: rows are counted by the next ``BITS`` bits of their value, the running count tells which of
these digits holds the wanted rank, and only rows that share the digits found so far are counted on the
next level. A level's counts are added up before their shuffle; what one task holds of a group is one
level, at most 2^BITS counters per rank, however many values there are. Nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialwise.session import broadcast_if_small, frozen

#: Bits of a digit; 64 bits are four levels of 16.
BITS = 16
_SIGN = -(1 << 63)


def _ranks(sizes: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """The ranks (from 1) that each quantile lies between, per group, with the weight of the upper one."""
    place = F.array(*[F.lit(float(q)) for q in quantiles])
    spread = sizes.select("*", F.posexplode(place).alias("which", "q"))
    exact = (F.col("size") - 1) * F.col("q")
    return spread.withColumn("weight", exact - F.floor(exact)).select(
        "*", F.explode(F.array(F.floor(exact) + 1, F.ceil(exact) + 1)).alias("rank")
    )


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    count: str | None = None,
    bits: int = BITS,
) -> DataFrame:
    """Per group of ``keys`` (nulls are a group) its ``size`` and an array ``quantiles``: the exact
    points of the whole-number column ``value``, interpolated between neighbours as ``percentile`` does.

    ``count`` names a column that says how often a row counts. Null values don't count; a group
    without values has no row.
    """
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must be between 0 and 1")
    if bits not in (4, 8, 16):
        raise ValueError("bits must be 4, 8 or 16")
    keys = list(keys)
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    # Unsigned order: the smallest long is 0. Equal values are one row, counted before the shuffle.
    counted = frozen(
        rows.where(F.col(value).isNotNull())
        .groupBy(group.alias("group"), F.col(value).cast("long").bitwiseXOR(F.lit(_SIGN)).alias("v"))
        .agg((F.sum(count) if count else F.count(F.lit(1))).cast("long").alias("n"))
        .where("n > 0"),
        "counted",
    )
    sizes = counted.groupBy("group").agg(F.sum("n").alias("size"))
    wanted = _ranks(sizes, quantiles).withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rank")})
    group_level = ["group", "prefix"]
    for level in range(64 // bits):
        shift = 64 - bits * (level + 1)
        prefix = F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned("v", shift + bits)
        digit = F.shiftrightunsigned("v", shift).bitwiseAND((1 << bits) - 1)
        wanted = frozen(wanted, "ranks")
        (asked,) = broadcast_if_small(wanted.select(*group_level).distinct())
        so_far = Window.partitionBy(*group_level).orderBy("digit")
        histogram = (
            counted.withColumn("prefix", prefix)
            .join(asked, group_level, "left_semi")
            .groupBy(*group_level, digit.alias("digit"))
            .agg(F.sum("n").alias("n"))
            .withColumn("until", F.sum("n").over(so_far))
        )
        below = F.col("until") - F.col("n")
        wanted = wanted.join(histogram, group_level).where(
            (below < F.col("left")) & (F.col("left") <= F.col("until"))
        )
        wanted = wanted.select(
            "group", "size", "which", "weight", "rank",
            (F.shiftleft("prefix", bits).bitwiseOR(F.col("digit"))).alias("prefix"),
            (F.col("left") - below).alias("left"),
        )
    found = wanted.withColumn("at", F.col("prefix").bitwiseXOR(F.lit(_SIGN)).cast("double"))
    ends = found.groupBy("group", "which").agg(
        F.any_value("size").alias("size"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.any_value("weight").alias("weight"),
    )
    point = (1 - F.col("weight")) * F.col("low") + F.col("weight") * F.col("high")
    whole = ends.groupBy("group").agg(
        F.any_value("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("which", point.alias("point")))).alias("points"),
    )
    return whole.select(*[F.col(f"group.{k}") for k in keys], "size", F.col("points.point").alias("quantiles"))
