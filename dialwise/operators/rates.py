"""Delivery rates with Wilson intervals, by any grouping.

All groupings here have few groups, so partial aggregation reduces every task's rows to one per
group before the shuffle, and a group that holds most of the rows costs no more than the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialwise.functions import age_bucket, age_bucket_order, clamp_age, wilson_bounds
from dialwise.session import bucketed


def success_total(flag: str) -> Column:
    """Number of successes of a 0/1 flag; 0 for a group in which every flag is null."""
    return F.coalesce(F.sum(F.col(flag).cast("bigint")), F.lit(0).cast("bigint"))


def with_rate(counted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Turn ``n`` and ``successes`` into ``n, rate, ci_low, ci_high`` next to the other columns."""
    low, high = wilson_bounds(F.col("successes"), F.col("n"), alpha)
    return counted.withColumns(
        {"rate": F.try_divide("successes", "n"), "ci_low": low, "ci_high": high}
    ).drop("successes")


def rate_with_interval(
    df: DataFrame, group_cols: list[str], success_col: str = "delivered", alpha: float = 0.05
) -> DataFrame:
    """Attempts, success rate and Wilson interval per group. Unknown outcomes count as attempts."""
    counted = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), success_total(success_col).alias("successes")
    )
    return with_rate(counted, alpha).select(*group_cols, "n", "rate", "ci_low", "ci_high")


def best_first(rates: DataFrame, *tie_breakers: str) -> DataFrame:
    """Sort a rate table by rate, then volume, both descending."""
    return rates.orderBy(F.desc("rate"), F.desc("n"), *tie_breakers)


def rates_by_system(events: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Delivery rate per attributed system."""
    known = events.where(F.col("id_sistema_mask").isNotNull())
    return best_first(rate_with_interval(known, ["id_sistema_mask"], alpha=alpha), "id_sistema_mask")


def phone_totals(events: DataFrame) -> DataFrame:
    """Events counted per phone and system.

    Counting first leaves one row per phone and system, so a join by phone never meets the raw events
    of a busy phone.
    """
    return events.groupBy("contato_telefone", "id_sistema_mask").agg(
        F.count(F.lit(1)).alias("n"), success_total("delivered").alias("successes")
    )


def phone_systems(phone_dim: DataFrame) -> DataFrame:
    """Phones with their number of systems, and how often the dimension lists them so."""
    return phone_dim.groupBy(
        F.col("telefone_numero").alias("contato_telefone"), "telefone_sistemas_quantidade"
    ).agg(F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class PhoneLayout:
    """Totals of events and the systems of phones, both kept bucketed by phone.

    Every rate that asks for both joins them without an exchange, as often as it is asked. What lies in
    a bucket is counted already, so a phone with most events is a few rows.
    """

    totals: DataFrame
    systems: DataFrame


def phone_layout(events: DataFrame, phone_dim: DataFrame) -> PhoneLayout:
    """Write the layout of the given events and dimension."""
    return PhoneLayout(
        bucketed(phone_totals(events), "contato_telefone", "phone_totals"),
        bucketed(phone_systems(phone_dim), "contato_telefone", "phone_systems"),
    )


def _by_phone_and_system(totals: DataFrame, systems: DataFrame, min_systems: int) -> DataFrame:
    """Totals per phone and system, with the number of qualifying dimension rows.

    ``copies`` keeps the meaning of a left join with a dimension that lists a phone more than once.
    """
    qualified = (
        systems.where(F.col("telefone_sistemas_quantidade") >= min_systems)
        .groupBy("contato_telefone")
        .agg(F.sum("rows").alias("copies"))
    )
    return totals.join(qualified, "contato_telefone", "left")


def rates_by_system_multi(
    events: DataFrame, phone_dim: DataFrame, min_systems: int = 2, alpha: float = 0.05
) -> DataFrame:
    """Delivery rate per system on phones that several systems know, against selection bias."""
    layout = PhoneLayout(phone_totals(events), phone_systems(phone_dim))
    return multi_rates_of_layout(layout, min_systems, alpha)


def multi_rates_of_layout(layout: PhoneLayout, min_systems: int = 2, alpha: float = 0.05) -> DataFrame:
    """As :func:`rates_by_system_multi`, from a layout."""
    counted = (
        _by_phone_and_system(layout.totals, layout.systems, min_systems)
        .where(F.col("copies").isNotNull())
        .groupBy("id_sistema_mask")
        .agg(
            F.sum(F.col("n") * F.col("copies")).alias("n"),
            F.sum(F.col("successes") * F.col("copies")).alias("successes"),
        )
    )
    rates = with_rate(counted, alpha).select("id_sistema_mask", "n", "rate", "ci_low", "ci_high")
    return best_first(rates, "id_sistema_mask")


def rates_by_system_compared(
    events: DataFrame, phone_dim: DataFrame, min_systems: int = 2, alpha: float = 0.05
) -> DataFrame:
    """Rates per system on all phones beside those on phones that several systems know.

    Both come from one pass over the events; a system without such phones has nulls beside it.
    """
    layout = PhoneLayout(phone_totals(events), phone_systems(phone_dim))
    return compared_rates_of_layout(layout, min_systems, alpha)


def compared_rates_of_layout(layout: PhoneLayout, min_systems: int = 2, alpha: float = 0.05) -> DataFrame:
    """As :func:`rates_by_system_compared`, from a layout."""
    known = layout.totals.where(F.col("id_sistema_mask").isNotNull())
    counted = (
        _by_phone_and_system(known, layout.systems, min_systems)
        .groupBy("id_sistema_mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum("successes").alias("successes"),
            F.sum(F.col("n") * F.col("copies")).alias("n_multi"),
            F.sum(F.col("successes") * F.col("copies")).alias("successes_multi"),
        )
    )
    low, high = wilson_bounds(F.col("successes"), F.col("n"), alpha)
    low_multi, high_multi = wilson_bounds(F.col("successes_multi"), F.col("n_multi"), alpha)
    present = F.col("n_multi").isNotNull()
    compared = counted.select(
        "id_sistema_mask",
        "n",
        F.try_divide("successes", "n").alias("rate"),
        low.alias("ci_low"),
        high.alias("ci_high"),
        "n_multi",
        F.try_divide("successes_multi", "n_multi").alias("rate_multi"),
        F.when(present, low_multi).alias("ci_low_multi"),
        F.when(present, high_multi).alias("ci_high_multi"),
    )
    return best_first(compared, "id_sistema_mask")


def aged_events(events: DataFrame) -> DataFrame:
    """Events with a known age, negative ages set to 0."""
    return events.where(F.col("age_days").isNotNull()).withColumn(
        "age_days", clamp_age(F.col("age_days"))
    )


def with_age_bucket(events: DataFrame) -> DataFrame:
    """Add the age bucket and its order to aged events."""
    age = F.col("age_days")
    return events.withColumns(
        {"age_bucket": age_bucket(age), "age_bucket_order": age_bucket_order(age)}
    )


def rates_by_age(events: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Delivery rate per bucket of record age, youngest first."""
    bucketed = with_age_bucket(aged_events(events))
    rates = rate_with_interval(bucketed, ["age_bucket", "age_bucket_order"], alpha=alpha)
    return rates.orderBy("age_bucket_order")
