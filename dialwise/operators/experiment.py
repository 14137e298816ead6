"""Plan, run and evaluate the A/B test of the phone choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialwise.functions import (
    delivered_flag,
    poisson_one,
    sample_size,
    two_proportion_z,
    uniform,
    upper_tail,
    wilson_bounds,
)
from dialwise.operators.quantiles import exact_quantiles
from dialwise.operators.ranking import roll_up
from dialwise.session import frozen

CONTROL, TREATMENT = "controle", "tratamento"
# Tasks that share the replicates of a bootstrap.
TASKS = 64


# Planning


def baseline_segments(profile: DataFrame) -> DataFrame:
    """Baseline rate of all events, of each system and of each area code, from a profile."""
    segments = F.array(
        F.struct(F.lit("todos").alias("segmento"), F.lit("todos").alias("valor")),
        F.struct(
            F.lit("sistema").alias("segmento"),
            F.col("id_sistema_mask").cast("string").alias("valor"),
        ),
        F.struct(
            F.lit("ddd").alias("segmento"), F.col("telefone_ddd").cast("string").alias("valor")
        ),
    )
    in_segments = profile.withColumn("s", F.explode(segments)).select("*", "s.*")
    return (
        roll_up(in_segments.where(F.col("valor").isNotNull()), "segmento", "valor")
        .select("segmento", "valor", F.try_divide("successes", "flagged").alias("baseline_p"))
    )


def citizen_baseline(events: DataFrame) -> DataFrame:
    """Share of the people with a known outcome who got at least one message: one row."""
    people = events.where(F.col("cpf").isNotNull() & F.col("delivered").isNotNull())
    reached = people.groupBy("cpf").agg(F.max("delivered").alias("reached"))
    return reached.agg(F.avg("reached").alias("baseline_p"))


def with_sample_size(
    baselines: DataFrame,
    lift: float = 0.01,
    cap: float = 0.99,
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """Add the target rate (baseline plus an absolute lift, capped) and the units per arm."""
    baseline = F.col("baseline_p")
    target = F.when(baseline.isNotNull(), F.least(F.lit(cap), baseline + F.lit(lift)))
    return baselines.withColumn("p_t", target).withColumn(
        "n_per_group", sample_size(baseline, F.col("p_t"), alpha, power)
    )


def daily_people(dispatch: DataFrame) -> DataFrame:
    """Mean number of different people per send day: one row."""
    return (
        dispatch.groupBy(F.to_date("envio_datahora").alias("envio_data"))
        .agg(F.count_distinct("cpf").alias("pessoas"))
        .where(F.col("envio_data").isNotNull())
        .agg(F.avg("pessoas").alias("pessoas_por_dia"))
    )


def duration_days(n_per_group: Column, people_per_day: Column) -> Column:
    """Days until both arms are full."""
    return F.try_divide(2 * n_per_group, people_per_day)


# Assignment and choice


def arm_of(person: Column, seed: int = 42) -> Column:
    """Arm of a person, by chance of the seed and the person alone."""
    return F.when(uniform(seed, person) < 0.5, F.lit(CONTROL)).otherwise(F.lit(TREATMENT))


def assign_arms(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """Every person that has a phone, with the arm."""
    return candidates.select("cpf").distinct().withColumn("arm", arm_of(F.col("cpf"), seed))


def random_phones(candidates: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """``k`` phones of every person by chance: what the control arm sends to."""
    drawn = Window.partitionBy("cpf").orderBy("draw", "telefone")
    draw = F.md5(
        F.concat_ws(
            "|", F.lit(str(seed)), F.col("cpf").cast("string"), F.col("telefone").cast("string")
        )
    )
    return (
        candidates.select("cpf", "telefone")
        .distinct()
        .withColumn("draw", draw)
        .withColumn("rank", F.row_number().over(drawn))
        .where(F.col("rank") <= k)
        .select("cpf", "telefone", F.col("rank").cast("bigint").alias("rank"))
    )


# Evaluation


def last_outcomes(dispatch: DataFrame, picks: DataFrame | None = None) -> DataFrame:
    """Outcome of the latest dispatch per person and phone, of the picked ones where given."""
    if picks is not None:
        pairs = picks.select("cpf", F.col("telefone").alias("contato_telefone"))
        dispatch = dispatch.join(pairs, ["cpf", "contato_telefone"], "left_semi")
    last = F.max(
        F.struct("envio_datahora", "id_disparo", "status_disparo", "descricao_falha")
    ).alias("last")
    return (
        dispatch.where(F.col("cpf").isNotNull() & F.col("contato_telefone").isNotNull())
        .groupBy("cpf", F.col("contato_telefone").alias("telefone"))
        .agg(last)
        .select("cpf", "telefone", "last.*")
        .withColumns(
            {
                "delivered": delivered_flag(F.col("status_disparo")),
                "envio_data": F.to_date("envio_datahora"),
            }
        )
    )


def attempts(picks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Picked phones (arm, cpf, telefone) with their outcome; one never dispatched is no attempt."""
    return picks.select("arm", "cpf", "telefone").join(outcomes, ["cpf", "telefone"])


def _person_rates(tries: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    people = tries.groupBy(*keys, "cpf").agg(
        F.coalesce(F.max("delivered"), F.lit(0)).alias("reached"),
        F.count(F.lit(1)).alias("tries"),
        F.coalesce(F.sum("delivered"), F.lit(0)).alias("arrived"),
    )
    low, high = wilson_bounds(F.col("alcancados"), F.col("pessoas"), alpha)
    return (
        people.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("pessoas"),
            F.sum("reached").alias("alcancados"),
            F.sum("tries").alias("tentativas"),
            F.sum("arrived").alias("entregas"),
        )
        .withColumns(
            {
                "rate": F.try_divide("alcancados", "pessoas"),
                "ci_low": low,
                "ci_high": high,
            }
        )
    )


def primary_metric(tries: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of people per arm with at least one delivery in their attempts."""
    rates = _person_rates(tries, ["arm"], alpha)
    return rates.select("arm", "pessoas", "alcancados", "rate", "ci_low", "ci_high")


def secondary_metrics(tries: DataFrame) -> DataFrame:
    """Delivery rate per attempt and attempts per delivery, per arm."""
    return (
        tries.groupBy("arm")
        .agg(
            F.count(F.lit(1)).alias("tentativas"),
            F.coalesce(F.sum("delivered"), F.lit(0)).alias("entregas"),
        )
        .withColumns(
            {
                "rate": F.try_divide("entregas", "tentativas"),
                "custo_por_entrega": F.try_divide("tentativas", "entregas"),
            }
        )
    )


def failure_reasons(tries: DataFrame) -> DataFrame:
    """Failed attempts per arm and reason, with their share of the arm's attempts."""
    failed = F.when(F.col("delivered") == 0, F.lit(1)).otherwise(F.lit(0))
    # Frozen, so that the totals do not compute all attempts a second time.
    per_reason = frozen(
        tries.groupBy("arm", "descricao_falha").agg(
            F.sum(failed).alias("falhas"), F.count(F.lit(1)).alias("rows")
        )
    )
    totals = per_reason.groupBy("arm").agg(F.sum("rows").alias("tentativas"))
    return (
        per_reason.where(F.col("falhas") > 0)
        .join(totals, "arm")
        .select(
            "arm",
            "descricao_falha",
            "falhas",
            F.try_divide("falhas", "tentativas").alias("share"),
        )
    )


def daily_metrics(tries: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Primary metric and attempt totals per arm and send day, for monitoring."""
    return _person_rates(tries, ["arm", "envio_data"], alpha)


def guardrails(tries: DataFrame, phones: DataFrame, valid: str = "VALIDO") -> DataFrame:
    """Per arm and send day: attempts, those at phones whose validation speaks against them, and
    the shares of these and of failures.

    ``phones`` has ``telefone`` and ``validacao_telefone``, one row per phone.
    """
    invalid = F.sum(F.when(F.col("validacao_telefone") != valid, 1).otherwise(0))
    failed = F.sum(F.when(F.col("delivered") == 0, 1).otherwise(0))
    return (
        tries.join(phones.select("telefone", "validacao_telefone"), "telefone", "left")
        .groupBy("arm", "envio_data")
        .agg(F.count(F.lit(1)).alias("tentativas"), invalid.alias("invalidas"), failed.alias("falhas"))
        .select(
            "arm",
            "envio_data",
            "tentativas",
            "invalidas",
            F.try_divide("invalidas", "tentativas").alias("taxa_invalidas"),
            F.try_divide("falhas", "tentativas").alias("taxa_falhas"),
        )
    )


def response_times(tries: DataFrame, responded: str) -> DataFrame:
    """Median and 90 % point of seconds from send to response per arm, where a response exists.

    Exact, to the microsecond, by radix selection: no task holds an arm's waits.
    """
    waited = F.unix_micros(F.col(responded).cast("timestamp")) - F.unix_micros(
        F.col("envio_datahora").cast("timestamp")
    )
    waits = tries.select("arm", waited.alias("micros"))
    return exact_quantiles(waits, ["arm"], "micros", [0.5, 0.9]).select(
        "arm",
        F.col("size").alias("respostas"),
        *[
            (F.col("quantiles")[i] / 1e6).alias(f"seconds_{name}") for i, name in enumerate(("p50", "p90"))
        ],
    )


def bootstrap_rate_diff(
    units: DataFrame,
    arm_a: str = TREATMENT,
    arm_b: str = CONTROL,
    n_boot: int = 5000,
    seed: int = 42,
    buckets: int = 200,
) -> DataFrame:
    """Mean and 95 % interval of the difference of two means, ``arm_a`` minus ``arm_b``: one row.

    ``units`` has columns ``unit``, ``arm`` and ``y``. Units fall into ``buckets`` by chance, each
    replicate weighs each bucket by a Poisson(1) count, and only bucket sums are resampled: the
    work per replicate does not depend on the number of units. An empty arm gives NaN.
    """
    bucket = F.floor(uniform(seed, F.lit("bucket"), F.col("unit")) * buckets)
    sums = (
        units.where(F.col("y").isNotNull() & F.col("arm").isin(arm_a, arm_b))
        .groupBy("arm", bucket.alias("bucket"))
        .agg(F.sum(F.col("y").cast("double")).alias("y"), F.count(F.lit(1)).alias("n"))
    )
    weight = poisson_one(uniform(seed, F.col("arm"), F.col("bucket"), F.col("rep")))

    def mean_of(arm: str) -> Column:
        here = F.col("arm") == arm
        return F.try_divide(
            F.sum(F.when(here, F.col("w") * F.col("y"))),
            F.sum(F.when(here, F.col("w") * F.col("n"))),
        )

    # The sums, at most two rows per bucket, go to every task as one value; the replicates are dealt.
    held = sums.agg(F.collect_list(F.struct("arm", "bucket", "y", "n")).alias("sums"))
    diffs = (
        units.sparkSession.range(1, n_boot + 1, 1, TASKS)
        .select(F.col("id").alias("rep"), held.scalar().alias("sums"))
        .select("rep", F.inline("sums"))
        .withColumn("w", weight)
        .groupBy("rep")
        .agg((mean_of(arm_a) - mean_of(arm_b)).alias("diff"))
    )
    nan = F.lit(float("nan"))
    return diffs.agg(
        F.coalesce(F.avg("diff"), nan).alias("diff_mean"),
        F.coalesce(F.percentile("diff", F.lit(0.025)), nan).alias("ci_low"),
        F.coalesce(F.percentile("diff", F.lit(0.975)), nan).alias("ci_high"),
    )


# Decision


def primary_test(primary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The test of the stated hypotheses (treatment at most as good against better): one row.

    ``primary`` is the result of :func:`primary_metric`. The statistic is that of two proportions with
    pooled variance, the p-value its upper tail. An empty arm, or one outcome for all, decides nothing:
    statistic and p-value are null then, and ``rejects`` is false.
    """
    of = {
        f"{name}_{short}": F.max(F.when(F.col("arm") == arm, F.col(name)))
        for arm, short in ((CONTROL, "c"), (TREATMENT, "t"))
        for name in ("pessoas", "alcancados")
    }
    zero = F.lit(0).cast("bigint")
    both = primary.agg(*[F.coalesce(c, zero).alias(name) for name, c in of.items()])
    z = two_proportion_z(*[F.col(c) for c in ("alcancados_t", "pessoas_t", "alcancados_c", "pessoas_c")])
    p = upper_tail(F.col("z"))
    return (
        both.withColumn("z", z)
        .withColumn("p_value", p)
        .select(
            *of,
            (F.try_divide("alcancados_t", "pessoas_t") - F.try_divide("alcancados_c", "pessoas_c")).alias(
                "diff"
            ),
            "z",
            "p_value",
            F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("rejects"),
        )
    )


def daily_totals(tries: DataFrame) -> DataFrame:
    """Per send day and arm the people whose first attempt, and first delivery, was that day."""
    reached = F.when(F.col("delivered") == 1, F.col("envio_data"))
    people = (
        tries.where(F.col("envio_data").isNotNull())
        .groupBy("arm", "cpf")
        .agg(F.min("envio_data").alias("first"), F.min(reached).alias("got"))
    )
    steps = F.array(
        F.struct(F.col("first").alias("envio_data"), F.lit(1).alias("new"), F.lit(0).alias("won")),
        F.struct(F.col("got").alias("envio_data"), F.lit(0).alias("new"), F.lit(1).alias("won")),
    )
    return (
        people.select("arm", F.inline(steps))
        .where(F.col("envio_data").isNotNull())
        .groupBy("arm", "envio_data")
        .agg(F.sum("new").alias("pessoas"), F.sum("won").alias("alcancados"))
    )


def sequential_monitor(tries: DataFrame, planned: int, alpha: float = 0.05) -> DataFrame:
    """The difference of the arms at the end of every send day, with a lower bound that may be looked at
    daily: with a chance of at least 1 - ``alpha`` it is right on all days at once (a normal mixture
    confidence sequence, asymptotic), so stopping on the first day it exceeds 0 keeps the level.

    ``planned`` is the number of people of both arms at which the bound is tightest. One row per day on
    which both arms have people: cumulative people and successes, ``diff``, ``lower``, ``stop``.
    """
    arms = ((CONTROL, "c"), (TREATMENT, "t"))
    names = ("pessoas", "alcancados")
    daily = daily_totals(tries).groupBy("envio_data").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("arm") == arm, F.col(name))), F.lit(0)).alias(f"{name}_{short}")
            for arm, short in arms
            for name in names
        ]
    )
    # One row per day: the calendar bounds what the running totals sort.
    so_far = Window.orderBy("envio_data").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [f"{name}_{short}" for _, short in arms for name in names]
    running = daily.select("envio_data", *[F.sum(c).over(so_far).alias(c) for c in totals])
    rate = {s: F.col(f"alcancados_{s}") / F.col(f"pessoas_{s}") for s in "ct"}
    spread = sum(rate[s] * (1 - rate[s]) / F.col(f"pessoas_{s}") for s in "ct")
    n = (F.col("pessoas_c") + F.col("pessoas_t")).cast("double")
    log = -2 * math.log(alpha)
    rho = F.lit((log + math.log(log) + 1) / planned)
    mixed = n * rho + 1
    reach = F.sqrt(2 * mixed / (n * rho) * F.ln(1 + F.sqrt(mixed) / (2 * alpha)) * spread)
    return (
        running.where("pessoas_c > 0 AND pessoas_t > 0")
        .withColumn("diff", rate["t"] - rate["c"])
        .withColumn("lower", F.col("diff") - reach)
        .withColumn("stop", F.col("lower") > 0)
    )


def opt_outs(tries: DataFrame, complaints: DataFrame, within_days: int = 30) -> DataFrame:
    """Per arm the people who complained or opted out up to ``within_days`` days after an attempt.

    ``complaints`` has ``cpf`` and ``dia``, a row per complaint. Attempts are reduced to one row per
    person and day before they meet the complaints of that person.
    """
    sent = tries.where(F.col("cpf").isNotNull()).groupBy("arm", "cpf").agg(
        F.collect_set("envio_data").alias("days")
    )
    said = complaints.where(F.col("cpf").isNotNull() & F.col("dia").isNotNull()).groupBy("cpf").agg(
        F.collect_set("dia").alias("said")
    )
    after = F.exists(
        "days", lambda d: F.exists("said", lambda s: (s >= d) & (s <= F.date_add(d, within_days)))
    )
    return (
        sent.join(said, "cpf", "left")
        .withColumn("left", F.coalesce(after, F.lit(False)).cast("int"))
        .groupBy("arm")
        .agg(F.count(F.lit(1)).alias("pessoas"), F.sum("left").alias("saidas"))
        .withColumn("taxa_saidas", F.try_divide("saidas", "pessoas"))
    )


def clustered_rate_diff(
    units: DataFrame,
    arm_a: str = TREATMENT,
    arm_b: str = CONTROL,
    n_boot: int = 5000,
    seed: int = 42,
    buckets: int = 200,
) -> DataFrame:
    """The difference of two rates, its standard error and a studentised 95 % interval: one row.

    ``units`` has ``unit``, ``arm`` and ``y``. All rows of a unit (a person's dispatches) fall into one
    of ``buckets`` buckets by chance, and whole buckets are resampled, so rows of a unit may depend on
    each other. Each replicate divides its deviation by its own standard error (that of a ratio of
    bucket sums); the interval takes the quantiles of these from the observed difference.
    """
    bucket = F.floor(uniform(seed, F.lit("bucket"), F.col("unit")) * buckets)
    sums = frozen(
        units.where(F.col("y").isNotNull() & F.col("arm").isin(arm_a, arm_b))
        .groupBy("arm", bucket.alias("bucket"))
        .agg(F.sum(F.col("y").cast("double")).alias("y"), F.count(F.lit(1)).alias("n")),
        "bucket-sums",
    )
    held = sums.agg(F.collect_list(F.struct("arm", "bucket", "y", "n")).alias("sums"))
    # Replicate 0 is what was observed: every bucket once.
    draws = units.sparkSession.range(0, n_boot + 1, 1, TASKS).select(
        F.col("id").alias("rep"), F.inline(held.scalar())
    )
    drawn = poisson_one(uniform(seed, F.col("arm"), F.col("bucket"), F.col("rep")))
    weighed = draws.withColumn("w", F.when(F.col("rep") == 0, F.lit(1.0)).otherwise(drawn))
    moments = weighed.groupBy("rep", "arm").agg(
        *[
            F.sum(F.col("w") * value).alias(name)
            for name, value in (
                ("y", F.col("y")), ("n", F.col("n")), ("yy", F.col("y") * F.col("y")),
                ("yn", F.col("y") * F.col("n")), ("nn", F.col("n") * F.col("n")),
            )
        ]
    )
    rate = F.try_divide("y", "n")
    spread = F.try_divide(F.col("yy") - 2 * rate * F.col("yn") + rate * rate * F.col("nn"), F.col("n") * F.col("n"))
    arms = moments.select("rep", "arm", rate.alias("rate"), F.greatest(F.lit(0.0), spread).alias("spread"))
    sign = F.when(F.col("arm") == arm_a, F.lit(1.0)).otherwise(F.lit(-1.0))
    by_rep = arms.groupBy("rep").agg(
        F.when(F.count("rate") == 2, F.sum(sign * F.col("rate"))).alias("diff"),
        F.when(F.count("rate") == 2, F.sqrt(F.sum("spread"))).alias("se"),
    )
    by_rep = frozen(by_rep, "replicates")
    seen = by_rep.where("rep = 0").agg(F.struct(F.max("diff").alias("diff"), F.max("se").alias("se")).alias("o"))
    studentised = (
        by_rep.where("rep > 0 AND diff IS NOT NULL AND se > 0")
        .withColumn("o", seen.scalar())
        .withColumn("t", (F.col("diff") - F.col("o.diff")) / F.col("se"))
    )
    ends = studentised.agg(
        F.percentile("t", F.lit(0.025)).alias("low"), F.percentile("t", F.lit(0.975)).alias("high")
    )
    nan = F.lit(float("nan"))
    return ends.withColumn("o", seen.scalar()).select(
        F.coalesce("o.diff", nan).alias("diff"),
        F.coalesce("o.se", nan).alias("se"),
        F.coalesce(F.col("o.diff") - F.col("high") * F.col("o.se"), nan).alias("ci_low"),
        F.coalesce(F.col("o.diff") - F.col("low") * F.col("o.se"), nan).alias("ci_high"),
    )
