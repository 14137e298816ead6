"""One query per operator over the tables of :mod:`dialwise.plans.tables`.

Doubles are rounded, so that the last digits, which depend on the order of a sum, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialwise.functions import (
    delivered_flag,
    error_extents,
    recency_weight,
    uniform,
    whole_days_between,
    wilson_bounds,
)
from dialwise.operators import appearances as ap
from dialwise.operators import attribution as at
from dialwise.operators import decay as dc
from dialwise.operators import experiment as ex
from dialwise.operators import logit as lg
from dialwise.operators import profiles as pf
from dialwise.operators import ranking as rk
from dialwise.operators import rates as rt
from dialwise.operators import scoring as sc
from dialwise.plans import tables as t
from dialwise.plans.choice import (
    choose_phones,
    experiment_picks,
    fitted_half_life,
    learned_tables,
)
from dialwise.plans.store import EventStore
from dialwise.schemas import PHONE_ATTRIBUTES
from dialwise.session import frozen, new_table_path
from dialwise.sources import (
    find_table,
    lookup_candidates,
    read_events,
    write_candidates,
    write_events,
)


def _r(name: str, places: int = 9) -> Column:
    return F.round(name, places).alias(name)


def _rate() -> list:
    return ["n", _r("rate"), _r("ci_low"), _r("ci_high")]


def _events_with_area(spark: SparkSession, d: str) -> DataFrame:
    return t.events(spark, d, "telefone_ddd")


# Sources


def scan_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return t.dispatch(spark, d)


def scan_phone_dim(spark: SparkSession, d: str) -> DataFrame:
    # As text, so that the contents of the lists are compared, in whatever order they are.
    listed = F.expr(
        """array_join(array_sort(transform(telefone_aparicoes, x -> concat_ws('|', x.id_sistema,
             coalesce(date_format(x.registro_data_atualizacao, 'yyyy-MM-dd HH:mm:ss'), '-'), x.cpf))),
             ',')"""
    )
    return t.phone_dim(spark, d).withColumn("telefone_aparicoes", listed)


def scan_discovered(spark: SparkSession, d: str) -> DataFrame:
    return find_table(spark, d, "order").select("o_orderkey", "o_custkey", "o_orderstatus")


def events_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = write_events(attribute_system(spark, d), new_table_path(spark, "events"))
    return read_events(spark, path)


def _first_load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The log and the dimension as an earlier load may have had them: the last year of dispatches is
    missing, and a fifth of the systems have not reported yet."""
    sent, listed = t.dispatch(spark, d), t.appearances(spark, d)
    before = sent.where("envio_datahora < TIMESTAMP_NTZ'2000-08-01' OR envio_datahora IS NULL")
    return before, listed.where("id_sistema_mask IS NULL OR id_sistema_mask % 5 <> 0")


def _store(spark: SparkSession, d: str) -> EventStore:
    """A new event store; the log has few dispatches a day, so it is kept by month."""
    return EventStore(spark, new_table_path(spark, "store"), unit="month")


def events_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The events of a store loaded in two steps."""
    store = _store(spark, d)
    store.update(*_first_load(spark, d))
    store.update(t.dispatch(spark, d), t.appearances(spark, d))
    return store.read()


def profile_system_rates(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    store.update(t.dispatch(spark, d), t.appearances(spark, d))
    profile = store.read("profiles")
    return pf.system_rates(profile).select("id_sistema_mask", *_rate())


def _daily_profile(spark: SparkSession, d: str) -> DataFrame:
    """A profile merged from those of odd and of even days."""
    profile = frozen(pf.daily_profile(_events_with_area(spark, d)), "profile")
    odd = F.coalesce(F.day("envio_data") % 2 == 1, F.lit(False))
    return pf.merged(profile.where(odd), profile.where(~odd))


def profile_age_rates(spark: SparkSession, d: str) -> DataFrame:
    return pf.age_rates(_daily_profile(spark, d)).select("age_bucket", "age_bucket_order", *_rate())


def profile_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = rk.rank_profile(_daily_profile(spark, d))
    return ranked.select(
        "id_sistema_mask", "n", "successes", _r("mean_age_days"), _r("posterior_mean"), _r("score")
    )


def profile_area_rates(spark: SparkSession, d: str) -> DataFrame:
    return rk.area_rates_of_profile(_daily_profile(spark, d)).select("telefone_ddd", "n", _r("rate"))


def profile_baseline(spark: SparkSession, d: str) -> DataFrame:
    return pf.baseline(_daily_profile(spark, d)).select(_r("baseline_p"))


def profile_daily(spark: SparkSession, d: str) -> DataFrame:
    return pf.daily_rates(_daily_profile(spark, d)).select("envio_data", *_rate())


def people_by_system(spark: SparkSession, d: str) -> DataFrame:
    """Different people per system: exact, and whether the united daily sketches come close to it."""
    events = frozen(t.events(spark, d), "events")
    sketched = pf.estimated_people(pf.people_sketches(events), "id_sistema_mask")
    counted = events.groupBy("id_sistema_mask").agg(F.count_distinct("cpf").alias("exact"))
    close = F.abs(F.col("people") - F.col("exact")) <= pf.error_bound(F.col("exact"))
    system = F.col("a.id_sistema_mask")
    both = counted.alias("a").join(
        sketched.alias("b"), system.eqNullSafe(F.col("b.id_sistema_mask")), "left"
    )
    return both.select(system, "exact", F.coalesce(close, F.col("exact") == 0).alias("close"))


# Preparation


def delivered_flags(spark: SparkSession, d: str) -> DataFrame:
    sent = t.dispatch(spark, d)
    return sent.select(
        "id_disparo", "status_disparo", delivered_flag(F.col("status_disparo")).alias("delivered")
    )


def explode_appearances(spark: SparkSession, d: str) -> DataFrame:
    return ap.explode_appearances(t.phone_dim(spark, d))


def enrich_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return at.enrich_dispatch(t.dispatch(spark, d), t.appearances(spark, d)).select(
        "id_disparo",
        "contato_telefone",
        "status_disparo",
        "delivered",
        "envio_datahora",
        "envio_data",
        "prefer",
        "fan_out",
        "valid_at_send",
    )


def attribute_system(spark: SparkSession, d: str) -> DataFrame:
    return t.events(spark, d, *PHONE_ATTRIBUTES)


def filter_not_null(spark: SparkSession, d: str) -> DataFrame:
    return (
        t.events(spark, d)
        .where(F.col("id_sistema_mask").isNotNull())
        .select("id_disparo", "id_sistema_mask", "age_days")
    )


# Rates


def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    flagged = at.with_send_day(t.dispatch(spark, d))
    low, high = wilson_bounds(F.col("successes"), F.col("n"))
    return (
        flagged.groupBy("contato_telefone")
        .agg(F.count("delivered").alias("n"), rt.success_total("delivered").alias("successes"))
        .select("contato_telefone", "n", "successes", low.alias("ci_low"), high.alias("ci_high"))
        # A phone without a known outcome has no interval (NaN on both sides).
        .select("contato_telefone", "n", "successes", F.isnan("ci_low").alias("no_interval"), *[
            F.when(F.isnan(c), None).otherwise(F.round(c, 9)).alias(c) for c in ("ci_low", "ci_high")
        ])
    )


def rates_system(spark: SparkSession, d: str) -> DataFrame:
    return rt.rates_by_system(t.events(spark, d)).select("id_sistema_mask", *_rate())


def rates_system_multi(spark: SparkSession, d: str) -> DataFrame:
    rates = rt.rates_by_system_multi(t.events(spark, d), t.phone_system_counts(spark, d))
    return rates.select("id_sistema_mask", *_rate())


def rates_multi_layout(spark: SparkSession, d: str) -> DataFrame:
    layout = rt.phone_layout(t.events(spark, d), t.phone_system_counts(spark, d))
    return rt.multi_rates_of_layout(layout).select("id_sistema_mask", *_rate())


def rates_system_compare(spark: SparkSession, d: str) -> DataFrame:
    both = rt.rates_by_system_compared(t.events(spark, d), t.phone_system_counts(spark, d))
    return both.select(
        "id_sistema_mask",
        *_rate(),
        "n_multi",
        _r("rate_multi"),
        _r("ci_low_multi"),
        _r("ci_high_multi"),
    )


def age_buckets(spark: SparkSession, d: str) -> DataFrame:
    bucketed = rt.with_age_bucket(rt.aged_events(t.events(spark, d)))
    return bucketed.select("id_disparo", "age_days", "age_bucket", "age_bucket_order")


def rates_age(spark: SparkSession, d: str) -> DataFrame:
    return rt.rates_by_age(t.events(spark, d)).select("age_bucket", "age_bucket_order", *_rate())


def error_extents_age(spark: SparkSession, d: str) -> DataFrame:
    low, high = error_extents(F.col("rate"), F.col("ci_low"), F.col("ci_high"))
    return (
        rt.rates_by_age(t.events(spark, d))
        .select("age_bucket", low.alias("err_low"), high.alias("err_high"))
        .select("age_bucket", _r("err_low"), _r("err_high"))
    )


def top_systems(spark: SparkSession, d: str) -> DataFrame:
    return rt.rates_by_system(t.events(spark, d)).limit(15).select("id_sistema_mask", *_rate())


# Ranking


def system_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rk.system_ranking(t.events(spark, d)).select(
        "id_sistema_mask",
        "n",
        "successes",
        _r("mean_age_days"),
        _r("posterior_mean"),
        _r("score"),
    )


def ddd_rates(spark: SparkSession, d: str) -> DataFrame:
    return rk.area_rates(_events_with_area(spark, d)).select("telefone_ddd", "n", _r("rate"))


def ddd_quantiles(spark: SparkSession, d: str) -> DataFrame:
    profile = rk.event_profile(_events_with_area(spark, d), ["telefone_ddd"])
    return rk.area_quantiles(rk.area_rates_of_profile(profile)).select(_r("q_low"), _r("q_high"))


def ddd_bonus(spark: SparkSession, d: str) -> DataFrame:
    profile = rk.event_profile(_events_with_area(spark, d), ["telefone_ddd"])
    return rk.area_bonus(rk.area_rates_of_profile(profile))


def baseline_rate(spark: SparkSession, d: str) -> DataFrame:
    return rk.baseline_rate(t.events(spark, d)).select(_r("baseline_p"))


# Scoring


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return ap.candidates(t.appearances(spark, d))


def _first_person(spark: SparkSession, d: str):
    return _candidates(spark, d).agg(F.min("cpf")).scalar()


def _person_with_most_phones(spark: SparkSession, d: str) -> DataFrame:
    people = ap.people_with_phones(_candidates(spark, d))
    return people.orderBy(F.desc("n_telefones"), "cpf").limit(1)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


def candidates_for_cpf(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where(F.col("cpf") == _first_person(spark, d))


def candidates_lookup(spark: SparkSession, d: str) -> DataFrame:
    path = write_candidates(_candidates(spark, d), new_table_path(spark, "candidates"))
    first = spark.read.parquet(path).agg(F.min("cpf")).first()[0]
    return lookup_candidates(spark, path, [] if first is None else [first])


def recency_weights(spark: SparkSession, d: str) -> DataFrame:
    age = whole_days_between(F.col("registro_data_atualizacao"), sc.instant(t.NOW)).cast("double")
    return (
        _candidates(spark, d)
        .select("telefone", "id_sistema_mask", "registro_data_atualizacao", age.alias("age_days"))
        .withColumn("recency_weight", F.round(recency_weight(F.col("age_days")), 9))
    )


def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    scored = sc.score_candidates(_candidates(spark, d), ranking, t.NOW, bonus=bonus)
    return scored.select(
        "cpf",
        "telefone",
        "id_sistema_mask",
        "registro_data_atualizacao",
        "telefone_ddd",
        "age_days",
        "ddd_bonus",
        _r("system_score"),
        _r("recency_weight"),
        _r("base_score"),
        _r("final_score"),
    )


def _scored() -> list:
    return [*[c for c in sc.SCORED_COLUMNS if c != "final_score"], _r("final_score")]


def best_row_per_phone(spark: SparkSession, d: str) -> DataFrame:
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    scored = sc.score_candidates(_candidates(spark, d), ranking, t.NOW, bonus=bonus)
    return sc.best_row_per_phone(scored).select(*_scored())


def _choice(spark: SparkSession, d: str, top: int | None) -> DataFrame:
    return choose_phones(t.dispatch(spark, d), t.appearances(spark, d), t.NOW, top=top)


def score_phones(spark: SparkSession, d: str) -> DataFrame:
    ranked = _choice(spark, d, None)
    return ranked.select(*_scored(), "rank")


def score_phones_one(spark: SparkSession, d: str) -> DataFrame:
    person = _person_with_most_phones(spark, d).select("cpf").scalar()
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    one = _candidates(spark, d).where(F.col("cpf") == person)
    ranked = sc.score_phones(one, ranking, t.NOW, bonus=bonus)
    return ranked.select(*_scored(), "rank")


def top2_phones(spark: SparkSession, d: str) -> DataFrame:
    return _choice(spark, d, 2).select(*_scored(), "rank")


def top2_phones_fitted(spark: SparkSession, d: str) -> DataFrame:
    fitted = rk.ScoreParams(half_life_days=fitted_half_life(t.decaying_events(spark, d)))
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    chosen = sc.score_phones(_candidates(spark, d), ranking, t.NOW, fitted, bonus, top=2)
    return chosen.select(*_scored(), "rank")


def top2_phones_agg(spark: SparkSession, d: str) -> DataFrame:
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    scored = sc.score_candidates(_candidates(spark, d), ranking, t.NOW, bonus=bonus)
    return sc.top_phones_regrouped(scored).select(*_scored())


def top2_invariant(spark: SparkSession, d: str) -> DataFrame:
    return sc.top_check(_choice(spark, d, 2), _candidates(spark, d))


def cpfs_multi(spark: SparkSession, d: str) -> DataFrame:
    people = ap.people_with_phones(_candidates(spark, d))
    return people.orderBy(F.desc("n_telefones"), "cpf")


def top_cpf(spark: SparkSession, d: str) -> DataFrame:
    return _person_with_most_phones(spark, d)


# Decay


def _decay_bins(spark: SparkSession, d: str) -> DataFrame:
    return dc.decay_bins(rt.aged_events(t.decaying_events(spark, d)))


def decay_events(spark: SparkSession, d: str) -> DataFrame:
    aged = rt.aged_events(t.decaying_events(spark, d))
    clipped = F.least(F.col("age_days"), F.lit(float(dc.MAX_AGE)))
    return aged.select("id_disparo", clipped.alias("age_days"), "delivered")


def decay_bins(spark: SparkSession, d: str) -> DataFrame:
    return _decay_bins(spark, d).select("bin", _r("age_days"), "n", "successes", _r("p"))


def decay_bins_scaled(spark: SparkSession, d: str) -> DataFrame:
    scaled = dc.decay_bins_scaled(_decay_bins(spark, d))
    return scaled.select(
        "bin", _r("age_days"), "n", _r("age_mean", 6), _r("age_std", 6), _r("age_scaled", 6)
    )


def decay_glm(spark: SparkSession, d: str) -> DataFrame:
    fit = dc.decay_fit(_decay_bins(spark, d))
    return fit.select(*[_r(c, 6) for c in ("const", "age_scaled", "age_mean", "age_std")])


def half_life(spark: SparkSession, d: str) -> DataFrame:
    found = dc.half_life(dc.decay_fit(_decay_bins(spark, d)))
    return found.select(_r("b_per_day"), _r("half_life_odds", 4), _r("half_life_days", 4))


def decay_effects(spark: SparkSession, d: str) -> DataFrame:
    """The decay with effects of the systems beside age: one row per unknown."""
    aged = rt.aged_events(t.decaying_events(spark, d)).where("id_sistema_mask IS NOT NULL")
    years = aged.withColumn("age_years", F.least("age_days", F.lit(float(dc.MAX_AGE))) / 365.25)
    fit = lg.logit_fit(years, "delivered", ["age_years"], ["id_sistema_mask"], ridge=1e-4)
    rows = [(name, round(value, 6)) for name, value in zip(fit.names, fit.values)]
    return spark.createDataFrame(rows, "name string, value double")


# Experiment


def sample_size(spark: SparkSession, d: str) -> DataFrame:
    baselines = ex.baseline_segments(rk.event_profile(_events_with_area(spark, d)))
    return ex.with_sample_size(baselines).select(
        "segmento", "valor", _r("baseline_p"), _r("p_t"), "n_per_group"
    )


def sample_size_citizen(spark: SparkSession, d: str) -> DataFrame:
    planned = ex.with_sample_size(ex.citizen_baseline(t.events(spark, d)))
    return planned.select(_r("baseline_p"), _r("p_t"), "n_per_group")


def test_duration(spark: SparkSession, d: str) -> DataFrame:
    planned = ex.with_sample_size(rk.baseline_rate(t.events(spark, d)))
    people = ex.daily_people(t.dispatch(spark, d)).scalar()
    return (
        planned.withColumn("pessoas_por_dia", people)
        .withColumn("dias", ex.duration_days(F.col("n_per_group"), F.col("pessoas_por_dia")))
        .select("n_per_group", _r("pessoas_por_dia", 6), _r("dias", 6))
    )


def bootstrap_rate_diff(spark: SparkSession, d: str) -> DataFrame:
    sent = at.with_send_day(t.dispatch(spark, d))
    units = sent.select(
        F.col("id_disparo").alias("unit"),
        ex.arm_of(F.col("cpf")).alias("arm"),
        F.col("delivered").alias("y"),
    )
    diff = ex.bootstrap_rate_diff(units)
    return diff.select(_r("diff_mean"), _r("ci_low"), _r("ci_high"))


def bootstrap_by_person(spark: SparkSession, d: str) -> DataFrame:
    """Arms are drawn by person, so a person's dispatches are resampled together."""
    sent = at.with_send_day(t.dispatch(spark, d))
    units = sent.select(
        F.col("cpf").alias("unit"), ex.arm_of(F.col("cpf")).alias("arm"), F.col("delivered").alias("y")
    )
    return ex.clustered_rate_diff(units).select(*[_r(c) for c in ("diff", "se", "ci_low", "ci_high")])


def ab_assign(spark: SparkSession, d: str) -> DataFrame:
    arms = ex.assign_arms(_candidates(spark, d))
    return arms.withColumn("u", F.round(uniform(42, F.col("cpf")), 9))


def ab_control_pick(spark: SparkSession, d: str) -> DataFrame:
    mine = _candidates(spark, d).where(ex.arm_of(F.col("cpf")) == ex.CONTROL)
    return ex.random_phones(mine)


def ab_treatment_pick(spark: SparkSession, d: str) -> DataFrame:
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    mine = _candidates(spark, d).where(ex.arm_of(F.col("cpf")) == ex.TREATMENT)
    return sc.score_phones(mine, ranking, t.NOW, bonus=bonus, top=2).select(
        "cpf", "telefone", "rank", _r("final_score")
    )


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    ranking, bonus = learned_tables(_events_with_area(spark, d))
    # Candidates once for both arms; picks once for the log and the attempts.
    candidates = frozen(_candidates(spark, d), "candidates")
    picks = frozen(experiment_picks(candidates, ranking, t.NOW, bonus=bonus), "picks")
    return ex.attempts(picks, ex.last_outcomes(t.dispatch(spark, d), picks))


def ab_primary(spark: SparkSession, d: str) -> DataFrame:
    result = ex.primary_metric(_attempts(spark, d))
    return result.select("arm", "pessoas", "alcancados", _r("rate"), _r("ci_low"), _r("ci_high"))


def ab_test(spark: SparkSession, d: str) -> DataFrame:
    found = ex.primary_test(ex.primary_metric(_attempts(spark, d)))
    counts = ("pessoas_c", "alcancados_c", "pessoas_t", "alcancados_t")
    return found.select(*counts, _r("diff"), _r("z", 7), _r("p_value", 7), "rejects")


def ab_sequential(spark: SparkSession, d: str) -> DataFrame:
    looks = ex.sequential_monitor(_attempts(spark, d), planned=20_000)
    counts = ("pessoas_c", "alcancados_c", "pessoas_t", "alcancados_t")
    return looks.select("envio_data", *counts, _r("diff"), _r("lower", 7), "stop")


def ab_opt_outs(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the event stream, moved to the time of the dispatches, stand for complaints."""
    errors = t.table(spark, d, "events").where("event_type = 'error'")
    said = errors.selectExpr("user_id AS cpf", "date_sub(CAST(ts AS DATE), 8300) AS dia")
    left = ex.opt_outs(_attempts(spark, d), said, within_days=365)
    return left.select("arm", "pessoas", "saidas", _r("taxa_saidas"))


def ab_secondary(spark: SparkSession, d: str) -> DataFrame:
    result = ex.secondary_metrics(_attempts(spark, d))
    return result.select("arm", "tentativas", "entregas", _r("rate"), _r("custo_por_entrega"))


def ab_failures(spark: SparkSession, d: str) -> DataFrame:
    result = ex.failure_reasons(_attempts(spark, d))
    return result.select("arm", "descricao_falha", "falhas", _r("share"))


def ab_guardrails(spark: SparkSession, d: str) -> DataFrame:
    phones = t.phones(spark, d).withColumnRenamed("telefone_numero", "telefone")
    return ex.guardrails(_attempts(spark, d), phones).select(
        "arm", "envio_data", "tentativas", "invalidas", _r("taxa_invalidas"), _r("taxa_falhas")
    )


def response_times(spark: SparkSession, d: str) -> DataFrame:
    """From the send to the first shipment, which stands for the response."""
    shipped = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id_disparo"))
    first = shipped.agg(F.min("l_shipdate").alias("shipped"))
    tries = t.dispatch(spark, d).join(first, "id_disparo").withColumn("arm", ex.arm_of(F.col("cpf")))
    waits = ex.response_times(tries, "shipped")
    return waits.select("arm", "respostas", _r("seconds_p50", 6), _r("seconds_p90", 6))


def ab_daily(spark: SparkSession, d: str) -> DataFrame:
    return ex.daily_metrics(_attempts(spark, d)).select(
        "arm",
        "envio_data",
        "pessoas",
        "alcancados",
        "tentativas",
        "entregas",
        _r("rate"),
        _r("ci_low"),
        _r("ci_high"),
    )


QUERIES = {
    "scan_dispatch": scan_dispatch,
    "scan_phone_dim": scan_phone_dim,
    "scan_discovered": scan_discovered,
    "events_roundtrip": events_roundtrip,
    "events_incremental": events_incremental,
    "profile_system_rates": profile_system_rates,
    "profile_age_rates": profile_age_rates,
    "profile_ranking": profile_ranking,
    "profile_area_rates": profile_area_rates,
    "profile_baseline": profile_baseline,
    "profile_daily": profile_daily,
    "people_by_system": people_by_system,
    "candidates_lookup": candidates_lookup,
    "delivered_flag": delivered_flags,
    "explode_appearances": explode_appearances,
    "enrich_dispatch": enrich_dispatch,
    "attribute_system": attribute_system,
    "filter_not_null": filter_not_null,
    "wilson_ci": wilson_ci,
    "rates_system": rates_system,
    "rates_system_multi": rates_system_multi,
    "rates_system_compare": rates_system_compare,
    "age_buckets": age_buckets,
    "rates_age": rates_age,
    "error_extents": error_extents_age,
    "top_systems": top_systems,
    "system_ranking": system_ranking,
    "ddd_rates": ddd_rates,
    "ddd_quantiles": ddd_quantiles,
    "ddd_bonus": ddd_bonus,
    "baseline_rate": baseline_rate,
    "candidates": candidates,
    "candidates_for_cpf": candidates_for_cpf,
    "recency_weight": recency_weights,
    "score_candidates": score_candidates,
    "best_row_per_phone": best_row_per_phone,
    "score_phones": score_phones,
    "score_phones_one": score_phones_one,
    "top2_phones": top2_phones,
    "top2_phones_fitted": top2_phones_fitted,
    "top2_phones_agg": top2_phones_agg,
    "top2_invariant": top2_invariant,
    "cpfs_multi": cpfs_multi,
    "top_cpf": top_cpf,
    "decay_events": decay_events,
    "decay_bins": decay_bins,
    "decay_bins_scaled": decay_bins_scaled,
    "decay_glm": decay_glm,
    "half_life": half_life,
    "sample_size": sample_size,
    "sample_size_citizen": sample_size_citizen,
    "test_duration": test_duration,
    "bootstrap_rate_diff": bootstrap_rate_diff,
    "ab_assign": ab_assign,
    "ab_control_pick": ab_control_pick,
    "ab_treatment_pick": ab_treatment_pick,
    "ab_primary": ab_primary,
    "ab_secondary": ab_secondary,
    "ab_failures": ab_failures,
    "ab_daily": ab_daily,
    "ab_test": ab_test,
    "ab_sequential": ab_sequential,
    "ab_opt_outs": ab_opt_outs,
    "bootstrap_by_person": bootstrap_by_person,
    "rates_multi_layout": rates_multi_layout,
    "decay_effects": decay_effects,
    "ab_guardrails": ab_guardrails,
    "response_times": response_times,
}
