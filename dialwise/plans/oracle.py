"""DuckDB SQL for every query of the catalogue, over the same Parquet tables.

All queries share one chain of CTEs; DuckDB evaluates only those a query refers to. The attribution
here is the plain definition: join every dispatch with all appearances of its phone, then choose.
"""

from __future__ import annotations

import math

from dialwise.functions.ages import AGE_BUCKETS
from dialwise.functions.chance import poisson_steps
from dialwise.functions.rates import NORMAL_BOTTOM, NORMAL_FAR, NORMAL_STEPS, NORMAL_TOP, normal_quantile

_LN2 = repr(math.log(2.0))


def _uniform(*keys: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    digest = f"md5(concat_ws('|', '42', {parts}))"
    return f"(CAST(('0x' || substr({digest}, 1, 8)) AS BIGINT) / 4294967296.0)"


def _wilson(s: str, n: str) -> tuple[str, str]:
    z = f"CAST({normal_quantile(0.975)!r} AS DOUBLE)"
    p, m = f"(CAST({s} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    mid = f"({p} + {z} * {z} / (2 * {m}))"
    reach = f"({z} * sqrt({p} * (1 - {p}) / {m} + {z} * {z} / (4 * {m} * {m})))"
    scale = f"(1 + {z} * {z} / {m})"
    low = f"greatest(0.0, {mid} / {scale} - {reach} / {scale})"
    high = f"least(1.0, {mid} / {scale} + {reach} / {scale})"
    return low, high


def _bucket(age: str, values: list) -> str:
    whens = " ".join(
        f"WHEN {age} <= {edge} THEN {value}"
        for (edge, _), value in zip(AGE_BUCKETS, values)
        if edge is not None
    )
    return f"CASE {whens} ELSE {values[-1]} END"


_LABEL = _bucket("age_days", [f"'{label}'" for _, label in AGE_BUCKETS])
_ORDER = _bucket("age_days", list(range(len(AGE_BUCKETS))))

_TABLES = """
people AS (SELECT greatest(1, count(*) // 5) AS k FROM customer),
dispatch AS (
  SELECT o_orderkey AS id_disparo, o_custkey % k AS cpf,
         CASE WHEN again = 1 THEN o_custkey + 1
              WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderkey % 10 = 0 THEN 1
              ELSE o_custkey END AS contato_telefone,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))
              ELSE o_orderdate END AS envio_datahora,
         CAST(o_orderdate AS DATE) AS envio_data,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              WHEN o_orderstatus = 'F' THEN 'delivered'
              WHEN o_orderstatus = 'O' THEN 'READ'
              ELSE 'failed' END AS status_disparo,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS descricao_falha,
         CAST(lower(status_disparo) IN ('delivered', 'read') AS INTEGER) AS delivered
  FROM (SELECT *, unnest(CASE WHEN o_orderkey % 101 = 0 THEN [0, 1] ELSE [0] END) AS again
        FROM orders), people),
listings AS (
  SELECT DISTINCT o_custkey AS telefone_numero, CAST(s_nationkey AS BIGINT) AS id_sistema,
         CASE WHEN (o_custkey + s_nationkey) % 53 = 0 THEN NULL
              WHEN (o_custkey + s_nationkey) % 11 = 0 THEN l_shipdate + INTERVAL 10 HOURS
              ELSE l_shipdate END AS registro_data_atualizacao,
         o_custkey % k AS cpf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey,
       people),
phones AS (
  SELECT c_custkey AS telefone_numero, '55' AS telefone_ddi,
         CAST(c_nationkey AS VARCHAR) AS telefone_ddd, c_mktsegment AS telefone_tipo,
         CASE WHEN c_acctbal < 0 THEN 'RUIM' ELSE 'BOA' END AS telefone_qualidade,
         CASE WHEN c_acctbal < -500 THEN 'INVALIDO' ELSE 'VALIDO' END AS validacao_telefone
  FROM customer),
appearances AS (
  SELECT p.*, id_sistema AS id_sistema_mask, registro_data_atualizacao AS registro,
         cpf AS cpf_aparicao
  FROM phones p LEFT JOIN listings USING (telefone_numero)),
phone_counts AS (
  SELECT telefone_numero, count(id_sistema_mask) AS aparicoes, count(DISTINCT cpf_aparicao) AS donos,
         count(DISTINCT id_sistema_mask) AS sistemas
  FROM appearances GROUP BY 1),
joined AS (
  SELECT d.*, a.* EXCLUDE (telefone_numero), a.telefone_numero,
         CASE WHEN registro <= envio_data THEN 1 ELSE 0 END AS prefer
  FROM dispatch d LEFT JOIN appearances a ON contato_telefone = a.telefone_numero),
ev AS (
  SELECT *, CAST(registro AS DATE) AS registro_data_atualizacao,
         CAST(envio_data - CAST(registro AS DATE) AS DOUBLE) AS age_days
  FROM joined
  QUALIFY row_number() OVER (
    PARTITION BY id_disparo
    ORDER BY prefer DESC, CAST(registro AS DATE) DESC NULLS FIRST,
             id_sistema_mask ASC NULLS FIRST, envio_datahora ASC NULLS FIRST,
             contato_telefone ASC NULLS FIRST, cpf ASC NULLS FIRST,
             status_disparo ASC NULLS FIRST) = 1),
aged AS (SELECT * REPLACE (greatest(age_days, 0.0) AS age_days) FROM ev WHERE age_days IS NOT NULL),
"""

_RATES = """
multi_events AS (
  SELECT ev.* FROM ev JOIN phone_counts c ON contato_telefone = c.telefone_numero
  WHERE sistemas >= 2),
rank_counts AS (
  SELECT id_sistema_mask, count(*) AS n, CAST(coalesce(sum(delivered), 0) AS BIGINT) AS successes,
         avg(age_days) AS mean_age_days
  FROM aged WHERE id_sistema_mask IS NOT NULL GROUP BY 1),
ranking AS (
  SELECT *, (successes + 2.0::DOUBLE) / (n + 4.0::DOUBLE) AS posterior_mean,
         (successes + 2.0::DOUBLE) / (n + 4.0::DOUBLE) * (n / (n + 500.0::DOUBLE)) AS score
  FROM rank_counts),
area_rates AS (
  SELECT telefone_ddd, count(*) AS n, avg(delivered) AS rate
  FROM ev WHERE telefone_ddd IS NOT NULL GROUP BY 1 HAVING count(*) >= 200),
area_ladder AS (
  SELECT rate, row_number() OVER (ORDER BY rate) AS place, count(*) OVER () AS areas
  FROM area_rates WHERE rate IS NOT NULL),
area_quantiles AS (
  SELECT coalesce(max(rate) FILTER (place = floor((areas - 1) * 0.2 + 0.5) + 1), 0.0) AS q_low,
         coalesce(max(rate) FILTER (place = floor((areas - 1) * 0.8 + 0.5) + 1), 0.0) AS q_high
  FROM area_ladder),
area_bonus AS (
  SELECT telefone_ddd,
         CAST(CASE WHEN rate >= q_high THEN 0.05 WHEN rate <= q_low THEN -0.05 END AS DOUBLE)
           AS ddd_bonus
  FROM area_rates, area_quantiles
  WHERE rate >= q_high OR rate <= q_low),
"""

_FITTED = """(SELECT CASE WHEN isfinite(half_life_odds) THEN half_life_odds ELSE 365.0::DOUBLE END
                  FROM odds)"""


def _scores(half_life: str) -> str:
    return f"""
candidates AS (
  SELECT cpf_aparicao AS cpf, telefone_numero AS telefone, id_sistema_mask,
         registro AS registro_data_atualizacao, telefone_ddd
  FROM appearances
  WHERE cpf_aparicao IS NOT NULL AND telefone_numero IS NOT NULL
    AND id_sistema_mask IS NOT NULL AND registro IS NOT NULL),
people_multi AS (
  SELECT cpf, count(DISTINCT telefone) AS n_telefones
  FROM candidates GROUP BY 1 HAVING count(DISTINCT telefone) >= 3),
person AS (SELECT * FROM people_multi ORDER BY n_telefones DESC, cpf LIMIT 1),
weighted AS (
  SELECT *,
         CAST(date_sub('day', registro_data_atualizacao, TIMESTAMP '2002-01-01') AS DOUBLE)
           AS age_days
  FROM candidates),
days AS (SELECT {half_life} AS half_life),
scored AS (
  SELECT w.*, coalesce(r.score, 0.0) AS system_score,
         coalesce(b.ddd_bonus, 0.0::DOUBLE) AS ddd_bonus,
         exp(CAST(-{_LN2} AS DOUBLE) * (w.age_days / half_life)) AS recency_weight,
         coalesce(r.score, 0.0) * recency_weight AS base_score,
         coalesce(r.score, 0.0) * recency_weight * (1 + coalesce(b.ddd_bonus, 0.0::DOUBLE))
           AS final_score
  FROM (SELECT * FROM weighted, days) w LEFT JOIN ranking r USING (id_sistema_mask)
       LEFT JOIN area_bonus b USING (telefone_ddd)),
best AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (
    PARTITION BY cpf, telefone
    ORDER BY final_score DESC, registro_data_atualizacao DESC, id_sistema_mask, telefone_ddd) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cpf ORDER BY final_score DESC, telefone) AS rank
  FROM best),
regrouped AS (
  SELECT cpf, telefone, max(final_score) AS final_score,
         max(registro_data_atualizacao) AS registro_data_atualizacao,
         arg_max({{'s': id_sistema_mask, 'd': telefone_ddd}},
                 {{'a': final_score, 'b': registro_data_atualizacao, 'c': id_sistema_mask,
                  'd': telefone_ddd}}) AS w
  FROM scored GROUP BY ALL),
top2_checked AS (
  SELECT cpf, count(DISTINCT telefone) AS telefones FROM candidates GROUP BY 1),
"""

_SCORES = _scores("365.0::DOUBLE")

_PICKS = f"""
arms AS (
  SELECT DISTINCT cpf, {_uniform("cpf")} AS u,
         CASE WHEN {_uniform("cpf")} < 0.5 THEN 'controle' ELSE 'tratamento' END AS arm
  FROM candidates),
drawn AS (
  SELECT cpf, telefone, row_number() OVER (
           PARTITION BY cpf
           ORDER BY md5(concat_ws('|', '42', CAST(cpf AS VARCHAR), CAST(telefone AS VARCHAR))),
                    telefone) AS rank
  FROM (SELECT DISTINCT cpf, telefone FROM candidates) JOIN arms USING (cpf)
  WHERE arm = 'controle'),
picks AS (
  SELECT 'controle' AS arm, cpf, telefone FROM drawn WHERE rank <= 2
  UNION ALL
  SELECT arm, cpf, telefone FROM ranked JOIN arms USING (cpf)
  WHERE arm = 'tratamento' AND rank <= 2),
outcomes AS (
  SELECT * FROM dispatch
  WHERE cpf IS NOT NULL AND contato_telefone IS NOT NULL
  QUALIFY row_number() OVER (
    PARTITION BY cpf, contato_telefone
    ORDER BY envio_datahora DESC NULLS LAST, id_disparo DESC NULLS LAST,
             status_disparo DESC NULLS LAST, descricao_falha DESC NULLS LAST) = 1),
tries AS (
  SELECT p.arm, o.* FROM picks p
  JOIN outcomes o ON p.cpf = o.cpf AND p.telefone = o.contato_telefone),
"""

_DECAY = f"""
decaying AS (
  SELECT * REPLACE (
    CASE WHEN age_days IS NULL THEN delivered
         ELSE CAST({_uniform("id_disparo")}
                   < 1 / (1 + exp(-(2.0::DOUBLE - 0.0014::DOUBLE * age_days))) AS INTEGER)
    END AS delivered) FROM ev),
decay_rows AS (
  SELECT id_disparo, least(greatest(age_days, 0.0), 2000.0) AS age_days, delivered
  FROM decaying WHERE age_days IS NOT NULL),
edges AS (
  SELECT list_distinct(quantile_cont(age_days, [{", ".join(repr(i / 50) for i in range(1, 50))}]))
           AS e
  FROM decay_rows WHERE delivered IS NOT NULL),
binned AS (
  SELECT CAST(len(list_filter(e, lambda z: z < age_days)) AS INTEGER) AS bin, age_days, delivered
  FROM decay_rows, edges WHERE delivered IS NOT NULL),
bins AS (
  SELECT bin, avg(age_days) AS age_days, count(*) AS n, CAST(sum(delivered) AS BIGINT) AS successes,
         (sum(delivered) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE) AS p
  FROM binned GROUP BY bin),
scale AS (
  SELECT avg(age_days) AS age_mean, stddev_pop(age_days) AS age_std, count(*) AS m FROM bins),
points AS (
  SELECT (age_days - age_mean) / greatest(age_std, 1e-12) AS x, p,
         CAST(n AS DOUBLE) AS w, m * 1e-4::DOUBLE AS penalty
  FROM bins, scale),
newton AS (
  SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
  UNION ALL
  SELECT step + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01),
         b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT step, b0, b1,
           sum(w * (p - mu)) - max(penalty) * b0 AS g0,
           sum(w * (p - mu) * x) - max(penalty) * b1 AS g1,
           sum(w * mu * (1 - mu)) + max(penalty) AS h00,
           sum(w * mu * (1 - mu) * x) AS h01,
           sum(w * mu * (1 - mu) * x * x) + max(penalty) AS h11
    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM newton, points)
    WHERE step < 25
    GROUP BY step, b0, b1)),
fit AS (
  SELECT b0 AS const, b1 AS age_scaled, age_mean, age_std FROM newton, scale WHERE step = 25),
slope AS (SELECT age_scaled / greatest(age_std, 1e-12) AS b_per_day FROM fit),
odds AS (
  SELECT b_per_day, CASE WHEN b_per_day >= 0 THEN 'inf'::DOUBLE ELSE ln(0.5::DOUBLE) / b_per_day END
           AS half_life_odds FROM slope),
"""

_ZA, _ZP = repr(normal_quantile(0.95)), repr(normal_quantile(0.8))


def _plan(source: str, columns: str) -> str:
    return f"""
planned AS (
  SELECT *, CASE WHEN NOT (baseline_p > 0 AND baseline_p < 1 AND p_t > 0 AND p_t < 1) THEN 0
                 WHEN p_t <> baseline_p THEN CAST(ceil(
                   (CAST({_ZA} AS DOUBLE) * sqrt(2 * ((baseline_p + p_t) / 2)
                      * (1 - (baseline_p + p_t) / 2))
                    + CAST({_ZP} AS DOUBLE) * sqrt(baseline_p * (1 - baseline_p)
                      + p_t * (1 - p_t))) ** 2 / (p_t - baseline_p) ** 2) AS BIGINT) END
           AS n_per_group
  FROM (SELECT {columns}, CASE WHEN baseline_p IS NOT NULL
                 THEN least(0.99::DOUBLE, baseline_p + 0.01::DOUBLE) END AS p_t FROM ({source}))),
"""


_SEGMENTS = _plan(
    """SELECT 'todos' AS segmento, 'todos' AS valor, avg(delivered) AS baseline_p FROM ev
       UNION ALL SELECT 'sistema', CAST(id_sistema_mask AS VARCHAR), avg(delivered) FROM ev
         WHERE id_sistema_mask IS NOT NULL GROUP BY 2
       UNION ALL SELECT 'ddd', telefone_ddd, avg(delivered) FROM ev
         WHERE telefone_ddd IS NOT NULL GROUP BY 2""",
    "segmento, valor, baseline_p",
)
_OVERALL = _plan("SELECT avg(delivered) AS baseline_p FROM ev", "baseline_p")

_STEPS = " + ".join(
    f"CAST(u >= CAST({step!r} AS DOUBLE) AS INTEGER)" for step in poisson_steps()
)
_BOOT = f"""
units AS (
  SELECT CASE WHEN {_uniform("cpf")} < 0.5 THEN 'controle' ELSE 'tratamento' END AS arm,
         CAST(floor({_uniform("'bucket'", "id_disparo")} * 200) AS BIGINT) AS bucket, delivered AS y
  FROM dispatch WHERE delivered IS NOT NULL),
bucket_sums AS (
  SELECT arm, bucket, CAST(sum(y) AS DOUBLE) AS y, count(*) AS n FROM units GROUP BY 1, 2),
replicates AS (
  SELECT rep, arm, y, n, {_uniform("arm", "bucket", "rep")} AS u
  FROM bucket_sums, range(1, 5001) r(rep)),
diffs AS (
  SELECT rep,
         sum(({_STEPS}) * y) FILTER (arm = 'tratamento')
           / sum(({_STEPS}) * n) FILTER (arm = 'tratamento')
         - sum(({_STEPS}) * y) FILTER (arm = 'controle')
           / sum(({_STEPS}) * n) FILTER (arm = 'controle') AS diff
  FROM replicates GROUP BY rep),
"""


def _sql(select: str, *extra: str) -> str:
    chain = "".join((_TABLES, *extra)).strip().rstrip(",")
    return f"WITH RECURSIVE {chain}\n{select}"


def _rate_sql(source: str, keys: str, by: str) -> str:
    low, high = _wilson("s", "n")
    return f"""
SELECT {keys}, n, round(s / n, 9) AS rate, round({low}, 9) AS ci_low, round({high}, 9) AS ci_high
FROM (SELECT {by}, count(*) AS n, CAST(coalesce(sum(delivered), 0) AS BIGINT) AS s
      FROM {source} GROUP BY ALL)"""


_SYSTEM_RATES = _rate_sql(
    "ev WHERE id_sistema_mask IS NOT NULL", "id_sistema_mask", "id_sistema_mask"
)
_MULTI_RATES = _rate_sql("multi_events", "id_sistema_mask", "id_sistema_mask")
_AGE_RATES = _rate_sql(
    f"(SELECT {_LABEL} AS age_bucket, CAST({_ORDER} AS INTEGER) AS age_bucket_order, delivered"
    " FROM aged)",
    "age_bucket, age_bucket_order",
    "age_bucket, age_bucket_order",
)
_EVENT_COLUMNS = """id_disparo, cpf, contato_telefone, id_sistema_mask, registro_data_atualizacao,
  envio_datahora, envio_data, age_days, telefone_ddi, telefone_ddd, telefone_tipo,
  telefone_qualidade, validacao_telefone, status_disparo, delivered"""
_SCORED = """cpf, telefone, id_sistema_mask, registro_data_atualizacao, telefone_ddd,
  round(final_score, 9) AS final_score"""


def _person_rates(keys: str) -> str:
    low, high = _wilson("alcancados", "pessoas")
    return f"""
SELECT {keys}, pessoas, alcancados, tentativas, entregas,
       round(alcancados / pessoas, 9) AS rate, round({low}, 9) AS ci_low,
       round({high}, 9) AS ci_high
FROM (SELECT {keys}, count(*) AS pessoas, CAST(sum(reached) AS BIGINT) AS alcancados,
             CAST(sum(t) AS BIGINT) AS tentativas, CAST(sum(arrived) AS BIGINT) AS entregas
      FROM (SELECT {keys}, cpf, coalesce(max(delivered), 0) AS reached, count(*) AS t,
                   coalesce(sum(delivered), 0) AS arrived
            FROM tries GROUP BY ALL) GROUP BY ALL)"""


_LOW, _HIGH = _wilson("successes", "n")

ORACLE = {
    "scan_dispatch": _sql("SELECT * EXCLUDE (envio_data, delivered) FROM dispatch"),
    "scan_phone_dim": _sql(
        """SELECT p.* , 'BR' AS telefone_nacionalidade,
             lista AS telefone_aparicoes,
             aparicoes AS telefone_aparicoes_quantidade,
             donos AS telefone_proprietarios_quantidade, sistemas AS telefone_sistemas_quantidade
           FROM phones p JOIN phone_counts USING (telefone_numero) LEFT JOIN (
             SELECT telefone_numero, string_agg(x, ',' ORDER BY x) AS lista FROM (
               SELECT telefone_numero, id_sistema || '|' || coalesce(
                        strftime(registro_data_atualizacao, '%Y-%m-%d %H:%M:%S'), '-')
                      || '|' || cpf AS x FROM listings) GROUP BY 1) USING (telefone_numero)"""
    ),
    "scan_discovered": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "events_roundtrip": _sql(f"SELECT {_EVENT_COLUMNS} FROM ev"),
    "delivered_flag": _sql("SELECT id_disparo, status_disparo, delivered FROM dispatch"),
    "explode_appearances": _sql(
        """SELECT telefone_numero AS telefone_mascarado, telefone_ddi, telefone_ddd, telefone_tipo,
             'BR' AS telefone_nacionalidade, telefone_qualidade,
             aparicoes AS telefone_aparicoes_quantidade,
             donos AS telefone_proprietarios_quantidade, sistemas AS telefone_sistemas_quantidade,
             validacao_telefone, id_sistema_mask, registro AS registro_data_atualizacao,
             cpf_aparicao
           FROM appearances JOIN phone_counts USING (telefone_numero)"""
    ),
    "enrich_dispatch": _sql(
        """SELECT id_disparo, contato_telefone, status_disparo, delivered, envio_datahora,
             envio_data, CAST(max(prefer) AS INTEGER) AS prefer, count(telefone_numero) AS fan_out,
             CAST(sum(prefer) AS BIGINT) AS valid_at_send
           FROM joined GROUP BY ALL"""
    ),
    "attribute_system": _sql(f"SELECT {_EVENT_COLUMNS} FROM ev"),
    "filter_not_null": _sql(
        "SELECT id_disparo, id_sistema_mask, age_days FROM ev WHERE id_sistema_mask IS NOT NULL"
    ),
    "wilson_ci": _sql(
        f"""SELECT contato_telefone, n, successes,
              n = 0 AS no_interval, CASE WHEN n > 0 THEN round({_LOW}, 9) END AS ci_low,
              CASE WHEN n > 0 THEN round({_HIGH}, 9) END AS ci_high
            FROM (SELECT contato_telefone, count(delivered) AS n,
                    CAST(coalesce(sum(delivered), 0) AS BIGINT) AS successes
                  FROM dispatch GROUP BY 1)"""
    ),
    "rates_system": _sql(_SYSTEM_RATES),
    "rates_system_multi": _sql(_MULTI_RATES, _RATES),
    "rates_system_compare": _sql(
        f"""SELECT a.*, m.n AS n_multi, m.rate AS rate_multi, m.ci_low AS ci_low_multi,
              m.ci_high AS ci_high_multi
            FROM ({_SYSTEM_RATES}) a LEFT JOIN ({_MULTI_RATES}) m USING (id_sistema_mask)""",
        _RATES,
    ),
    "age_buckets": _sql(
        f"""SELECT id_disparo, age_days, {_LABEL} AS age_bucket,
              CAST({_ORDER} AS INTEGER) AS age_bucket_order FROM aged"""
    ),
    "rates_age": _sql(_AGE_RATES),
    "error_extents": _sql(
        f"""SELECT age_bucket, round(greatest(0.0, s / n - {_wilson("s", "n")[0]}), 9) AS err_low,
              round(greatest(0.0, {_wilson("s", "n")[1]} - s / n), 9) AS err_high
            FROM (SELECT {_LABEL} AS age_bucket, count(*) AS n,
                    CAST(coalesce(sum(delivered), 0) AS BIGINT) AS s FROM aged GROUP BY 1)"""
    ),
    "top_systems": _sql(
        f"SELECT * FROM ({_SYSTEM_RATES}) ORDER BY rate DESC, n DESC, id_sistema_mask LIMIT 15"
    ),
    "system_ranking": _sql(
        """SELECT id_sistema_mask, n, successes, round(mean_age_days, 9) AS mean_age_days,
             round(posterior_mean, 9) AS posterior_mean, round(score, 9) AS score FROM ranking""",
        _RATES,
    ),
    "ddd_rates": _sql("SELECT telefone_ddd, n, round(rate, 9) AS rate FROM area_rates", _RATES),
    "ddd_quantiles": _sql(
        "SELECT round(q_low, 9) AS q_low, round(q_high, 9) AS q_high FROM area_quantiles", _RATES
    ),
    "ddd_bonus": _sql("SELECT telefone_ddd, ddd_bonus FROM area_bonus", _RATES),
    "baseline_rate": _sql("SELECT round(avg(delivered), 9) AS baseline_p FROM ev"),
    "candidates": _sql("SELECT * FROM candidates", _SCORES),
    "candidates_for_cpf": _sql(
        "SELECT * FROM candidates WHERE cpf = (SELECT min(cpf) FROM candidates)", _SCORES
    ),
    "recency_weight": _sql(
        f"""SELECT telefone, id_sistema_mask, registro_data_atualizacao, age_days,
              round(exp(CAST(-{_LN2} AS DOUBLE) * (age_days / 365.0::DOUBLE)), 9) AS recency_weight
            FROM weighted""",
        _SCORES,
    ),
    "score_candidates": _sql(
        """SELECT cpf, telefone, id_sistema_mask, registro_data_atualizacao, telefone_ddd, age_days,
             ddd_bonus, round(system_score, 9) AS system_score,
             round(recency_weight, 9) AS recency_weight, round(base_score, 9) AS base_score,
             round(final_score, 9) AS final_score FROM scored""",
        _RATES,
        _SCORES,
    ),
    "best_row_per_phone": _sql(f"SELECT {_SCORED} FROM best", _RATES, _SCORES),
    "score_phones": _sql(f"SELECT {_SCORED}, rank FROM ranked", _RATES, _SCORES),
    "score_phones_one": _sql(
        f"SELECT {_SCORED}, rank FROM ranked WHERE cpf = (SELECT cpf FROM person)", _RATES, _SCORES
    ),
    "top2_phones": _sql(f"SELECT {_SCORED}, rank FROM ranked WHERE rank <= 2", _RATES, _SCORES),
    "top2_phones_fitted": _sql(
        f"SELECT {_SCORED}, rank FROM ranked WHERE rank <= 2", _RATES, _DECAY, _scores(_FITTED)
    ),
    "top2_phones_agg": _sql(
        """SELECT cpf, telefone, w.s AS id_sistema_mask, registro_data_atualizacao,
             w.d AS telefone_ddd, round(final_score, 9) AS final_score
           FROM regrouped
           QUALIFY row_number() OVER (PARTITION BY cpf ORDER BY final_score DESC, telefone) <= 2""",
        _RATES,
        _SCORES,
    ),
    "top2_invariant": _sql(
        """SELECT cpf, telefones, count(rank) AS linhas_top2,
             count(DISTINCT telefone) AS telefones_distintos,
             count(rank) = least(telefones, 2) AND count(DISTINCT telefone) = least(telefones, 2)
               AS ok
           FROM top2_checked LEFT JOIN (SELECT * FROM ranked WHERE rank <= 2) USING (cpf)
           GROUP BY cpf, telefones""",
        _RATES,
        _SCORES,
    ),
    "cpfs_multi": _sql("SELECT * FROM people_multi", _SCORES),
    "top_cpf": _sql("SELECT * FROM person", _SCORES),
    "decay_events": _sql("SELECT * FROM decay_rows", _DECAY),
    "decay_bins": _sql(
        """SELECT bin, round(age_days, 9) AS age_days, n, successes, round(p, 9) AS p FROM bins""",
        _DECAY,
    ),
    "decay_bins_scaled": _sql(
        """SELECT bin, round(age_days, 9) AS age_days, n, round(age_mean, 6) AS age_mean,
             round(age_std, 6) AS age_std,
             round((age_days - age_mean) / greatest(age_std, 1e-12), 6) AS age_scaled
           FROM bins, scale""",
        _DECAY,
    ),
    "decay_glm": _sql(
        """SELECT round(const, 6) AS const, round(age_scaled, 6) AS age_scaled,
             round(age_mean, 6) AS age_mean, round(age_std, 6) AS age_std FROM fit""",
        _DECAY,
    ),
    "half_life": _sql(
        """SELECT round(b_per_day, 9) AS b_per_day, round(half_life_odds, 4) AS half_life_odds,
             round(CASE WHEN isfinite(half_life_odds) THEN half_life_odds ELSE 365.0 END, 4)
               AS half_life_days FROM odds""",
        _DECAY,
    ),
    "sample_size": _sql(
        """SELECT segmento, valor, round(baseline_p, 9) AS baseline_p, round(p_t, 9) AS p_t,
             n_per_group FROM planned""",
        _SEGMENTS,
    ),
    "sample_size_citizen": _sql(
        """SELECT round(baseline_p, 9) AS baseline_p, round(p_t, 9) AS p_t, n_per_group
           FROM planned""",
        _plan(
            """SELECT avg(reached) AS baseline_p FROM (
                 SELECT cpf, max(delivered) AS reached FROM ev
                 WHERE cpf IS NOT NULL AND delivered IS NOT NULL GROUP BY 1)""",
            "baseline_p",
        ),
    ),
    "test_duration": _sql(
        """SELECT n_per_group, round(v, 6) AS pessoas_por_dia, round(2 * n_per_group / v, 6) AS dias
           FROM planned, (SELECT avg(c) AS v FROM (
             SELECT count(DISTINCT cpf) AS c FROM dispatch WHERE envio_data IS NOT NULL
             GROUP BY envio_data))""",
        _OVERALL,
    ),
    "bootstrap_rate_diff": _sql(
        """SELECT round(avg(diff), 9) AS diff_mean, round(quantile_cont(diff, 0.025), 9) AS ci_low,
             round(quantile_cont(diff, 0.975), 9) AS ci_high FROM diffs""",
        _BOOT,
    ),
    "ab_assign": _sql("SELECT cpf, arm, round(u, 9) AS u FROM arms", _SCORES, _PICKS),
    "ab_control_pick": _sql(
        "SELECT cpf, telefone, rank FROM drawn WHERE rank <= 2", _SCORES, _PICKS
    ),
    "ab_treatment_pick": _sql(
        """SELECT cpf, telefone, rank, round(final_score, 9) AS final_score
           FROM ranked JOIN arms USING (cpf) WHERE arm = 'tratamento' AND rank <= 2""",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "ab_primary": _sql(
        f"SELECT * EXCLUDE (tentativas, entregas) FROM ({_person_rates('arm')})",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "ab_secondary": _sql(
        """SELECT arm, tentativas, entregas, round(entregas / tentativas, 9) AS rate,
             round(tentativas / nullif(entregas, 0), 9) AS custo_por_entrega
           FROM (SELECT arm, count(*) AS tentativas,
                   CAST(coalesce(sum(delivered), 0) AS BIGINT) AS entregas FROM tries GROUP BY 1)""",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "ab_failures": _sql(
        """SELECT arm, descricao_falha, f AS falhas, round(f / t, 9) AS share
           FROM (SELECT arm, descricao_falha, count(*) FILTER (delivered = 0) AS f,
                   CAST(sum(count(*)) OVER (PARTITION BY arm) AS BIGINT) AS t
                 FROM tries GROUP BY 1, 2) WHERE f > 0""",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "response_times": _sql(
        f"""SELECT arm, count(*) AS respostas, round(quantile_cont(s, 0.5), 6) AS seconds_p50,
              round(quantile_cont(s, 0.9), 6) AS seconds_p90
            FROM (SELECT CASE WHEN {_uniform("cpf")} < 0.5 THEN 'controle' ELSE 'tratamento' END
                           AS arm, epoch(shipped - envio_datahora) AS s
                  FROM dispatch JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem
                                      GROUP BY 1) ON id_disparo = l_orderkey)
            GROUP BY 1"""
    ),
    "ab_guardrails": _sql(
        """SELECT arm, envio_data, count(*) AS tentativas,
             count(*) FILTER (validacao_telefone <> 'VALIDO') AS invalidas,
             round(count(*) FILTER (validacao_telefone <> 'VALIDO') / count(*), 9) AS taxa_invalidas,
             round(count(*) FILTER (delivered = 0) / count(*), 9) AS taxa_falhas
           FROM tries LEFT JOIN phones ON contato_telefone = telefone_numero GROUP BY 1, 2""",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "ab_daily": _sql(_person_rates("arm, envio_data"), _RATES, _SCORES, _PICKS),
}

# The same results by other ways: merged by day, updated in steps, looked up in a sorted table.
ORACLE |= {
    "events_incremental": ORACLE["events_roundtrip"],
    "profile_system_rates": ORACLE["rates_system"],
    "profile_age_rates": ORACLE["rates_age"],
    "profile_ranking": ORACLE["system_ranking"],
    "profile_area_rates": ORACLE["ddd_rates"],
    "profile_baseline": ORACLE["baseline_rate"],
    "profile_daily": _sql(
        f"""SELECT envio_data, n, round(successes / n, 9) AS rate, round({_LOW}, 9) AS ci_low,
              round({_HIGH}, 9) AS ci_high
            FROM (SELECT envio_data, count(*) AS n,
                    CAST(coalesce(sum(delivered), 0) AS BIGINT) AS successes FROM ev GROUP BY 1)"""
    ),
    "people_by_system": _sql(
        """SELECT id_sistema_mask, count(DISTINCT cpf) AS exact, TRUE AS "close"
           FROM ev GROUP BY id_sistema_mask"""
    ),
    "candidates_lookup": ORACLE["candidates_for_cpf"],
    "rates_multi_layout": ORACLE["rates_system_multi"],
}


def _upper_tail(z: str) -> str:
    def powers(factors: list[float]) -> str:
        total = repr(factors[0])
        for factor in factors[1:]:
            total = f"({total} * abs({z}) + {factor!r})"
        return total

    fraction = f"abs({z})"
    for step in range(NORMAL_STEPS, 0, -1):
        fraction = f"(abs({z}) + {float(step)} / {fraction})"
    density = f"exp(-{z} * {z} / 2)"
    tail = f"""CASE WHEN abs({z}) < {NORMAL_FAR!r} THEN {density} * {powers(NORMAL_TOP)} / {powers(NORMAL_BOTTOM)}
                    ELSE {density} / {fraction} / {math.sqrt(2 * math.pi)!r} END"""
    return f"(CASE WHEN {z} < 0 THEN 1 - ({tail}) ELSE {tail} END)"


_ARMS = """CAST(coalesce(sum({0}) FILTER (arm = 'controle'), 0) AS BIGINT) AS {0}_c,
  CAST(coalesce(sum({0}) FILTER (arm = 'tratamento'), 0) AS BIGINT) AS {0}_t"""
_BOTH = ", ".join(_ARMS.format(c) for c in ("pessoas", "alcancados"))
_PLANNED, _LOG = 20_000, -2 * math.log(0.05)
_RHO = repr((_LOG + math.log(_LOG) + 1) / _PLANNED)

ORACLE |= {
    "ab_test": _sql(
        f"""SELECT pessoas_c, alcancados_c, pessoas_t, alcancados_t, round(diff, 9) AS diff,
              round(z, 7) AS z, round({_upper_tail("z")}, 7) AS p_value,
              coalesce({_upper_tail("z")} < 0.05, FALSE) AS rejects
            FROM (SELECT *, alcancados_t / pessoas_t - alcancados_c / pessoas_c AS diff,
                    CASE WHEN q * (1 - q) > 0 THEN
                      (CAST(alcancados_t AS DOUBLE) / pessoas_t - CAST(alcancados_c AS DOUBLE) / pessoas_c)
                      / sqrt(q * (1 - q) * (1.0::DOUBLE / pessoas_t + 1.0::DOUBLE / pessoas_c)) END AS z
                  FROM (SELECT *, CAST(alcancados_c + alcancados_t AS DOUBLE) / (pessoas_c + pessoas_t) AS q
                        FROM (SELECT {_BOTH} FROM ({_person_rates("arm")}))))""",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "ab_sequential": _sql(
        f"""SELECT envio_data, pessoas_c, alcancados_c, pessoas_t, alcancados_t, round(diff, 9) AS diff,
              round(diff - reach, 7) AS lower, diff - reach > 0 AS stop
            FROM (SELECT *, rt - rc AS diff,
                    sqrt(2 * (n * {_RHO} + 1) / (n * {_RHO}) * ln(1 + sqrt(n * {_RHO} + 1) / 0.1::DOUBLE)
                         * (rc * (1 - rc) / pessoas_c + rt * (1 - rt) / pessoas_t)) AS reach
                  FROM (SELECT *, CAST(alcancados_c AS DOUBLE) / pessoas_c AS rc,
                          CAST(alcancados_t AS DOUBLE) / pessoas_t AS rt,
                          CAST(pessoas_c + pessoas_t AS DOUBLE) AS n
                        FROM (SELECT envio_data, {", ".join(
                            f"CAST(sum({c}) OVER (ORDER BY envio_data) AS BIGINT) AS {c}"
                            for c in ("pessoas_c", "alcancados_c", "pessoas_t", "alcancados_t"))}
                          FROM (SELECT envio_data, {_BOTH} FROM (
                              SELECT arm, first AS envio_data, 1 AS pessoas, 0 AS alcancados FROM entries
                              UNION ALL
                              SELECT arm, got, 0, 1 FROM entries WHERE got IS NOT NULL) GROUP BY 1))
                        WHERE pessoas_c > 0 AND pessoas_t > 0))""",
        _RATES,
        _SCORES,
        _PICKS,
        """entries AS (
  SELECT arm, cpf, min(envio_data) AS first, min(envio_data) FILTER (delivered = 1) AS got
  FROM tries WHERE envio_data IS NOT NULL GROUP BY 1, 2),
""",
    ),
    "ab_opt_outs": _sql(
        """SELECT arm, count(*) AS pessoas, CAST(sum(saiu) AS BIGINT) AS saidas,
             round(sum(saiu) / count(*), 9) AS taxa_saidas
           FROM (SELECT arm, cpf, max(CASE WHEN dia BETWEEN envio_data AND envio_data + 365 THEN 1 ELSE 0 END)
                   AS saiu
                 FROM tries LEFT JOIN (SELECT user_id, CAST(ts AS DATE) - 8300 AS dia FROM events
                                       WHERE event_type = 'error') ON user_id = cpf
                 GROUP BY 1, 2) GROUP BY 1""",
        _RATES,
        _SCORES,
        _PICKS,
    ),
    "bootstrap_by_person": _sql(
        """SELECT round(o.diff, 9) AS diff, round(o.se, 9) AS se,
             round(o.diff - high * o.se, 9) AS ci_low, round(o.diff - low * o.se, 9) AS ci_high
           FROM (SELECT * FROM by_rep WHERE rep = 0) o, (
             SELECT quantile_cont((r.diff - s.diff) / r.se, 0.025) AS low,
                    quantile_cont((r.diff - s.diff) / r.se, 0.975) AS high
             FROM by_rep r, (SELECT diff FROM by_rep WHERE rep = 0) s WHERE r.rep > 0 AND r.se > 0)""",
        f"""units AS (
  SELECT CASE WHEN {_uniform("cpf")} < 0.5 THEN 'controle' ELSE 'tratamento' END AS arm,
         CAST(floor({_uniform("'bucket'", "cpf")} * 200) AS BIGINT) AS bucket, delivered AS y
  FROM dispatch WHERE delivered IS NOT NULL),
bucket_sums AS (
  SELECT arm, bucket, CAST(sum(y) AS DOUBLE) AS y, count(*) AS n FROM units GROUP BY 1, 2),
replicates AS (
  SELECT rep, arm, y, n, {_uniform("arm", "bucket", "rep")} AS u
  FROM bucket_sums, range(0, 5001) r(rep)),
moments AS (
  SELECT rep, arm, sum(w * y) AS y, sum(w * n) AS n, sum(w * y * y) AS yy, sum(w * y * n) AS yn,
         sum(w * n * n) AS nn
  FROM (SELECT *, CASE WHEN rep = 0 THEN 1.0::DOUBLE ELSE {_STEPS} END AS w FROM replicates) GROUP BY 1, 2),
by_rep AS (
  SELECT rep, sum(CASE WHEN arm = 'tratamento' THEN y / n ELSE -y / n END) AS diff,
         sqrt(sum(greatest(0.0::DOUBLE, (yy - 2 * (y / n) * yn + (y / n) * (y / n) * nn) / (n * n)))) AS se
  FROM moments WHERE n > 0 GROUP BY rep HAVING count(*) = 2),
""",
    ),
}
