"""DuckDB text of the stand-in tables and the cleaning chain, for the oracle queries.

The oracle is written independently of the DataFrame code: plain SQL over the
driver's pre-registered views.  ``with_ctes`` prepends the named CTEs a query
needs, in dependency order.
"""
from __future__ import annotations

from trialscope.functions.normal import pnorm_sql, qnorm_sql
from trialscope.operators.draws import LAST, M31, MULTIPLIERS

D = "::DOUBLE"

CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None) -> None:
    CTES[name] = sql
    DEPS[name] = deps or []


cte("resp_base", f"""
  SELECT event_id, user_id, event_type, value, ts,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS trial,
         CAST(count(*) OVER (PARTITION BY user_id) AS INT) AS n_trials,
         lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_us,
         CAST(event_id % 10 AS INT) AS lv
  FROM events""")

cte("resp_b", f"""
  SELECT *,
    CASE lv WHEN 0 THEN 0.5{D} WHEN 9 THEN 0.999{D} ELSE 0.55{D} + 0.05{D}*lv END AS ground_truth,
    CASE user_id % 4 WHEN 0 THEN 'densities' WHEN 1 THEN 'intervals'
                     WHEN 2 THEN 'HOPs' ELSE 'QDPs' END AS condition,
    (CAST(floor(user_id/4) AS BIGINT) % 2 = 0) AS start_means,
    CASE WHEN CAST(floor(event_id/10) AS BIGINT) % 2 = 0 THEN 5 ELSE 15 END AS sd_diff
  FROM resp_base""", ["resp_base"])

cte("responses", f"""
  SELECT event_id, user_id AS worker_id, trial, n_trials,
    CASE WHEN trial = 1 THEN 'practice' WHEN trial = 2 THEN 'mock' ELSE CAST(trial AS VARCHAR) END AS trial_idx,
    condition, start_means, sd_diff, ground_truth,
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN event_id % 31 = 0 THEN 0.0{D}
         WHEN event_id % 37 = 0 THEN 100.0{D}
         ELSE least(100.0{D}, greatest(0.0{D}, floor(0.6{D}*100*ground_truth + value/10.0{D}))) END AS p_superiority,
    CASE WHEN lv = 0 AND user_id % 3 <> 0 THEN 0
         WHEN lv = 9 AND user_id % 3 <> 0 THEN 1
         WHEN event_type = 'error' THEN -1
         WHEN event_type IN ('purchase','signup') THEN 1
         ELSE CASE WHEN lv >= 5 THEN 1 ELSE 0 END END AS intervene,
    CASE WHEN value < 100 THEN -1.0{D} ELSE 2.25{D} END AS payoff,
    2.25{D} AS award_value, 0.5{D} AS baseline,
    {pnorm_sql(f"sqrt(2.0{D})*" + qnorm_sql("ground_truth"))} AS p_award_with,
    0.5{D} AS p_award_without,
    (epoch_us(ts) - prev_us) / 1e6 AS trial_dur
  FROM resp_b""", ["resp_b"])

# EV cleaning chain: practice dropped, bounds nudged, missing dropped, decisions repaired, means block.
cte("trials", f"""
  SELECT * REPLACE (
      CASE WHEN intervene = -1 THEN CASE WHEN payoff = award_value - 1 OR payoff = -1 THEN 1 ELSE 0 END
           ELSE intervene END AS intervene,
      CASE WHEN p_superiority = 0 THEN 0.5{D} WHEN p_superiority = 100 THEN 99.5{D} ELSE p_superiority END AS p_superiority),
    ((start_means AND trial <= n_trials / 2) OR (NOT start_means AND trial > n_trials / 2)) AS means
  FROM responses
  WHERE trial_idx NOT IN ('practice', 'mock') AND p_superiority IS NOT NULL""", ["responses"])

# OP chain: like trials but no nudge and no dropping of missing answers.
cte("op_trials", f"""
  SELECT * REPLACE (
      CASE WHEN intervene = -1 THEN CASE WHEN payoff = award_value - 1 OR payoff = -1 THEN 1 ELSE 0 END
           ELSE intervene END AS intervene)
  FROM responses
  WHERE trial_idx NOT IN ('practice', 'mock')""", ["responses"])


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def r6(expr: str, name: str) -> str:
    """Report a double at 6 decimals, half to even (matches ``finish`` on the Spark side)."""
    return f"round_even(({expr}), 6) AS {name}"


cte("framed", f"""
  SELECT event_id, worker_id, trial, n_trials, condition, sd_diff, start_means AS start_gain_frame,
    CASE WHEN (start_means AND trial <= n_trials / 2) OR (NOT start_means AND trial > n_trials / 2)
         THEN ground_truth ELSE 1.0 - ground_truth END AS ground_truth,
    CASE WHEN (start_means AND trial <= n_trials / 2) OR (NOT start_means AND trial > n_trials / 2)
         THEN p_superiority ELSE 100.0 - p_superiority END AS p_superiority,
    intervene, payoff, award_value, baseline, p_award_with, p_award_without
  FROM trials""", ["trials"])

# PS chain: modelling table with log odds, centred trial and exclusions applied.
cte("model_pre", f"""
  SELECT * REPLACE (
      CASE WHEN intervene = -1 THEN CASE WHEN payoff = award_value - 1 OR payoff = -1 THEN 1 ELSE 0 END
           ELSE intervene END AS intervene,
      CASE WHEN p_superiority > 99.5 THEN 99.5{D} WHEN p_superiority < 0.5 THEN 0.5{D} ELSE p_superiority END AS p_superiority),
    ((start_means AND trial <= n_trials / 2) OR (NOT start_means AND trial > n_trials / 2)) AS means
  FROM responses
  WHERE trial_idx NOT IN ('practice', 'mock') AND p_superiority IS NOT NULL""", ["responses"])

cte("model_lo", f"""
  SELECT *, ln((p_superiority/100.0)/(1.0-(p_superiority/100.0))) AS lo_p_sup,
         ln(ground_truth/(1.0-ground_truth)) AS lo_ground_truth,
         (trial - n_trials/2)/n_trials AS trial_c
  FROM model_pre""", ["model_pre"])

cte("model_flags", f"""
  SELECT worker_id,
    (sum(CAST((ground_truth = 0.5 AND intervene <> 0) OR (ground_truth = 0.999 AND intervene <> 1) AS INT)) > 0
     OR count(DISTINCT p_superiority) + max(CAST(p_superiority IS NULL AS INT)) < 3) AS exclude
  FROM model_lo GROUP BY worker_id""", ["model_lo"])

cte("model", f"""
  SELECT m.*, f.exclude FROM model_lo m LEFT JOIN model_flags f USING (worker_id)
  WHERE NOT f.exclude AND m.ground_truth > 0.5 AND m.ground_truth < 0.999""", ["model_lo", "model_flags"])

# OP exclusions (answers not dropped, NULL counts as a level).
cte("op_flags", f"""
  SELECT worker_id,
    sum(CAST((ground_truth = 0.5 AND intervene <> 0) OR (ground_truth = 0.999 AND intervene <> 1) AS INT)) AS failed_attention_checks,
    count(DISTINCT p_superiority) + max(CAST(p_superiority IS NULL AS INT)) AS unique_p_sup
  FROM op_trials GROUP BY worker_id""", ["op_trials"])

cte("op_excl", f"""
  SELECT t.*, (f.failed_attention_checks > 0 OR f.unique_p_sup < 3) AS exclude
  FROM op_trials t LEFT JOIN op_flags f USING (worker_id)""", ["op_trials", "op_flags"])

cte("strategies", f"""
  SELECT doc_id AS worker_id,
    CASE doc_id % 4 WHEN 0 THEN 'densities' WHEN 1 THEN 'intervals' WHEN 2 THEN 'HOPs' ELSE 'QDPs' END AS condition,
    (doc_id % 2 = 0) AS start_means, lower(text) AS open_codes, (n_chars > 200) AS answered,
    CASE WHEN contains(lower(text), 'thble') THEN 'yes' ELSE 'no' END AS mentioned_distance,
    CASE WHEN contains(lower(text), 'thing') THEN 'yes' ELSE 'no' END AS mentioned_mean,
    CASE WHEN contains(lower(text), 'attion') THEN 'yes' ELSE 'no' END AS mentioned_variance,
    CASE WHEN contains(lower(text), 'whst') THEN 'yes' ELSE 'no' END AS mentioned_threshold,
    CASE WHEN contains(lower(text), 'ndble') THEN 'yes' ELSE 'no' END AS mentioned_area,
    CASE WHEN contains(lower(text), 'shat') THEN 'yes' ELSE 'no' END AS mentioned_frequency,
    CASE WHEN contains(lower(text), 'eauou') THEN 'yes' ELSE 'no' END AS mentioned_confusion
  FROM documents""")

cte("draws", """
  SELECT vec_id AS draw, label AS chain, CAST(t.i - 1 AS INT) AS term, CAST(embedding[t.i] AS DOUBLE) AS beta
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) t""")

CELL = ("((CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' THEN 1 WHEN 'HOPs' THEN 2 ELSE 3 END)*4 "
        "+ CAST(sd_diff = 15 AS INT)*2 + CAST(means AS INT))")


def u_sql(*cols: str, seed: int = 1234) -> str:
    """Hashed uniform on (0, 1), as ``draws.hash_uniform``."""
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"((CAST('0x' || substr(md5({parts} || '|{seed}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


cte("grid_llo", """
  SELECT g.condition, g.sd_diff, g.means, x.lo_ground_truth
  FROM (SELECT DISTINCT condition, sd_diff, means FROM model) g, (SELECT unnest([0.0, 1.0]) AS lo_ground_truth) x""", ["model"])

cte("fitted_llo", f"""
  SELECT g.condition, g.sd_diff, g.means, g.lo_ground_truth, d.draw, sum(g.x * d.beta) AS value
  FROM (SELECT condition, sd_diff, means, lo_ground_truth, 2*{CELL} AS term, 1.0::DOUBLE AS x FROM grid_llo
        UNION ALL SELECT condition, sd_diff, means, lo_ground_truth, 2*{CELL}+1 AS term, lo_ground_truth AS x FROM grid_llo) g
  JOIN draws d USING (term)
  GROUP BY g.condition, g.sd_diff, g.means, g.lo_ground_truth, d.draw""", ["grid_llo", "draws"])

cte("grid_dec", """
  SELECT g.condition, g.sd_diff, g.means, x.evidence
  FROM (SELECT DISTINCT condition, sd_diff, means FROM model) g, (SELECT unnest([0.0, 1.0]) AS evidence) x""", ["model"])

cte("fitted_dec", f"""
  SELECT g.condition, g.sd_diff, g.means, g.evidence, d.draw, sum(g.x * d.beta) AS value
  FROM (SELECT condition, sd_diff, means, evidence, 32+2*{CELL} AS term, 1.0::DOUBLE AS x FROM grid_dec
        UNION ALL SELECT condition, sd_diff, means, evidence, 32+2*{CELL}+1 AS term, evidence AS x FROM grid_dec) g
  JOIN draws d USING (term)
  GROUP BY g.condition, g.sd_diff, g.means, g.evidence, d.draw""", ["grid_dec", "draws"])

cte("stats_dec", """
  SELECT condition, sd_diff, means, draw,
    max(value) FILTER (WHERE evidence = 1.0) - max(value) FILTER (WHERE evidence = 0.0) AS slope,
    max(value) FILTER (WHERE evidence = 0.0) AS intercept
  FROM fitted_dec GROUP BY condition, sd_diff, means, draw""", ["fitted_dec"])

cte("psy_dec", """
  SELECT *, CASE WHEN slope = 0 THEN NULL ELSE -intercept / slope END AS pse,
         CASE WHEN slope = 0 THEN NULL ELSE ln(3.0) / slope END AS jnd
  FROM stats_dec""", ["stats_dec"])

for _n in (100, 500):
    cte(f"draws{_n}", f"""
  SELECT * FROM draws WHERE draw IN (SELECT draw FROM (SELECT DISTINCT draw FROM draws)
    ORDER BY md5(CAST(draw AS VARCHAR) || '|1234') LIMIT {_n})""", ["draws"])


def noise_sql(*cols: str, seed: int = 1234) -> str:
    """A 31-bit hash of integer keys and a seed, as ``draws.noise_state``."""
    x = f"{seed % M31}::BIGINT"
    for k, c in enumerate(cols):
        x = f"((({x} + (CAST({c} AS BIGINT) % {M31} + {M31}) % {M31}) % {M31}) * {MULTIPLIERS[k % 2]} % {M31})"
    for k, shift in enumerate((13, 11)):
        x = f"(xor({x}, {x} >> {shift}) * {MULTIPLIERS[2 + k]} % {M31})"
    return x


def noise_uniform_sql(*cols: str, seed: int = 1234) -> str:
    return f"(({noise_sql(*cols, seed=seed)} * {LAST[0]} % {M31} + 0.5::DOUBLE) / {M31}.0::DOUBLE)"


def normal_sql(*cols: str, seed: int = 1234) -> str:
    """Box-Muller standard normal from two hashed uniforms of integer keys, as ``draws.hash_normal``."""
    x = noise_sql(*cols, seed=seed)
    u1, u2 = (f"(({x} * {m} % {M31} + 0.5::DOUBLE) / {M31}.0::DOUBLE)" for m in LAST)
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u2}))"


def md5_normal_sql(*cols: str, seed: int = 1234) -> str:
    """Box-Muller standard normal from two md5 uniforms, as ``draws.md5_normal``."""
    return f"(sqrt(-2.0 * ln({u_sql(*cols, seed=seed)})) * cos(6.283185307179586 * {u_sql(*cols, seed=seed + 1)}))"


# predictions of every trial from all draws, and from the 500 of the residual check
for _name, _draws in (("pred_trials", "draws"), ("pit_trials", "draws500")):
    cte(_name, f"""
  SELECT m.event_id, m.lo_p_sup, a.draw, a.beta + m.lo_ground_truth * b.beta AS mu
  FROM (SELECT *, 2*{CELL} AS term FROM model) m JOIN {_draws} a ON a.term = m.term
  JOIN {_draws} b ON b.term = m.term + 1 AND b.draw = a.draw""", ["model", _draws])
    cte(f"{_name}_y", f"""
  SELECT event_id, lo_p_sup, draw, mu, mu + 1.0 * {normal_sql('event_id', 'draw')} AS prediction,
         -0.5*(lo_p_sup - mu)*(lo_p_sup - mu) - 0.9189385332046727 AS ll
  FROM {_name}""", [_name])

# the tally's predictions
cte("tally_trials_y", f"""
  SELECT draw, mu + 1.0 * {md5_normal_sql('event_id', 'draw')} AS prediction FROM pred_trials""", ["pred_trials"])
