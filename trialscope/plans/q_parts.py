"""Second forms of inventory items: the other hash, the CSV source, pairs of levels, payoffs per baseline, thresholds of both
frames, implied bets; and DuckDB texts that fit the models of other modules step by step."""
from __future__ import annotations

from pyspark.sql import functions as F

from trialscope.functions.normal import pnorm_sql, qnorm_sql
from trialscope.operators import aggregates as D
from trialscope.operators import clean as B
from trialscope.operators import joins as C
from trialscope.operators import utility as U
from trialscope.plans.q_describe import EVID
from trialscope.plans.q_models import (CELLS_SQL, EXP_PAY, FR_SI, HEUR_SQL, STIM_SQL, _framed_payoff, _stimuli, _tax_sql, r6, rnd, trials)
from trialscope.plans.registry import ORACLE, query
from trialscope.plans.sqltext import noise_uniform_sql, with_ctes
from trialscope.sources import fixtures as X
from trialscope.sources import io as A

#: CRC-32 of a text of one-byte characters: the 256 table entries by rule, then a step a character
CRC_TABLE = ("SELECT list_transform(range(256), lambda b: list_reduce([b] || list_transform(range(8), lambda x: 0::BIGINT), "
             "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t")


def crc32_sql(text: str) -> str:
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), "
            "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)")


@query("B2_anonymize_crc32", with_ctes(
    f"SELECT event_id, lower(printf('%08x', w.h)) AS worker_id FROM responses JOIN (SELECT worker_id, {crc32_sql('CAST(worker_id AS VARCHAR)')} AS h "
    f"FROM (SELECT DISTINCT worker_id FROM responses), ({CRC_TABLE})) w USING (worker_id)", "responses"))
def b2_crc32(spark, sf):
    """The short worker code: eight hex digits of crc32."""
    return B.anonymize(X.responses(spark, sf).select("event_id", "worker_id"))


_CSV = {"workerId": "CAST(worker_id AS VARCHAR)", "batch": "'1'", "condition": "condition", "start_means": "start_means", "n_trials": "n_trials",
        "trial": "CAST(trial AS VARCHAR)", "trialIdx": "trial_idx", "groundTruth": "ground_truth", "sdDiff": "sd_diff", "baseline": "baseline",
        "award_value": "award_value", "accountValue": "n_trials + payoff", "pAwardWith": "p_award_with", "pAwardWithout": "p_award_without",
        "pSup": "p_superiority", "intervene": "intervene", "payoff": "payoff", "startTime": "CAST(trial AS DOUBLE)",
        "respTime": "CAST(trial AS DOUBLE) + trial_dur", "trialDur": "trial_dur"}


@query("A1_read_trials_csv", with_ctes(
    "SELECT " + ", ".join(f"round_even(CAST({e} AS DOUBLE), 6) AS {B.snake(n)}" if A.TRIAL_CSV_SCHEMA[n].dataType.simpleString() == "double"
                          else f"{e} AS {B.snake(n)}" for n, e in _CSV.items()) + " FROM responses", "responses"))
def a1_csv(spark, sf):
    """The experiment's trial CSV, written from the log with its camelCase header, read by its fixed schema (FAILFAST), renamed."""
    log = X.responses(spark, sf).select(*(F.expr(e.replace("VARCHAR", "STRING")).cast(A.TRIAL_CSV_SCHEMA[n].dataType).alias(n) for n, e in _CSV.items()))
    path = A.write_trials(log, A.scratch_path(spark, "a1_csv"), fmt="csv")
    return B.to_snake(A.read_trials(spark, path, A.TRIAL_CSV_SCHEMA, fmt="csv"))


@query("C14_level_pairs", with_ctes(
    "SELECT sd_diff, means, draw, a.condition AS \"left\", b.condition AS \"right\", round_even(b.value - a.value, 6) AS value FROM "
    "(SELECT *, list_position(['densities', 'intervals', 'HOPs', 'QDPs'], condition) AS i FROM fitted_llo WHERE lo_ground_truth = 1.0) a JOIN "
    "(SELECT *, list_position(['densities', 'intervals', 'HOPs', 'QDPs'], condition) AS i FROM fitted_llo WHERE lo_ground_truth = 1.0) b "
    "USING (sd_diff, means, draw) WHERE a.i < b.i", "fitted_llo"))
def c14(spark, sf):
    """Pairs of conditions within each design cell and draw, by a self-join on the draw."""
    from trialscope.plans.q_draws import fitted_llo
    f = fitted_llo(spark, sf).filter(F.col("lo_ground_truth") == 1.0)
    return C.level_pairs(f, "condition", X.CONDITIONS, ["sd_diff", "means", "draw"], "value")


@query("D29_payoff_per_baseline", with_ctes(
    "SELECT baseline, " + ", ".join([
        r6("v", "expected_value"), r6("n + n * k", "max_value"), r6("round_even(2.5 / v, 5)", "exchange_rate"),
        "round_even(v * round_even(2.5 / v, 5), 4) AS expected_bonus", "round_even((n + n * k) * round_even(2.5 / v, 5), 4) AS max_bonus"])
    + " FROM (SELECT baseline, n, k, n + n / 2 * k + ep AS v FROM (SELECT baseline, CAST(count(*) AS DOUBLE) AS n, max(award_value) AS k, sum(ep) AS ep FROM ("
    f"SELECT DISTINCT ground_truth, sd_diff, p_award_with, p_award_without, baseline, award_value, {EXP_PAY.format(si=FR_SI)} AS ep FROM framed) "
    "GROUP BY baseline))", "framed"))
def d29_baseline(spark, sf):
    """Payoffs of the design per baseline: one account that sees every design cell once."""
    cells = _framed_payoff(spark, sf).select("ground_truth", "sd_diff", "p_award_with", "p_award_without", "baseline", "award_value", "expected_payoff").distinct()
    return D.payoff_table(cells, "baseline")


_THRESHOLD = "{s}sqrt(sd_diff * sd_diff / 2.0) / sd_diff * (" + qnorm_sql("1.0 / award_value + 0.5") + " {s} 0.0)"


@query("I3_p_sup_threshold_frames", with_ctes(
    f"SELECT sd_diff, 'gain' AS frame, {r6(pnorm_sql(_THRESHOLD.format(s='+')), 'p_sup_threshold')} FROM (SELECT DISTINCT sd_diff, award_value FROM trials) "
    f"UNION ALL SELECT sd_diff, 'loss' AS frame, {r6(pnorm_sql(_THRESHOLD.format(s='-')), 'p_sup_threshold')} "
    "FROM (SELECT DISTINCT sd_diff, award_value FROM trials)", "trials"))
def i3_frames(spark, sf):
    """Truth at which intervening starts to pay, in both frames."""
    cells = trials(spark, sf).select("sd_diff", "award_value").distinct()
    both = F.array(*(F.struct(F.lit(f).alias("frame"), U.p_sup_threshold(frame=f).alias("p_sup_threshold")) for f in ("gain", "loss")))
    return cells.select("sd_diff", F.explode(both).alias("_f")).select("sd_diff", "_f.*")


@query("I13_heuristic_bets", with_ctes(
    f"SELECT {rnd('ground_truth')}, sd_diff, heuristic, {rnd('est_cles')}, bet AS est_bet FROM (SELECT *, round_even(est_cles / 100.0, 6) AS p FROM ({HEUR_SQL})) JOIN ("
    "SELECT p, bet, row_number() OVER (PARTITION BY p ORDER BY u DESC, bet) AS rn FROM (SELECT p, bet, round_even(0.75 * (1000.0 - bet) + pp * "
    + _tax_sql("bet / pp") + ", 9) AS u FROM (SELECT p, CASE WHEN p = 0 THEN 0.001 ELSE p END AS pp FROM (SELECT DISTINCT round_even(est_cles / 100.0, 6) AS p "
    f"FROM ({HEUR_SQL}))), (SELECT unnest(range(1, 1001)) AS bet))) USING (p) WHERE rn = 1", "trials"))
def i13_bets(spark, sf):
    """All heuristics in long form, each with the bet that its estimate implies."""
    h = U.heuristic_table(_stimuli(spark, sf), ["ground_truth", "sd_diff"])
    return U.with_implied_bets(h).withColumn("est_bet", F.col("est_bet").cast("long"))


_PAID = ("(CAST({u} <= CASE WHEN {c} THEN p_award_with ELSE p_award_without END AS DOUBLE) - CASE WHEN ground_truth > 0.5 THEN 0.0 ELSE 1.0 END) "
         "* award_value - CAST({c} AS DOUBLE)")


@query("I15_replay_log", with_ctes(
    f"SELECT condition, iter, {r6('sum(' + _PAID.format(u='u1', c='g') + ')', 'random_payoff')}, CAST(sum(CAST(g = si AS INT)) AS BIGINT) AS random_correct, "
    f"{r6('sum(' + _PAID.format(u='u2', c='si') + ')', 'optimal_payoff')}, count(*) AS n FROM (SELECT *, {noise_uniform_sql('event_id', 'iter', seed=11)} < 0.5 AS g, "
    f"{noise_uniform_sql('event_id', 'iter', seed=12)} AS u1, {noise_uniform_sql('event_id', 'iter', seed=13)} AS u2 FROM "
    f"(SELECT *, {FR_SI} AS si FROM framed), (SELECT CAST(unnest(range(1, 101)) AS INT) AS iter)) GROUP BY condition, iter", "framed"))
def i15_log(spark, sf):
    """The trial log replayed 100 times by coin flips and by the optimal rule, per condition."""
    f = B.framed(trials(spark, sf)).withColumns({"frame": B.frame(), "should_intervene": B.should_intervene_framed()})
    return U.replay_log(f, 100)


# DuckDB texts of fits -------------------------------------------------------
def newton_sql(key: str) -> str:
    """k, n, b0, b1, converged, iterations of logistic fits by Newton steps; NULL where x parts the outcomes."""
    return f"""(WITH RECURSIVE d AS MATERIALIZED (SELECT {key} AS k, CAST(intervene AS DOUBLE) AS y, {EVID} AS x FROM model WHERE intervene IS NOT NULL),
  s AS (SELECT k, count(*) AS n, min(x) FILTER (y = 1) AS lo1, max(x) FILTER (y = 1) AS hi1, min(x) FILTER (y <> 1) AS lo0, max(x) FILTER (y <> 1) AS hi0
    FROM d WHERE x IS NOT NULL GROUP BY k),
  it AS (SELECT k, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 1.0::DOUBLE AS change FROM s WHERE lo0 < hi1 AND lo1 < hi0
    UNION ALL
    SELECT k, i + 1, b0 + d0, b1 + d1, greatest(abs(d0) / (1 + abs(b0)), abs(d1) / (1 + abs(b1))) FROM (
      SELECT k, i, b0, b1, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS d0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS d1 FROM (
        SELECT k, i, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
        FROM (SELECT it.*, x, y, 1.0 / (1.0 + exp(-(b0 + b1 * x))) AS p FROM it JOIN d USING (k) WHERE x IS NOT NULL AND change > 1e-9 AND i < 100)
        GROUP BY k, i, b0, b1)))
  SELECT s.k, n, b0, b1, coalesce(change <= 1e-9, false) AS converged, coalesce(i, 0) AS iterations FROM s
  LEFT JOIN (SELECT k, max(i) AS i, arg_max(b0, i) AS b0, arg_max(b1, i) AS b1, arg_max(change, i) AS change FROM it GROUP BY k) f USING (k))"""


_LINE = (f"{r6('b0', 'intercept')}, {r6('b1', 'slope')}, n, converged, CAST(iterations AS INT) AS iterations, "
         f"{r6('CASE WHEN b1 <> 0 THEN -b0 / b1 END', 'pse')}, {r6('CASE WHEN b1 <> 0 THEN ln(3.0) / b1 END', 'jnd')}")
ORACLE["H5_logit_fit"] = with_ctes(f"SELECT k AS worker_id, {_LINE} FROM {newton_sql('worker_id')}", "model")
ORACLE["H5_logit_pooled"] = with_ctes(f"SELECT {_LINE} FROM {newton_sql('0')}", "model")
ORACLE["G14_worker_stats"] = with_ctes(
    f"SELECT coalesce(l.worker_id, f.k) AS worker_id, {r6('l.b', 'llo_slope')}, {r6('f.b1', 'dec_slope')}, {r6('f.b0', 'dec_intercept')}, "
    f"{r6('CASE WHEN f.b1 <> 0 THEN -f.b0 / f.b1 END', 'pse')}, {r6('ln(3.0) / f.b1', 'jnd')} FROM (SELECT worker_id, regr_slope(lo_p_sup, lo_ground_truth) AS b "
    f"FROM model GROUP BY worker_id) l FULL JOIN {newton_sql('worker_id')} f ON f.k = l.worker_id WHERE f.b1 > 0", "model")

# one linear model of two predictors, by its centred sums
ORACLE["H11_llo_prev_fit"] = with_ctes(
    "SELECT 'llo_prev' AS model, unnest(['intercept', 'lo_ground_truth', 'prev_lo_p_sup']) AS term, "
    "unnest([round_even(my - b1 * m1 - b2 * m2, 6), round_even(b1, 6), round_even(b2, 6)]) AS estimate FROM ("
    "SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM ("
    "SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, regr_sxx(y, x1) AS s11, regr_sxx(y, x2) AS s22, regr_sxy(x1, x2) AS s12, regr_sxy(y, x1) AS s1y, "
    "regr_sxy(y, x2) AS s2y FROM (SELECT lo_p_sup AS y, lo_ground_truth AS x1, coalesce(lag(lo_p_sup) OVER (PARTITION BY worker_id ORDER BY trial), 0.0) AS x2 "
    "FROM model)))", "model")

_DESIGN = ("SELECT ground_truth, sd_diff FROM (SELECT DISTINCT ground_truth FROM trials WHERE ground_truth > 0.5 AND ground_truth < 0.999), "
           "(SELECT unnest([5, 15]) AS sd_diff) EXCEPT SELECT ground_truth, sd_diff FROM trials WHERE sd_diff = 15 AND ground_truth > 0.8")
_NAME = ("CAST(sd_diff AS VARCHAR) || '_sd_diff_' || CASE WHEN round_even(ground_truth, 3) = floor(round_even(ground_truth, 3)) "
         "THEN CAST(CAST(floor(round_even(ground_truth, 3)) AS BIGINT) AS VARCHAR) ELSE CAST(round_even(ground_truth, 3) AS VARCHAR) END || '_p_sup'")
ORACLE["I16_design_table"] = with_ctes(
    f"SELECT {rnd('ground_truth')}, sd_diff, Team, {rnd('mean_diff sd mean p_award')}, {_NAME} AS condition FROM ({STIM_SQL.replace(CELLS_SQL, _DESIGN)})", "trials")
