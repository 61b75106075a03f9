"""Queries for model fits (H), utility / heuristic columns (I) and scalar / array functions (F)."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialscope.functions import arrays as FA
from trialscope.functions.normal import (bern_logit_logpmf, norm_logpdf, normal_interval, plogis, pnorm, pnorm_sql,
                                         qlogis, qnorm, qnorm_sql)
from trialscope.operators import aggregates as D
from trialscope.operators import clean as B
from trialscope.operators import draws as G
from trialscope.operators import joins as C
from trialscope.operators import models as H
from trialscope.operators import reshape as E
from trialscope.operators import utility as U
from trialscope.plans.q_draws import coefficients, modelled, patterns
from trialscope.plans.registry import query
from trialscope.plans.sqltext import CELL, u_sql, with_ctes
from trialscope.session import cut_lineage
from trialscope.sources import fixtures as X

D_ = "::DOUBLE"


def rnd(cols: str) -> str:
    return ", ".join(f"round_even({c}, 6) AS {c}" for c in cols.split())


def r6(expr: str, name: str) -> str:
    return f"round_even({expr}, 6) AS {name}"


def model(spark, sf):
    return B.model_table(X.responses(spark, sf))


def trials(spark, sf):
    return B.clean_trials(X.responses(spark, sf))


# H -------------------------------------------------------------------------
@query("H1_llo_fit", with_ctes(
    f"SELECT condition, means, {r6('regr_slope(lo_p_sup, lo_ground_truth)', 'slope')}, "
    f"{r6('regr_intercept(lo_p_sup, lo_ground_truth)', 'intercept')}, {r6('regr_r2(lo_p_sup, lo_ground_truth)', 'r2')}, "
    "regr_count(lo_p_sup, lo_ground_truth) AS n FROM model GROUP BY ALL", "model"))
def h1(spark, sf):
    return H.llo_fit(model(spark, sf), ["condition", "means"])


def _llo_features():
    f = {"intercept": F.lit(1.0), "lo_ground_truth": F.col("lo_ground_truth")}
    for c in X.CONDITIONS[1:]:
        f[f"cond_{c}"] = (F.col("condition") == c).cast("double")
        f[f"lo_gt_x_{c}"] = (F.col("condition") == c).cast("double") * F.col("lo_ground_truth")
    f["means"] = F.col("means").cast("double")
    f["lo_gt_x_means"] = F.col("means").cast("double") * F.col("lo_ground_truth")
    f["sd15"] = (F.col("sd_diff") == 15).cast("double")
    f["lo_gt_x_sd15"] = (F.col("sd_diff") == 15).cast("double") * F.col("lo_ground_truth")
    return f


@query("H2_llo_pooled")
def h2(spark, sf):
    """Pooled LLO with condition, means and sd interactions; Normal(1, .5) prior on the slope."""
    coefs = H.llo_pooled(model(spark, sf), _llo_features(), prior={"lo_ground_truth": (1.0, 0.5)})
    return H.coefficients_df(spark, coefs, model="llo_pooled")


@query("H3_llo_shrink", with_ctes(
    "SELECT p.condition, p.worker_id, " + ", ".join([
        r6("p.slope", "slope"), r6("p.intercept", "intercept"), "p.n", r6("p.v", "v"), r6("q.mu", "mu"), r6("q.tau2", "tau2"),
        r6("CASE WHEN q.tau2 + p.v > 0 THEN (q.tau2 * p.slope + p.v * q.mu) / (q.tau2 + p.v) ELSE q.mu END", "slope_shrunk")])
    + " FROM (SELECT *, greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2) / sxx AS v FROM (SELECT condition, worker_id, "
    "regr_slope(lo_p_sup, lo_ground_truth) AS slope, regr_intercept(lo_p_sup, lo_ground_truth) AS intercept, "
    "regr_count(lo_p_sup, lo_ground_truth) AS n, regr_sxx(lo_p_sup, lo_ground_truth) AS sxx, regr_syy(lo_p_sup, lo_ground_truth) AS syy, "
    "regr_sxy(lo_p_sup, lo_ground_truth) AS sxy FROM model GROUP BY ALL) WHERE n >= 3 AND sxx > 0) p JOIN "
    "(SELECT condition, avg(slope) AS mu, greatest(var_samp(slope) - avg(v), 0.0) AS tau2 FROM (SELECT *, "
    "greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2) / sxx AS v FROM (SELECT condition, worker_id, "
    "regr_slope(lo_p_sup, lo_ground_truth) AS slope, regr_count(lo_p_sup, lo_ground_truth) AS n, "
    "regr_sxx(lo_p_sup, lo_ground_truth) AS sxx, regr_syy(lo_p_sup, lo_ground_truth) AS syy, regr_sxy(lo_p_sup, lo_ground_truth) AS sxy "
    "FROM model GROUP BY ALL) WHERE n >= 3 AND sxx > 0) GROUP BY condition) q USING (condition)", "model"))
def h3(spark, sf):
    return H.llo_shrink(model(spark, sf), keys=["condition"])


@query("H3_llo_hierarchical")
def h3_hierarchical(spark, sf):
    """Workers' lines around their condition's, intercept and slope varying together between workers."""
    return H.llo_hierarchical(model(spark, sf), ["condition"], tol=1e-5)


@query("H4_log_sigma_fit")
def h4(spark, sf):
    """Residual spread by sd level and means (two passes)."""
    m = model(spark, sf)
    sig = {"intercept": F.lit(1.0), "sd15": (F.col("sd_diff") == 15).cast("double"), "means": F.col("means").cast("double")}
    res = H.log_sigma_fit(m, _llo_features(), sig)
    rows = [(part, k, float(v)) for part, d in res.items() for k, v in d.items()]
    return spark.createDataFrame(rows, "part string, term string, estimate double")


def _dec(spark, sf):
    return B.evidence(model(spark, sf))


@query("H5_logit_fit")
def h5(spark, sf):
    """Logistic decision model per worker (all workers at once, each to its convergence), with PSE and JND."""
    return H.logit_fit(_dec(spark, sf), ["worker_id"])


@query("H5_logit_pooled")
def h5_pooled(spark, sf):
    """The same model over all trials, with PSE and JND."""
    return H.logit_fit(_dec(spark, sf))


@query("H6_probit_fit")
def h6(spark, sf):
    return H.probit_fit(_dec(spark, sf), ["condition"])


@query("H7_ordinal_fit")
def h7(spark, sf):
    """Cumulative, adjacent-category and category-specific logit models of the bet class on truth and condition (pooled)."""
    t = model(spark, sf).withColumn("ordinal_bet", B.ordinal_bet(F.col("p_superiority") * 10))
    features = {"lo_ground_truth": F.col("lo_ground_truth")}
    conds = {f"cond_{c}": (F.col("condition") == c).cast("double") for c in X.CONDITIONS[1:]}
    t = cut_lineage(t.select("ordinal_bet", "lo_ground_truth", "condition"))
    rows = []
    for form in H.ORDINAL_FORMS:
        coefs, told = H.ordinal_fit(t, "ordinal_bet", features | conds, 3, form, list(conds))
        rows += [(form, k, v, told["loglik"], bool(told["converged"]), int(told["iterations"])) for k, v in coefs.items()]
    return spark.createDataFrame(rows, "model string, term string, estimate double, loglik double, converged boolean, iterations int")


@query("H8_mixture_fit")
def h8(spark, sf):
    """LLO line vs constant answer at 50 %, share of the line per condition."""
    return H.mixture_fit(model(spark, sf), ["condition"], const=0.0)


@query("H9_bootstrap_draws", with_ctes(
    "SELECT condition, draw, " + r6("(sy - ((sw * sxy - sx * sy) / (sw * sxx - sx * sx)) * sx) / sw", "intercept") + ", "
    + r6("(sw * sxy - sx * sy) / (sw * sxx - sx * sx)", "slope") + " FROM (SELECT condition, draw, sum(w * c) AS sw, "
    "sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * sxy) AS sxy FROM (SELECT *, CASE "
    + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(H.POISSON1_CUTS)) +
    f" ELSE 8 END AS w FROM (SELECT *, {u_sql('worker_id', 'draw', seed=7)} AS u FROM (SELECT condition, worker_id, "
    "CAST(count(*) AS DOUBLE) AS c, sum(lo_ground_truth) AS sx, sum(lo_p_sup) AS sy, sum(lo_ground_truth * lo_ground_truth) AS sxx, "
    "sum(lo_ground_truth * lo_p_sup) AS sxy FROM model GROUP BY ALL), (SELECT unnest(range(0, 200)) AS draw))) WHERE w > 0 "
    "GROUP BY ALL)", "model"))
def h9(spark, sf):
    return H.bootstrap_draws(model(spark, sf), ["condition"], 200, seed=7)


@query("H10_censored_fit")
def h10(spark, sf):
    """Tobit LLO of answers censored at 50.5 and 99.5 % (gain frame), per condition."""
    t = B.censor(trials(spark, sf).filter(F.col("ground_truth") > 0.5))
    t = t.withColumns({"lo_c": qlogis(F.col("p_sup_censored") / 100.0), "lo_ground_truth": qlogis("ground_truth")})
    return H.censored_fit(t, ["condition"], "lo_c", "lo_ground_truth",
                          math.log(0.505 / 0.495), math.log(0.995 / 0.005))


@query("H11_llo_prev_fit")
def h11(spark, sf):
    """Answer on truth and the previous answer of the worker (lagged in trial order)."""
    m = E.lag_by(model(spark, sf), ["worker_id"], ["trial"], "lo_p_sup", 0.0)
    feats = {"intercept": F.lit(1.0), "lo_ground_truth": F.col("lo_ground_truth"), "prev_lo_p_sup": F.col("prev_lo_p_sup")}
    return H.coefficients_df(spark, H.llo_pooled(m, feats), model="llo_prev")


def _stimuli(spark, sf):
    """Stimulus cells seen in the data, with team parameters and difference draws."""
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct()
    st = U.stimulus_params(cells).filter(F.col("Team") == U.TEAMS[0])
    st = B.add_global_max_abs(st, "mean_diff", "max_abs_mean_diff")
    return st.withColumn("draws_diff", U.quantile_dots("mean_diff", "sd_diff", 20))


@query("H12_heuristic_shares")
def h12(spark, sf):
    """Share of answers that each heuristic, guess-one among them, explains: overall, and per worker drawn to the overall shares."""
    cell = ["ground_truth", "sd_diff"]
    stim = _stimuli(spark, sf)
    h = U.heuristic_table(stim, cell).unionByName(stim.select(*cell, F.lit("guess_one").alias("heuristic"), U.h_guess_one().alias("est_cles")))
    t = trials(spark, sf).select("worker_id", *cell, F.col("p_superiority").alias("answer"))
    return H.heuristic_shares(t, cut_lineage(h.withColumnRenamed("est_cles", "estimate")), cell)


@query("H13_intercept_fit", with_ctes(
    f"SELECT condition, {r6('avg(lo_p_sup)', 'intercept')}, {r6('stddev_samp(lo_p_sup)', 'sigma')}, "
    f"{r6('ln(avg(CAST(intervene AS DOUBLE)) / (1.0 - avg(CAST(intervene AS DOUBLE))))', 'intercept_decision')} "
    "FROM model GROUP BY condition", "model"))
def h13(spark, sf):
    return H.intercept_fit(model(spark, sf), "lo_p_sup", ["condition"], "intervene")


_LL = "-0.5 * (lo_p_sup - {mu}) * (lo_p_sup - {mu}) - 0.9189385332046727"


@query("H14_compare_models", with_ctes(
    f"SELECT model, {rnd('lppd p_waic elpd_waic')}, {r6('-2.0 * elpd_waic', 'waic')}, n_obs, {r6('elpd_waic - max(elpd_waic) OVER ()', 'elpd_diff')} FROM ("
    "SELECT model, sum(lppd) AS lppd, sum(p_waic) AS p_waic, sum(lppd) - sum(p_waic) AS elpd_waic, count(*) AS n_obs FROM ("
    "SELECT model, event_id, max(m) + ln(sum(exp(ll - m))) - ln(count(*)) AS lppd, var_samp(ll) AS p_waic FROM (SELECT *, max(ll) OVER (PARTITION BY model, event_id) AS m FROM ("
    f"SELECT 'llo' AS model, event_id, {_LL.format(mu='(a + lo_ground_truth * b)')} AS ll FROM cells UNION ALL "
    f"SELECT 'unbiased' AS model, event_id, {_LL.format(mu='(a + lo_ground_truth)')} AS ll FROM cells)) GROUP BY model, event_id) GROUP BY model)",
    "model", "draws").replace("\nSELECT model, ", f""",
cells AS (SELECT m.event_id, m.lo_p_sup, m.lo_ground_truth, a.beta AS a, b.beta AS b FROM (SELECT *, 2*{CELL} AS term FROM model) m JOIN draws a ON a.term = m.term
  JOIN draws b ON b.term = m.term + 1 AND b.draw = a.draw)
SELECT model, """, 1))
def h14(spark, sf):
    """WAIC of the cell LLO model vs the same model with slopes fixed at 1, and the difference."""
    fit, of = patterns(modelled(spark, sf), coefficients(spark, sf))
    mus = F.array(F.struct(F.lit("llo").alias("model"), F.col("mu").alias("mu")),
                  F.struct(F.lit("unbiased").alias("model"), (F.col("b0") + F.col("lo_ground_truth")).alias("mu")))
    ll = fit.select("pattern", "lo_p_sup", F.explode(mus).alias("_m")).select(
        "pattern", "_m.model", norm_logpdf("lo_p_sup", F.col("_m.mu"), 1.0).alias("ll"))
    w = G.waic(ll, ["pattern"], model_key=["model"], counts=of.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    w = cut_lineage(w)  # a row a model, read twice
    best = w.agg(F.max("elpd_waic")).scalar()
    return w.withColumn("elpd_diff", F.col("elpd_waic") - best)


# I -------------------------------------------------------------------------
CELLS_SQL = ("SELECT DISTINCT ground_truth, sd_diff FROM trials WHERE ground_truth > 0.5 AND ground_truth < 0.999")
STIM_SQL = ("SELECT ground_truth, sd_diff, Team, mean_diff, sd, mean, " + pnorm_sql("(mean - 100.0) / sd") + " AS p_award FROM ("
            "SELECT *, CASE WHEN Team = 'Without the New Player' THEN 100.0 - sd * 0.0 ELSE 100.0 - sd * 0.0 + mean_diff END AS mean "
            "FROM (SELECT *, sqrt(sd_diff * sd_diff / 2.0) AS sd FROM (SELECT ground_truth, sd_diff, sd_diff * "
            + qnorm_sql("ground_truth") + " AS mean_diff, unnest(['With the New Player', 'Without the New Player']) AS Team "
            f"FROM ({CELLS_SQL}))))")


@query("I1_stimulus_params", with_ctes(
    f"SELECT {rnd('ground_truth')}, sd_diff, Team, {rnd('mean_diff sd mean p_award')} FROM ({STIM_SQL})", "trials"))
def i1(spark, sf):
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct()
    return U.stimulus_params(cells)


@query("I2_award_value", with_ctes(
    f"SELECT {rnd('ground_truth')}, sd_diff, round_even(round_even(1.0 / ("
    + pnorm_sql(f"{qnorm_sql('ground_truth')} * sqrt(2.0) - 0.0") + f" - 0.5), 2), 6) AS award_value FROM ({CELLS_SQL})", "trials"))
def i2(spark, sf):
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct()
    cells = cells.withColumn("_d", qnorm("ground_truth") * math.sqrt(2.0))
    return cells.select("ground_truth", "sd_diff", U.award_value(F.col("_d")).alias("award_value"))


@query("I3_p_sup_threshold", with_ctes(
    f"SELECT sd_diff, {r6(pnorm_sql('sqrt(sd_diff * sd_diff / 2.0) / sd_diff * (' + qnorm_sql('1.0 / award_value + 0.5') + ' + 0.0)'), 'p_sup_threshold')} "
    "FROM (SELECT DISTINCT sd_diff, award_value FROM trials)", "trials"))
def i3(spark, sf):
    cells = trials(spark, sf).select("sd_diff", "award_value").distinct()
    return cells.select("sd_diff", U.p_sup_threshold().alias("p_sup_threshold"))


FR_SI = ("CASE WHEN ground_truth > 0.5 THEN (p_award_without + 1.0/award_value) < p_award_with "
         "ELSE ((1.0 - p_award_without) - 1.0/award_value) > (1.0 - p_award_with) END")
EXP_PAY = ("CASE WHEN ground_truth > 0.5 THEN CASE WHEN {si} THEN p_award_with * award_value - 1 ELSE p_award_without * award_value END "
           "ELSE CASE WHEN {si} THEN (1.0 - p_award_with) * (-award_value) - 1 ELSE (1.0 - p_award_without) * (-award_value) END END")


def _framed_payoff(spark, sf):
    f = B.framed(trials(spark, sf)).withColumns({"frame": B.frame(), "should_intervene": B.should_intervene_framed()})
    return f.withColumn("expected_payoff", U.expected_payoff())


@query("I4_expected_payoff", with_ctes(
    f"SELECT event_id, {r6(EXP_PAY.format(si=FR_SI), 'expected_payoff')} FROM framed", "framed"))
def i4(spark, sf):
    return _framed_payoff(spark, sf).select("event_id", "expected_payoff")


@query("I5_starting_value", with_ctes(
    f"SELECT DISTINCT worker_id, {r6('n_trials + n_trials / 2 * award_value', 'starting_value')} FROM trials", "trials"))
def i5(spark, sf):
    return trials(spark, sf).select("worker_id", U.starting_value().alias("starting_value")).distinct()


@query("D29_payoff_table", with_ctes(
    "SELECT worker_id, " + ", ".join([
        r6("s + sum(ep)", "expected_value"), r6("s + max(n_trials) / 2 * max(award_value)", "max_value"),
        r6("round_even(2.5 / (s + sum(ep)), 5)", "exchange_rate"),
        "round_even((s + sum(ep)) * round_even(2.5 / (s + sum(ep)), 5), 4) AS expected_bonus",
        "round_even((s + max(n_trials) / 2 * max(award_value)) * round_even(2.5 / (s + sum(ep)), 5), 4) AS max_bonus"])
    + f" FROM (SELECT worker_id, n_trials, award_value, n_trials + n_trials / 2 * award_value AS s, "
    f"{EXP_PAY.format(si=FR_SI)} AS ep FROM framed) GROUP BY worker_id, s", "framed"))
def d29(spark, sf):
    return D.payoff_table(_framed_payoff(spark, sf), "worker_id", n=F.max("n_trials"))


def _tax_sql(x: str) -> str:
    caps = [f"least({x}, {float(t)})" for t in U.TAX_TIERS] + [x]
    terms = [f"{caps[0]} * {1 - U.TAX_RATES[0]!r}"]
    terms += [f"({caps[i]} - {caps[i - 1]}) * {1 - U.TAX_RATES[i]!r}" for i in range(1, len(caps))]
    return "(" + " + ".join(terms) + ")"


@query("I6_tax_winnings", with_ctes(
    f"SELECT event_id, {r6(_tax_sql('p_superiority * 30.0'), 'taxed')} FROM trials", "trials"))
def i6(spark, sf):
    """Winnings of 30 x the answer, taxed by brackets."""
    return trials(spark, sf).select("event_id", U.tax_winnings(F.col("p_superiority") * 30.0).alias("taxed"))


@query("I7_optimal_bet", with_ctes(
    "SELECT p_superiority, bet AS optimal_bet FROM (SELECT p_superiority, bet, row_number() OVER (PARTITION BY p_superiority "
    "ORDER BY u DESC, bet) AS rn FROM (SELECT p_superiority, bet, round_even(0.75 * (1000.0 - bet) + pp * "
    + _tax_sql("bet / pp") + ", 9) AS u FROM (SELECT p_superiority, CASE WHEN p_superiority = 0 THEN 0.001 ELSE p_superiority END AS pp "
    "FROM (SELECT DISTINCT round_even(p_superiority / 100.0, 6) AS p_superiority FROM trials)), (SELECT unnest(range(1, 1001)) AS bet))) "
    "WHERE rn = 1", "trials"))
def i7(spark, sf):
    p = trials(spark, sf).select(F.bround(F.col("p_superiority") / 100.0, 6).alias("p_superiority")).distinct()
    return U.optimal_bet(p, "p_superiority").withColumn("optimal_bet", F.col("optimal_bet").cast("long"))


QD = ("list_transform(range(1, 21), lambda i: mean_diff + sd_diff * " + qnorm_sql("(i - 0.5) / 20.0") + ")")
HEUR_SQL = (
    "SELECT ground_truth, sd_diff, heuristic, est_cles FROM (SELECT ground_truth, sd_diff, "
    "ground_truth * 100 AS ground_truth_est, 50 - 50 * mean_diff / max(abs(mean_diff)) OVER () AS rel_mean_diff_est, "
    "50 - 50 * mean_diff / 24.0 AS mean_diff_vs_axis_est, "
    f"50.0 - 50.0 * mean_diff / ({2 * 1.959963984540054!r} * sd) / 2.0 AS means_first_then_uncertainty_intervals_est, "
    f"CASE WHEN -mean_diff / 2 > mean_diff / 2 THEN 100 - 50 * ((mean_diff / 2 + L / 2) - (-mean_diff / 2 - L / 2)) / L "
    "ELSE 50 * ((-mean_diff / 2 + L / 2) - (mean_diff / 2 - L / 2)) / L END AS interval_overlap_est, "
    "CASE WHEN -mean_diff / 2 > mean_diff / 2 THEN 100 - 50 * ((mean_diff / 2 + L / 2) - (-mean_diff / 2 - L / 2)) / 24.0 "
    "ELSE 50 * ((-mean_diff / 2 + L / 2) - (mean_diff / 2 - L / 2)) / 24.0 END AS interval_overlap_vs_axis_est, "
    "100.0 * len(list_filter(dd, lambda x: x < 0)) / len(dd) AS outcome_proportion_est, "
    "100.0 * len(list_filter(dd[1:10], lambda x: x < 0)) / len(dd[1:10]) AS outcome_proportion_10_est, "
    "50 - 50 * (list_sum(dd) / len(dd)) / sqrt((list_max(dd) - list_min(dd)) * (list_max(dd) - list_min(dd)) / 2) / 2 "
    "AS means_first_then_uncertainty_hops_est FROM (SELECT *, " + QD + " AS dd, "
    f"{2 * 1.959963984540054!r} * sd AS L FROM ({STIM_SQL}) WHERE Team = 'With the New Player')) "
    "UNPIVOT (est_cles FOR heuristic IN (" + ", ".join(U.HEURISTICS) + "))")


@query("I13_heuristic_table", with_ctes(
    f"SELECT {rnd('ground_truth')}, sd_diff, heuristic, {rnd('est_cles')} FROM ({HEUR_SQL})", "trials"))
def i13(spark, sf):
    return U.heuristic_table(_stimuli(spark, sf), ["ground_truth", "sd_diff"])


@query("I14_heuristic_errors", with_ctes(
    f"SELECT h.heuristic, t.condition, {r6('avg(abs(h.est_cles - t.p_superiority))', 'mean_abs_error')}, "
    f"{r6('avg(h.est_cles - t.p_superiority)', 'mean_error')} FROM ({HEUR_SQL}) h JOIN trials t "
    "ON round_even(h.ground_truth * 1000, 0) = round_even(t.ground_truth * 1000, 0) AND h.sd_diff = t.sd_diff "
    "GROUP BY h.heuristic, t.condition", "trials"))
def i14(spark, sf):
    h = U.heuristic_table(_stimuli(spark, sf), ["ground_truth", "sd_diff"])
    t = trials(spark, sf).select("condition", "ground_truth", "sd_diff", "p_superiority")
    j = C.join_rounded(h.withColumnRenamed("ground_truth", "gt_h"), t, "gt_h", "ground_truth", how="inner", extra=["sd_diff"])
    j = j.withColumn("_e", F.col("est_cles") - F.col("p_superiority"))
    return j.groupBy("heuristic", "condition").agg(F.avg(F.abs("_e")).alias("mean_abs_error"), F.avg("_e").alias("mean_error"))


def _replay_design(spark, sf):
    f = B.framed(trials(spark, sf)).withColumns({"frame": B.frame(), "should_intervene": B.should_intervene_framed()})
    cells = f.select("ground_truth", "sd_diff", "frame", "should_intervene", "p_award_with", "p_award_without",
                     "award_value").distinct()
    cells = cells.withColumn("row_id", C.scaled_key("ground_truth") * 100 + F.col("sd_diff"))
    n = cells.agg(F.count(F.lit(1)).cast("double")).scalar()
    return cells.withColumn("starting_value", n + n / 2 * F.col("award_value"))


PAY_SQL = ("CASE WHEN frame = 'gain' THEN CASE WHEN {won} THEN award_value - CAST({c} AS DOUBLE) ELSE -CAST({c} AS DOUBLE) END "
           "ELSE CASE WHEN {won} THEN -CAST({c} AS DOUBLE) ELSE -award_value - CAST({c} AS DOUBLE) END END")


@query("I15_replay_payoffs", with_ctes(
    "SELECT iter, " + r6("avg(sv) + sum(" + PAY_SQL.format(won="rw", c="g") + ")", "random_value") + ", "
    "CAST(sum(CAST(g = si AS INT)) AS BIGINT) AS random_correct, "
    + r6("avg(sv) + sum(" + PAY_SQL.format(won="ow", c="si") + ")", "optimal_value") + ", count(*) AS optimal_correct FROM ("
    f"SELECT *, {u_sql('row_id', 'iter', seed=12)} <= CASE WHEN g THEN p_award_with ELSE p_award_without END AS rw, "
    f"{u_sql('row_id', 'iter', seed=13)} <= CASE WHEN si THEN p_award_with ELSE p_award_without END AS ow FROM ("
    f"SELECT *, {u_sql('row_id', 'iter', seed=11)} < 0.5 AS g FROM (SELECT *, n + n / 2 * award_value AS sv FROM ("
    "SELECT *, CAST(count(*) OVER () AS DOUBLE) AS n, CAST(round_even(ground_truth * 1000, 0) AS BIGINT) * 100 + sd_diff AS row_id "
    "FROM (SELECT DISTINCT ground_truth, sd_diff, CASE WHEN ground_truth > 0.5 THEN 'gain' ELSE 'loss' END AS frame, "
    f"{FR_SI} AS si, p_award_with, p_award_without, award_value FROM framed)), (SELECT unnest(range(1, 501)) AS iter)))) "
    "GROUP BY iter", "framed"))
def i15(spark, sf):
    return U.replay_payoffs(_replay_design(spark, sf), 500, seed=11)


@query("I16_design_table")
def i16(spark, sf):
    """Design from the truth levels seen in the data: sd copies, removals, parameters, names, distinct."""
    t = trials(spark, sf)
    levels = t.filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)).select("ground_truth")
    remove = t.filter((F.col("sd_diff") == 15) & (F.col("ground_truth") > 0.8)).select("ground_truth", "sd_diff")
    return U.design_table(levels, remove=remove)


@query("I17_shuffle_index", with_ctes(
    "SELECT cell, Team, CAST(i AS INT) AS i, CAST(row_number() OVER (PARTITION BY cell, Team ORDER BY u, i) AS INT) AS draw_idx FROM "
    f"(SELECT cell, Team, i, {u_sql('cell', 'Team', 'i', seed=5)} AS u FROM (SELECT DISTINCT "
    "CAST(sd_diff AS VARCHAR) || '_' || CAST(CAST(round_even(ground_truth * 1000, 0) AS BIGINT) AS VARCHAR) AS cell, "
    "unnest(['With the New Player', 'Without the New Player']) AS Team FROM trials), (SELECT unnest(range(1, 21)) AS i))", "trials"))
def i17(spark, sf):
    t = trials(spark, sf).select(F.concat_ws("_", F.col("sd_diff").cast("string"),
                                             C.scaled_key("ground_truth").cast("string")).alias("cell"))
    t = C.expand_values(t.distinct(), "Team", U.TEAMS)
    out = U.shuffle_index(t, ["cell", "Team"], 20, seed=5)
    return out.withColumns({"i": F.col("i").cast("int"), "draw_idx": F.col("draw_idx").cast("int")})


# F -------------------------------------------------------------------------
@query("F1_qlogis", with_ctes(f"SELECT event_id, {r6('ln((p_superiority/100.0)/(1.0-(p_superiority/100.0)))', 'lo_p_sup')} FROM trials",
                              "trials"))
def f1(spark, sf):
    return trials(spark, sf).select("event_id", qlogis(F.col("p_superiority") / 100.0).alias("lo_p_sup"))


@query("F2_plogis", with_ctes(
    f"SELECT event_id, {r6('1.0/(exp(-ln(ground_truth/(1.0-ground_truth)))+1.0)', 'p')} FROM trials", "trials"))
def f2(spark, sf):
    return trials(spark, sf).select("event_id", plogis(qlogis("ground_truth")).alias("p"))


@query("F3_pnorm", with_ctes(f"SELECT event_id, {r6(pnorm_sql('(p_superiority - 50.0) / 15.0'), 'p')} FROM trials", "trials"))
def f3(spark, sf):
    t = trials(spark, sf).withColumn("_z", (F.col("p_superiority") - 50.0) / 15.0)
    return t.select("event_id", pnorm("_z").alias("p"))


@query("F4_qnorm", with_ctes(f"SELECT event_id, {r6(qnorm_sql('ground_truth'), 'z')} FROM trials", "trials"))
def f4(spark, sf):
    return trials(spark, sf).select("event_id", qnorm("ground_truth").alias("z"))


@query("F5_norm_logpdf", with_ctes(
    f"SELECT event_id, {r6('-0.5 * ((lo_p_sup - lo_ground_truth) / 0.5) * ((lo_p_sup - lo_ground_truth) / 0.5) - ln(0.5) - 0.9189385332046727', 'll')} "
    "FROM model", "model"))
def f5(spark, sf):
    return model(spark, sf).select("event_id", norm_logpdf("lo_p_sup", "lo_ground_truth", 0.5).alias("ll"))


@query("F6_bern_logpmf", with_ctes(
    f"SELECT event_id, {r6('intervene * lo_ground_truth - (greatest(lo_ground_truth, 0.0) + ln(1 + exp(-abs(lo_ground_truth))))', 'll')} "
    "FROM model", "model"))
def f6(spark, sf):
    return model(spark, sf).select("event_id", bern_logit_logpmf("intervene", "lo_ground_truth").alias("ll"))


def _emb(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


EMB = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("F7_softmax", with_ctes(
    "SELECT vec_id, list_transform(list_transform(e, lambda x: exp(x - list_max(e))), lambda y: round_even(y / list_sum(list_transform(e, "
    f"lambda x: exp(x - list_max(e)))), 6)) AS p FROM {EMB}"))
def f7(spark, sf):
    return _emb(spark, sf).select("vec_id", FA.round_array(FA.softmax("e")).alias("p"))


@query("F8_logsumexp", with_ctes(
    f"SELECT vec_id, {r6('list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e)))))', 'lse')} FROM {EMB}"))
def f8(spark, sf):
    return _emb(spark, sf).select("vec_id", FA.logsumexp("e").alias("lse"))


@query("F9_logit_grid", with_ctes(
    "SELECT sd_diff, list_transform(range(0, 11), lambda i: round_even(1.0 / (exp(-(CASE WHEN i = 10 THEN ln(hi/(1.0-hi)) "
    "ELSE ln(lo/(1.0-lo)) + i * (ln(hi/(1.0-hi)) - ln(lo/(1.0-lo))) / 10 END)) + 1.0), 6)) AS levels FROM "
    "(SELECT sd_diff, min(ground_truth) AS lo, max(ground_truth) AS hi FROM trials WHERE ground_truth > 0.5 AND ground_truth < 0.999 "
    "GROUP BY sd_diff)", "trials"))
def f9(spark, sf):
    """11 truth levels equally spaced in log odds over the observed range, per sd level."""
    r = B.drop_checks(trials(spark, sf)).groupBy("sd_diff").agg(F.min("ground_truth").alias("lo"),
                                                                 F.max("ground_truth").alias("hi"))
    return r.select("sd_diff", FA.round_array(FA.logit_grid("lo", "hi", 11)).alias("levels"))


@query("F10_ppoints", with_ctes(
    "SELECT worker_id, list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: round_even((i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) "
    "/ (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END), 6)) AS pp FROM (SELECT worker_id, count(DISTINCT ground_truth) AS n "
    "FROM trials GROUP BY worker_id)", "trials"))
def f10(spark, sf):
    n = trials(spark, sf).groupBy("worker_id").agg(F.countDistinct("ground_truth").cast("int").alias("n"))
    return n.select("worker_id", FA.round_array(FA.ppoints(F.col("n"))).alias("pp"))


@query("F11_quantile_draws", with_ctes(
    "SELECT ground_truth, sd_diff, list_transform(" + QD + ", lambda x: round_even(x, 6)) AS draws_diff FROM "
    f"(SELECT ground_truth, sd_diff, sd_diff * {qnorm_sql('ground_truth')} AS mean_diff FROM ({CELLS_SQL}))", "trials"))
def f11(spark, sf):
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct().withColumn("mean_diff", F.col("sd_diff") * qnorm("ground_truth"))
    return cells.select(F.bround("ground_truth", 6).alias("ground_truth"), "sd_diff",
                        FA.round_array(U.quantile_dots("mean_diff", "sd_diff", 20)).alias("draws_diff"))


@query("F12_normal_interval", with_ctes(
    f"SELECT ground_truth, sd_diff, Team, {r6('mean - sd * 1.959963984540054', 'lower')}, {r6('mean + sd * 1.959963984540054', 'upper')} "
    f"FROM ({STIM_SQL})", "trials").replace("SELECT ground_truth, sd_diff, Team, round_even(mean",
                                            "SELECT round_even(ground_truth, 6) AS ground_truth, sd_diff, Team, round_even(mean", 1))
def f12(spark, sf):
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct()
    s = U.stimulus_params(cells)
    lo, hi = normal_interval("mean", "sd")
    return s.select("ground_truth", "sd_diff", "Team", lo.alias("lower"), hi.alias("upper"))


@query("F13_arr_stats", with_ctes(
    "SELECT vec_id, list_transform(e[1:5], lambda x: round_even(x, 6)) AS first5, len(list_filter(e, lambda x: x < 0)) AS n_below, "
    f"{r6('list_sum(e) / len(e)', 'mean')}, {r6('list_max(e) - list_min(e)', 'range')} FROM {EMB}"))
def f13(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", FA.round_array(FA.arr_first("e", 5)).alias("first5"), FA.arr_count_below("e").alias("n_below"),
                    FA.arr_mean("e").alias("mean"), FA.arr_range("e").alias("range"))


@query("F14_arr_diff", with_ctes(
    "SELECT a.vec_id, list_transform(list_zip(b.e, a.e), lambda z: z[1] - z[2]) AS diff FROM "
    f"{EMB} a JOIN {EMB} b ON b.vec_id = a.vec_id + 1"))
def f14(spark, sf):
    """Draw-wise difference of consecutive vectors (team B minus team A), unrounded: exact in double."""
    a = _emb(spark, sf)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("eb"))
    return a.join(b, "vec_id").select("vec_id", FA.arr_diff("eb", "e").alias("diff"))


@query("F15_builtins", with_ctes(
    "SELECT event_id, " + ", ".join([r6("abs(ground_truth * 100 - p_superiority)", "abs_err"), r6("sqrt(p_superiority)", "sqrt_p"),
                                     r6("exp(ground_truth)", "exp_gt"), r6("ln(p_superiority)", "ln_p"),
                                     r6("round_even(p_superiority / 3.0, 1)", "round_p"), r6("least(p_superiority, 60.0)", "pmin_p"),
                                     r6("greatest(p_superiority, 60.0)", "pmax_p")]) + " FROM trials", "trials"))
def f15(spark, sf):
    p = F.col("p_superiority")
    return trials(spark, sf).select("event_id", F.abs(F.col("ground_truth") * 100 - p).alias("abs_err"), F.sqrt(p).alias("sqrt_p"),
                                    F.exp("ground_truth").alias("exp_gt"), F.ln(p).alias("ln_p"),
                                    F.bround(p / 3.0, 1).alias("round_p"), F.least(p, F.lit(60.0)).alias("pmin_p"),
                                    F.greatest(p, F.lit(60.0)).alias("pmax_p"))


@query("F16_casts", with_ctes(
    "SELECT event_id, TRY_CAST(trial_idx AS INTEGER) AS trial_num, CAST(start_means AS INTEGER) AS start_means_num FROM responses",
    "responses"))
def f16(spark, sf):
    r = X.responses(spark, sf)
    return r.select("event_id", F.col("trial_idx").try_cast("int").alias("trial_num"),
                    F.col("start_means").cast("int").alias("start_means_num"))


@query("F17_strings", with_ctes(
    "SELECT doc_id, lower(lang) || '_' || source AS tag, contains(lower(text), 'thing') AS has_thing, "
    "regexp_extract(text, '^([A-Za-z]+)', 1) AS first_word FROM documents"))
def f17(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("_", F.lower("lang"), "source").alias("tag"),
                    B.has_code("text", "thing").alias("has_thing"),
                    F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("first_word"))


@query("F18_est_in_bounds", with_ctes(
    f"SELECT event_id, {r6('least(0.9975, greatest(0.0025, p_superiority / 100.0))', 'p')} FROM trials", "trials"))
def f18(spark, sf):
    return trials(spark, sf).select("event_id", FA.est_in_bounds(F.col("p_superiority") / 100.0).alias("p"))
