"""Queries for the draws analytics (G).

Stand-in model: the coefficient draws come from ``embeddings`` (draw = vec_id,
chain = label, term = array position).  Terms 0-31 are the estimation (LLO) model in
cell-means form (cell = condition x sd_diff x means; intercept 2c, slope 2c+1 on
log-odds truth), terms 32-63 the decision model (slope on evidence).  Grids come from
the modelling table built on ``events``.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from trialscope.functions.normal import norm_logpdf, plogis, qnorm_sql
from trialscope.operators import clean as B
from trialscope.operators import draws as G
from trialscope.operators import joins as C
from trialscope.operators import reshape as E
from trialscope.plans.registry import query
from trialscope.plans.sqltext import CELL, md5_normal_sql, with_ctes
from trialscope.session import cut_lineage
from trialscope.sources import fixtures as X

LV = X.CONDITIONS
GRID = ["condition", "sd_diff", "means"]


def rnd(cols: str) -> str:
    return ", ".join(f"round_even({c}, 6) AS {c}" for c in cols.split())


def r6(expr: str, name: str) -> str:
    return f"round_even({expr}, 6) AS {name}"


def model(spark, sf):
    return B.model_table(X.responses(spark, sf))


def draws(spark, sf):
    return X.draws_wide(spark, sf)


def cell():
    return G.cell_index(levels=LV)


def fitted_llo(spark, sf, m=None, d=None):
    m = m if m is not None else model(spark, sf)
    grid = C.group_grid(m, GRID, {"lo_ground_truth": [0.0, 1.0]})
    return G.fitted_draws(grid, d if d is not None else draws(spark, sf), G.llo_design(cell(), F.col("lo_ground_truth")))


def fitted_dec(spark, sf):
    grid = C.group_grid(model(spark, sf), GRID, {"evidence": [0.0, 1.0]})
    return G.fitted_draws(grid, draws(spark, sf), G.llo_design(cell(), F.col("evidence"), offset=32))


def psy_dec(spark, sf):
    return G.psychometric(G.slopes_intercepts(fitted_dec(spark, sf), GRID, "evidence"))


def trial_predictions(spark, sf, n_draws: int | None = None):
    """Per modelled trial and draw (all draws, or ``n_draws`` of them): mean, predicted answer and log likelihood."""
    coefs = coefficients(spark, sf, n_draws)
    return unfold(G.spread(modelled(spark, sf), coefs, "event_id"), coefs)


def patterns(trials, coefs):
    """Distinct observations of ``trials`` with their log likelihood under every draw, and the pattern of each event."""
    rows, of = G.observations(trials, "event_id", [*GRID, "lo_ground_truth", "lo_p_sup"])
    fit = G.fitted_by_cell(G.spread(rows, coefs, "pattern"), coefs, cell(), "lo_ground_truth", value="mu", parts=True)
    return fit.withColumn("ll", norm_logpdf("lo_p_sup", "mu", 1.0)), of


def modelled(spark, sf):
    return model(spark, sf).select("event_id", "condition", "sd_diff", "means", "lo_ground_truth", "lo_p_sup")


def coefficients(spark, sf, n_draws: int | None = None):
    d = draws(spark, sf) if n_draws is None else G.take_draws(draws(spark, sf), n_draws)
    return G.chunked(G.cell_coefficients(d))


def unfold(trials, coefs, packed: bool = False):
    """Every trial's mean, predicted answer and log likelihood under every draw; other columns stay. ``packed``: as ``Blocks``."""
    fit = G.fitted_by_cell(trials, coefs, cell(), "lo_ground_truth", value="mu", packed=packed)
    pred = G.predicted_draws(fit if packed else fit.drop(*GRID, "lo_ground_truth"), ["event_id"], 1.0, seed=1234, value="mu")
    if packed:
        return pred.add(lambda p: p.put("ll", norm_logpdf(p["lo_p_sup"], p["mu"], 1.0), p.null("lo_p_sup", "mu")))
    return pred.withColumn("ll", norm_logpdf("lo_p_sup", "mu", 1.0))


@query("G1_fitted_draws", with_ctes(f"SELECT condition, sd_diff, means, lo_ground_truth, draw, {rnd('value')} FROM fitted_llo",
                                    "fitted_llo"))
def g1(spark, sf):
    return fitted_llo(spark, sf)


@query("G2_predicted_draws", with_ctes(
    f"SELECT condition, sd_diff, means, lo_ground_truth, draw, {r6('value + 1.0 * zn', 'prediction')} FROM "
    f"(SELECT *, {md5_normal_sql('ci', 'xi', 'draw')} AS zn FROM (SELECT *, {CELL} AS ci, CAST(lo_ground_truth AS INT) AS xi "
    "FROM fitted_llo))", "fitted_llo"))
def g2(spark, sf):
    f = fitted_llo(spark, sf).withColumns({"_cell": cell(), "_xi": F.col("lo_ground_truth").cast("int")})
    return G.predicted_draws(f, ["_cell", "_xi"], 1.0, seed=1234, noise=G.md5_normal).drop("_cell", "_xi", "value")


@query("G3_take_draws", with_ctes(f"SELECT draw, chain, term, {rnd('beta')} FROM draws100", "draws100"))
def g3(spark, sf):
    return G.take_draws(X.draws_long(spark, sf), 100, seed=1234)


@query("G5_compare_levels", with_ctes(
    "SELECT sd_diff, means, draw, b.condition || ' - ' || a.condition AS condition, round_even(b.value - a.value, 6) AS value "
    "FROM (SELECT *, CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' THEN 1 WHEN 'HOPs' THEN 2 ELSE 3 END AS ix "
    "FROM fitted_llo WHERE lo_ground_truth = 1.0) a JOIN (SELECT *, CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' "
    "THEN 1 WHEN 'HOPs' THEN 2 ELSE 3 END AS ix FROM fitted_llo WHERE lo_ground_truth = 1.0) b USING (sd_diff, means, draw) "
    "WHERE a.ix < b.ix", "fitted_llo"))
def g5(spark, sf):
    f = fitted_llo(spark, sf).filter(F.col("lo_ground_truth") == 1.0)
    return G.compare_levels(f, "value", "condition", LV, ["sd_diff", "means"])


@query("G6_slopes", with_ctes(
    "SELECT condition, sd_diff, means, draw, "
    f"{r6('max(value) FILTER (WHERE lo_ground_truth = 1.0) - max(value) FILTER (WHERE lo_ground_truth = 0.0)', 'slope')}, "
    f"{r6('max(value) FILTER (WHERE lo_ground_truth = 0.0)', 'intercept')} FROM fitted_llo GROUP BY ALL", "fitted_llo"))
def g6(spark, sf):
    return G.slopes_intercepts(fitted_llo(spark, sf), GRID, "lo_ground_truth")


@query("G7_psychometric", with_ctes(
    f"SELECT condition, sd_diff, means, draw, {rnd('slope intercept pse jnd')} FROM psy_dec", "psy_dec"))
def g7(spark, sf):
    return psy_dec(spark, sf)


AWARD = ("exp({x}) / ((1.0/(0.5 + 1.0/2.25) - 1.0) + exp({x})) - (0.5 + 1.0/2.25)")


@query("G8_to_award_scale", with_ctes(
    f"SELECT condition, sd_diff, means, draw, {r6(AWARD.format(x='pse'), 'pse_p_award')}, {r6(AWARD.format(x='jnd'), 'jnd_p_award')} "
    "FROM psy_dec", "psy_dec"))
def g8(spark, sf):
    # exactly one baseline and award value, checked inside one scalar subquery
    one = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).otherwise(F.raise_error(f"{c} is not unique"))
    scale = model(spark, sf).agg(F.struct(one("baseline").alias("b"), one("award_value").alias("k"))).scalar()
    p = psy_dec(spark, sf).withColumn("_scale", scale)
    c = F.col("_scale.b") + F.lit(1.0) / F.col("_scale.k")
    k = F.lit(1.0) / c - F.lit(1.0)
    out = p.withColumns({f"{x}_p_award": F.exp(F.col(x)) / (k + F.exp(F.col(x))) - c for x in ("pse", "jnd")})
    return out.select(*GRID, "draw", "pse_p_award", "jnd_p_award")


@query("G9_marginalise", with_ctes(
    f"SELECT condition, lo_ground_truth, draw, {r6('avg(value)', 'value')} FROM fitted_llo GROUP BY ALL", "fitted_llo"))
def g9(spark, sf):
    return G.marginalise(fitted_llo(spark, sf), ["condition", "lo_ground_truth"])


@query("G10_mean_qi", with_ctes(
    f"SELECT condition, lo_ground_truth, {r6('avg(value)', 'value')}, {r6('quantile_cont(value, 0.025)', 'lower')}, "
    f"{r6('quantile_cont(value, 0.975)', 'upper')}, 0.95::DOUBLE AS width FROM (SELECT condition, lo_ground_truth, draw, "
    "avg(value) AS value FROM fitted_llo GROUP BY ALL) GROUP BY ALL", "fitted_llo"))
def g10(spark, sf):
    return G.mean_qi(G.marginalise(fitted_llo(spark, sf), ["condition", "lo_ground_truth"]), ["condition", "lo_ground_truth"])


@query("G11_design_contrasts", with_ctes(
    "SELECT a.draw, b.cell || ' - ' || a.cell AS cell, round_even(b.value - a.value, 6) AS value FROM "
    "(SELECT condition || '_' || CASE WHEN means THEN 'true' ELSE 'false' END AS cell, "
    "(CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' THEN 1 WHEN 'HOPs' THEN 2 ELSE 3 END)*2 + CAST(means AS INT) AS ix, "
    "draw, avg(value) AS value FROM fitted_llo WHERE lo_ground_truth = 1.0 GROUP BY ALL) a JOIN "
    "(SELECT condition || '_' || CASE WHEN means THEN 'true' ELSE 'false' END AS cell, "
    "(CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' THEN 1 WHEN 'HOPs' THEN 2 ELSE 3 END)*2 + CAST(means AS INT) AS ix, "
    "draw, avg(value) AS value FROM fitted_llo WHERE lo_ground_truth = 1.0 GROUP BY ALL) b USING (draw) WHERE a.ix < b.ix",
    "fitted_llo"))
def g11(spark, sf):
    f = G.marginalise(fitted_llo(spark, sf).filter(F.col("lo_ground_truth") == 1.0), ["condition", "means"])
    f = E.unite(f, "cell", ["condition", "means"])
    cells = [f"{c}_{m}" for c in LV for m in ("false", "true")]
    return G.compare_levels(f, "value", "cell", cells, [])


@query("G12_predicted_error", with_ctes(
    "SELECT condition, sd_diff, 'true - false' AS means, " + r6("avg(d)", "value") + ", " + r6("quantile_cont(d, 0.025)", "lower")
    + ", " + r6("quantile_cont(d, 0.975)", "upper") + ", 0.95::DOUBLE AS width FROM ("
    "SELECT condition, sd_diff, ti, draw, max(e) FILTER (WHERE means) - max(e) FILTER (WHERE NOT means) AS d FROM ("
    "SELECT *, CASE WHEN prediction >= 0 THEN 1.0/(exp(-prediction)+1.0) ELSE exp(prediction)/(exp(prediction)+1.0) END "
    "- 1.0/(1.0+exp(-lo_ground_truth)) AS e FROM ("
    "SELECT g.*, a.draw, a.beta + g.lo_ground_truth * b.beta + " + md5_normal_sql("g.ci", "g.ti", "a.draw", seed=99) + " AS prediction FROM ("
    f"SELECT *, {CELL} AS ci, 2*{CELL} AS term FROM (SELECT DISTINCT lo_ground_truth, "
    "CAST(round_even(1000/(1.0+exp(-lo_ground_truth)), 0) AS INT) AS ti FROM model), "
    f"(SELECT unnest({LV}) AS condition), (SELECT unnest([5, 15]) AS sd_diff), (SELECT unnest([true, false]) AS means)) g "
    "JOIN draws a ON a.term = g.term JOIN draws b ON b.term = g.term + 1 AND b.draw = a.draw)) GROUP BY ALL) "
    "GROUP BY condition, sd_diff", "model", "draws"))
def g12(spark, sf):
    """Signed error of predicted answers over the full grid; means vs no means contrasted per grid row and draw;
    mean and interval by condition and sd. The model has no trial or start_means terms, so the grid leaves them out."""
    grid = model(spark, sf).select("lo_ground_truth").distinct()
    for name, levels in (("condition", LV), ("sd_diff", [5, 15]), ("means", [False, True])):
        grid = C.expand_values(grid, name, levels)
    grid = grid.withColumns({"ti": C.scaled_key(plogis("lo_ground_truth")).cast("int"), "_cell": cell()})
    fit = G.fitted_draws(grid, draws(spark, sf), G.llo_design(F.col("_cell"), F.col("lo_ground_truth")))
    pred = G.predicted_draws(fit, ["_cell", "ti"], 1.0, seed=99, noise=G.md5_normal)
    err = pred.withColumn("e", plogis("prediction") - plogis("lo_ground_truth"))
    con = G.compare_levels(err, "e", "means", [False, True], ["condition", "sd_diff", "ti"])
    con = con.withColumn("means", F.lit("true - false"))
    return G.mean_qi(con, ["means", "condition", "sd_diff"], "e").withColumnRenamed("e", "value")


@query("G13_mean_prediction", with_ctes(
    f"SELECT condition, means, {rnd('lo_ground_truth')}, "
    f"{r6('avg(CASE WHEN value >= 0 THEN 1.0/(exp(-value)+1.0) ELSE exp(value)/(exp(value)+1.0) END)', 'mean_p')} "
    "FROM fitted_llo GROUP BY ALL", "fitted_llo"))
def g13(spark, sf):
    f = fitted_llo(spark, sf)
    return f.groupBy("condition", "means", "lo_ground_truth").agg(F.avg(plogis("value")).alias("mean_p"))


@query("G15_side_by_side", with_ctes(
    f"SELECT a.condition, {r6('a.pse', 'pse')}, {r6('b.pse_p_award', 'pse_p_award')} FROM "
    "(SELECT condition, avg(pse) AS pse FROM psy_dec GROUP BY condition) a FULL JOIN "
    f"(SELECT condition, avg({AWARD.format(x='pse')}) AS pse_p_award FROM psy_dec GROUP BY condition) b USING (condition)",
    "psy_dec"))
def g15(spark, sf):
    p = G.to_award_scale(psy_dec(spark, sf), 0.5, 2.25, cols=("pse",))
    return p.groupBy("condition").agg(F.avg("pse").alias("pse"), F.avg("pse_p_award").alias("pse_p_award"))


def _weights(spark):
    """Slope of each condition averaged over its four cells (a rule, not a list)."""
    rows = [(f"slope_{c}", 2 * (ci * 4 + k) + 1, 0.25) for ci, c in enumerate(LV) for k in range(4)]
    return spark.createDataFrame(rows, "name string, term int, weight double")


@query("G16_term_combinations", with_ctes(
    "SELECT draw, 'slope_' || CASE term // 8 WHEN 0 THEN 'densities' WHEN 1 THEN 'intervals' WHEN 2 THEN 'HOPs' ELSE 'QDPs' END "
    "AS name, round_even(sum(0.25 * beta), 6) AS value FROM draws WHERE term < 32 AND term % 2 = 1 GROUP BY ALL", "draws"))
def g16(spark, sf):
    return G.term_combinations(X.draws_long(spark, sf), _weights(spark))


@query("G17_pit_residuals", with_ctes(
    f"SELECT event_id, {r6('pit', 'pit')}, {r6(qnorm_sql('least(greatest(pit, 1e-6), 1 - 1e-6)'), 'z')} FROM "
    "(SELECT event_id, avg(CAST(prediction < lo_p_sup AS DOUBLE)) AS pit FROM pit_trials_y GROUP BY event_id)", "pit_trials_y"))
def g17(spark, sf):
    """The residual check takes 500 predicted draws a row, as its contract says."""
    return G.pit_residuals(trial_predictions(spark, sf, n_draws=500), ["event_id"], "lo_p_sup")


@query("G18_waic", with_ctes(
    f"SELECT {r6('sum(lppd)', 'lppd')}, {r6('sum(p_waic)', 'p_waic')}, {r6('sum(lppd) - sum(p_waic)', 'elpd_waic')}, "
    f"{r6('-2.0 * (sum(lppd) - sum(p_waic))', 'waic')}, count(*) AS n_obs FROM (SELECT event_id, "
    "max(ll) + ln(sum(exp(ll - m))) - ln(count(*)) AS lppd, var_samp(ll) AS p_waic FROM "
    "(SELECT *, max(ll) OVER (PARTITION BY event_id) AS m FROM pred_trials_y) GROUP BY event_id)", "pred_trials_y"))
def g18(spark, sf):
    ll, of = patterns(modelled(spark, sf), coefficients(spark, sf))
    return G.waic(ll, ["pattern"], counts=of.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))


@query("G19_loo_pit", with_ctes(
    f"SELECT event_id, {r6('sum(CASE WHEN prediction <= lo_p_sup THEN w ELSE 0.0 END) / sum(w)', 'loo_pit')} FROM ("
    "SELECT *, least(r, sqrt(count(*) OVER e) * avg(r) OVER e) AS w FROM (SELECT *, exp(-ll - max(-ll) OVER (PARTITION BY event_id)) AS r "
    "FROM pred_trials_y) WINDOW e AS (PARTITION BY event_id)) GROUP BY event_id", "pred_trials_y"))
def g19(spark, sf):
    """Importance weights need their mean before they are truncated: distinct observations give it, then trials unfold into draws."""
    m, coefs = cut_lineage(modelled(spark, sf)), coefficients(spark, sf)
    ll, of = patterns(m, coefs)
    stats = of.join(G.loo_stats(ll, ["pattern"]), "pattern").drop("pattern")
    return G.loo_share(unfold(G.spread(m.join(stats, "event_id"), coefs, "event_id"), coefs, packed=True), ["event_id"], "lo_p_sup")


@query("G20_rhat", with_ctes(
    f"SELECT term, {r6('sqrt((((k - 1) / k) * w + bm) / w)', 'rhat')} FROM (SELECT term, avg(v) AS w, var_samp(m) AS bm, "
    "CAST(min(k) AS DOUBLE) AS k FROM (SELECT term, chain, half, avg(beta) AS m, var_samp(beta) AS v, count(*) AS k FROM "
    "(SELECT *, CAST(i > n / 2 AS INT) AS half FROM (SELECT *, row_number() OVER (PARTITION BY term, chain ORDER BY draw) AS i, "
    "count(*) OVER (PARTITION BY term, chain) AS n FROM draws) WHERE NOT (n % 2 = 1 AND i = (n + 1) / 2)) "
    "GROUP BY term, chain, half) GROUP BY term)", "draws"))
def g20(spark, sf):
    return G.rhat(X.draws_long(spark, sf))


@query("G21_tally_predictions", with_ctes(
    "SELECT draw, CASE WHEN 1000*p < 334 THEN 1 WHEN 1000*p < 667 THEN 2 ELSE 3 END AS category, count(*) AS n FROM "
    "(SELECT draw, CASE WHEN prediction >= 0 THEN 1.0/(exp(-prediction)+1.0) ELSE exp(prediction)/(exp(prediction)+1.0) END AS p "
    "FROM tally_trials_y) GROUP BY ALL", "tally_trials_y"))
def g21(spark, sf):
    coefs = coefficients(spark, sf)
    fit = G.fitted_by_cell(G.spread(modelled(spark, sf), coefs, "event_id"), coefs, cell(), "lo_ground_truth", value="mu", packed=True)
    pred = G.predicted_draws(fit, ["event_id"], 1.0, seed=1234, value="mu", noise=G.md5_normal)
    return G.tally_predictions(pred, lambda p: B.ordinal_bet(plogis(p["prediction"]) * 1000))


@query("G22_fitted_interval", with_ctes(
    f"SELECT condition, {rnd('lo_ground_truth')}, {r6('avg(v)', 'value')}, {r6('quantile_cont(v, 0.025)', 'lower')}, "
    f"{r6('quantile_cont(v, 0.975)', 'upper')}, 0.95::DOUBLE AS width FROM (SELECT g.condition, g.lo_ground_truth, d.draw, "
    "sum(g.x * d.beta) AS v FROM (SELECT condition, lo_ground_truth, "
    "2*((CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' THEN 1 WHEN 'HOPs' THEN 2 ELSE 3 END)*4) AS term, 1.0::DOUBLE AS x "
    "FROM rg UNION ALL SELECT condition, lo_ground_truth, 2*((CASE condition WHEN 'densities' THEN 0 WHEN 'intervals' THEN 1 "
    "WHEN 'HOPs' THEN 2 ELSE 3 END)*4)+1, lo_ground_truth FROM rg) g JOIN draws d USING (term) GROUP BY ALL) GROUP BY ALL",
    "model", "draws").replace("\nSELECT condition, ", ",\nrg AS (SELECT condition, CASE WHEN i = 9 THEN hi ELSE lo + i * (hi - lo) / 9 "
                              "END AS lo_ground_truth FROM (SELECT condition, min(lo_ground_truth) AS lo, max(lo_ground_truth) AS hi "
                              "FROM model GROUP BY condition), (SELECT unnest(range(0, 10)) AS i))\nSELECT condition, ", 1))
def g22(spark, sf):
    """Fitted line with 95 % interval over each condition's observed truth range (sd 5, no means)."""
    grid = C.range_grid(model(spark, sf), ["condition"], "lo_ground_truth", 10)
    grid = grid.withColumns({"sd_diff": F.lit(5), "means": F.lit(False)})
    f = G.fitted_draws(grid, draws(spark, sf), G.llo_design(cell(), F.col("lo_ground_truth")))
    return G.mean_qi(f, ["condition", "lo_ground_truth"])
