"""Queries for the remaining inventory items: nested save/load, fit cache, draw-stat joins,
estimate joins, density tables, per-worker statistics and the single heuristics."""
from __future__ import annotations

from pyspark.sql import functions as F

from trialscope.functions import arrays as FA
from trialscope.functions.normal import qnorm, qnorm_sql
from trialscope.operators import aggregates as D
from trialscope.operators import clean as B
from trialscope.operators import draws as G
from trialscope.operators import joins as C
from trialscope.operators import models as H
from trialscope.operators import utility as U
from trialscope.plans.q_models import CELLS_SQL, HEUR_SQL, QD, _stimuli
from trialscope.plans.registry import query
from trialscope.plans.sqltext import normal_sql, with_ctes
from trialscope.sources import fixtures as X
from trialscope.sources import io as A


def r6(expr: str, name: str) -> str:
    return f"round_even({expr}, 6) AS {name}"


def trials(spark, sf):
    return B.clean_trials(X.responses(spark, sf))


def model(spark, sf):
    return B.model_table(X.responses(spark, sf))


@query("A3_save_load_conds", with_ctes(
    "SELECT round_even(ground_truth, 6) AS ground_truth, sd_diff, round_even(mean_diff, 6) AS mean_diff, "
    "list_transform(" + QD + ", lambda x: round_even(x, 6)) AS draws_diff FROM "
    f"(SELECT ground_truth, sd_diff, sd_diff * {qnorm_sql('ground_truth')} AS mean_diff FROM ({CELLS_SQL}))", "trials"))
def a3(spark, sf):
    """Stimulus table with a list column written as parquet and read back."""
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct().withColumn("mean_diff", F.col("sd_diff") * qnorm("ground_truth"))
    conds = cells.withColumn("draws_diff", U.quantile_dots("mean_diff", "sd_diff", 20))
    path = A.save_conds(conds, A.scratch_path(spark, "conds"))
    back = A.load_conds(spark, path)
    return back.withColumn("draws_diff", FA.round_array("draws_diff"))


@query("A5_persist_fit", with_ctes(
    f"SELECT condition, {r6('regr_slope(lo_p_sup, lo_ground_truth)', 'slope')}, "
    f"{r6('regr_intercept(lo_p_sup, lo_ground_truth)', 'intercept')}, {r6('regr_r2(lo_p_sup, lo_ground_truth)', 'r2')}, "
    "regr_count(lo_p_sup, lo_ground_truth) AS n FROM model GROUP BY condition", "model"))
def a5(spark, sf):
    """LLO fit per condition kept as parquet in the shared scratch area and reused from there."""
    fit = H.llo_fit(model(spark, sf), ["condition"])
    path = A.scratch_path(spark, "llo_fit")
    A.persist_fit(fit, path)
    return A.persist_fit(fit, path)  # reads the stored fit


@query("C2_join_draw_stats", with_ctes(
    f"SELECT s.condition, s.sd_diff, s.means, s.draw, {r6('s.slope', 'slope')}, {r6('i.intercept', 'intercept')} FROM "
    "(SELECT condition, sd_diff, means, draw, max(value) FILTER (WHERE lo_ground_truth = 1.0) - max(value) FILTER "
    "(WHERE lo_ground_truth = 0.0) AS slope FROM fitted_llo GROUP BY ALL) s FULL JOIN (SELECT condition, sd_diff, means, "
    "draw, value AS intercept FROM fitted_llo WHERE lo_ground_truth = 0.0) i USING (condition, sd_diff, means, draw)",
    "fitted_llo"))
def c2(spark, sf):
    """Slopes (contrast of x = 1 vs 0) and intercepts (x = 0) computed apart, full-joined on keys + draw."""
    from trialscope.plans.q_draws import GRID, fitted_llo
    f = fitted_llo(spark, sf)
    slopes = G.compare_levels(f, "value", "lo_ground_truth", [0.0, 1.0], GRID, out="slope").drop("lo_ground_truth")
    inter = f.filter(F.col("lo_ground_truth") == 0.0).select(*GRID, "draw", F.col("value").alias("intercept"))
    return C.join_draw_stats(slopes, inter, [*GRID, "draw"])


@query("C7_join_estimates", with_ctes(
    f"SELECT m.event_id, {r6('m.lo_p_sup - (e.intercept + e.slope * m.lo_ground_truth)', 'residual')} FROM model m LEFT JOIN "
    "(SELECT worker_id, regr_slope(lo_p_sup, lo_ground_truth) AS slope, regr_intercept(lo_p_sup, lo_ground_truth) AS intercept "
    "FROM model GROUP BY worker_id) e USING (worker_id)", "model"))
def c7(spark, sf):
    """Per-worker LLO estimates joined back to the trials (left join on the worker), residuals."""
    m = model(spark, sf)
    est = H.llo_fit(m, ["worker_id"]).select("worker_id", "slope", "intercept")
    j = C.join_estimates(m.select("event_id", "worker_id", "lo_p_sup", "lo_ground_truth"), est, ["worker_id"])
    return j.select("event_id", (F.col("lo_p_sup") - (F.col("intercept") + F.col("slope") * F.col("lo_ground_truth")))
                    .alias("residual"))


@query("D25_density_grid", with_ctes(
    f"SELECT b.condition, x, {r6('sum(b.n * exp(-0.5 * ((x - c) / 5.0) * ((x - c) / 5.0)) / (5.0 * 2.5066282746310002::DOUBLE)) / max(t.tot)', 'density')} "
    "FROM (SELECT condition, floor((p_superiority - 0.0) / 0.5) * 0.5 + 0.0 + 0.25 AS c, count(*) AS n FROM trials "
    "WHERE p_superiority IS NOT NULL GROUP BY ALL) b JOIN (SELECT condition, count(p_superiority) AS tot FROM trials GROUP BY condition) t "
    "USING (condition), (SELECT 0.0 + i * 5.0 AS x FROM (SELECT unnest(range(0, 21)) AS i)) GROUP BY b.condition, x", "trials"))
def d25(spark, sf):
    """Gaussian density (bandwidth 5) of answers on a 21-point grid per condition, from 0.5-wide bins."""
    return D.density_grid(trials(spark, sf), "p_superiority", ["condition"], 0.0, 100.0, n=21, bin_width=0.5, bandwidth=5.0)


@query("G14_worker_stats")
def g14(spark, sf):
    """Per worker: LLO slope, decision slope / intercept, PSE and JND; full join; JND > 0 kept."""
    m = model(spark, sf)
    llo = H.llo_fit(m, ["worker_id"]).select("worker_id", F.col("slope").alias("llo_slope"))
    dec = H.logit_fit(B.evidence(m), ["worker_id"]).select("worker_id", F.col("slope").alias("dec_slope"),
                                                           F.col("intercept").alias("dec_intercept"), "pse", "jnd")
    return llo.join(dec, "worker_id", "full").filter(F.col("jnd") > 0)


def _single(names: list[str]):
    def fn(spark, sf):
        return U.heuristic_table(_stimuli(spark, sf), ["ground_truth", "sd_diff"], names)
    return fn


def _single_sql(names: list[str]) -> str:
    inlist = ", ".join(f"'{n}'" for n in names)
    return with_ctes(f"SELECT round_even(ground_truth, 6) AS ground_truth, sd_diff, heuristic, round_even(est_cles, 6) AS est_cles "
                     f"FROM ({HEUR_SQL}) WHERE heuristic IN ({inlist})", "trials")


for _name, _hs in {
    "I8_h_rel_mean_axis": ["rel_mean_diff_est", "mean_diff_vs_axis_est"],
    "I9_h_means_then_uncertainty": ["means_first_then_uncertainty_intervals_est", "means_first_then_uncertainty_hops_est"],
    "I10_h_overlap": ["interval_overlap_est", "interval_overlap_vs_axis_est"],
    "I11_h_outcome": ["outcome_proportion_est", "outcome_proportion_10_est"],
}.items():
    query(_name, _single_sql(_hs))(_single(_hs))


@query("I12_h_guess_one", with_ctes(
    f"SELECT round_even(ground_truth, 6) AS ground_truth, sd_diff, 99.75::DOUBLE AS est_cles FROM ({CELLS_SQL})", "trials"))
def i12(spark, sf):
    cells = trials(spark, sf).filter((F.col("ground_truth") > 0.5) & (F.col("ground_truth") < 0.999)) \
        .select("ground_truth", "sd_diff").distinct()
    return cells.withColumn("est_cles", U.h_guess_one())


@query("G4_worker_fitted_draws", with_ctes(
    "SELECT worker_id, draw, lo_ground_truth, round_even(CASE WHEN lo_ground_truth = 0.0 THEN a ELSE a + b END, 6) AS value FROM ("
    "SELECT worker_id, draw, (sy - ((sw * sxy - sx * sy) / (sw * sxx - sx * sx)) * sx) / sw AS a, "
    "(sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM (SELECT worker_id, draw, sum(w) AS sw, sum(w * x) AS sx, "
    "sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM (SELECT *, CAST(CASE "
    + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(H.POISSON1_CUTS)) +
    " ELSE 8 END AS DOUBLE) AS w FROM (SELECT worker_id, draw, lo_ground_truth AS x, lo_p_sup AS y, "
    + __import__("trialscope.plans.sqltext", fromlist=["u_sql"]).u_sql("event_id", "draw", seed=21) +
    " AS u FROM model, (SELECT unnest(range(0, 50)) AS draw))) WHERE w > 0 GROUP BY worker_id, draw)), "
    "(SELECT unnest([0.0, 1.0]) AS lo_ground_truth)", "model"))
def g4(spark, sf):
    """Fitted draws with worker effects (re = worker): per-worker bootstrap draws, fitted at truth 0 and 1."""
    wd = H.worker_draws(model(spark, sf), 50, seed=21)
    pts = F.array(F.struct(F.lit(0.0).alias("lo_ground_truth"), F.col("intercept").alias("value")),
                  F.struct(F.lit(1.0).alias("lo_ground_truth"), (F.col("intercept") + F.col("slope")).alias("value")))
    return wd.select("worker_id", "draw", F.explode(pts).alias("_p")).select(
        "worker_id", "draw", "_p.lo_ground_truth", "_p.value")


_EFFECTS = (
    "SELECT p.condition, p.worker_id, q.draw, q.a + (p.a - g.a) + sqrt(p.s2) * p.root * {z0} AS intercept, "
    "q.b + (p.b - g.b) + sqrt(p.s2) * (p.l10 * {z0} + sqrt(greatest(1 / p.sxx - p.l10 * p.l10, 0.0)) * {z1}) AS slope FROM ("
    "SELECT *, -mx / sxx / root AS l10 FROM (SELECT *, greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2) AS s2, sqrt(1 / n + mx * mx / sxx) AS root FROM ("
    "SELECT condition, worker_id, CAST(regr_count(lo_p_sup, lo_ground_truth) AS DOUBLE) AS n, regr_avgx(lo_p_sup, lo_ground_truth) AS mx, "
    "regr_slope(lo_p_sup, lo_ground_truth) AS b, regr_intercept(lo_p_sup, lo_ground_truth) AS a, regr_sxx(lo_p_sup, lo_ground_truth) AS sxx, "
    "regr_syy(lo_p_sup, lo_ground_truth) AS syy, regr_sxy(lo_p_sup, lo_ground_truth) AS sxy FROM model GROUP BY ALL) WHERE n >= 3 AND sxx > 0)) p "
    "JOIN (SELECT condition, regr_slope(lo_p_sup, lo_ground_truth) AS b, regr_intercept(lo_p_sup, lo_ground_truth) AS a FROM model GROUP BY ALL) g USING (condition) "
    "JOIN (SELECT CASE term // 8 WHEN 0 THEN 'densities' WHEN 1 THEN 'intervals' WHEN 2 THEN 'HOPs' ELSE 'QDPs' END AS condition, draw, "
    "avg(beta) FILTER (WHERE term % 2 = 0) AS a, avg(beta) FILTER (WHERE term % 2 = 1) AS b FROM draws100 WHERE term < 32 GROUP BY ALL) q USING (condition)"
).format(z0=normal_sql("p.worker_id", "q.draw", seed=31), z1=normal_sql("p.worker_id", "q.draw", seed=32))


@query("G4_worker_effect_draws", with_ctes(
    f"SELECT condition, worker_id, draw, lo_ground_truth, {r6('intercept + lo_ground_truth * slope', 'value')} FROM ({_EFFECTS}), "
    "(SELECT unnest([0.0, 1.0]) AS lo_ground_truth)", "model", "draws100"))
def g4_effects(spark, sf):
    """Fitted draws with worker effects: 100 of the population's draws plus workers' own lines, at truth 0 and 1."""
    coefs = G.cell_coefficients(G.take_draws(X.draws_wide(spark, sf), 100))
    name = F.element_at(F.array(*map(F.lit, X.CONDITIONS)), (F.floor(F.col("cell") / 4) + 1).cast("int"))
    population = coefs.groupBy(name.alias("condition"), "draw").agg(F.avg("b0").alias("intercept"), F.avg("b1").alias("slope"))
    lines = H.worker_effect_draws(model(spark, sf), population)
    at = F.array(*(F.struct(F.lit(v).alias("lo_ground_truth"), (F.col("intercept") + F.lit(v) * F.col("slope")).alias("value")) for v in (0.0, 1.0)))
    return lines.select("condition", "worker_id", "draw", F.explode(at).alias("_p")).select("condition", "worker_id", "draw", "_p.*")
