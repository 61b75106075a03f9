"""Model fits re-aimed as Spark jobs.

The reference fits Bayesian models by MCMC on one machine.  Here every estimator is
a sequence of aggregations: one pass of sufficient statistics per iteration, grouped
by whatever the model is fitted per (condition, worker, replicate).  Closed-form
2-parameter solves stay in Spark columns, so per-worker fits never leave the cluster;
only p x p sums of pooled fits reach the driver.  Draws come from a Poisson bootstrap
over workers (H9) and approximate, not reproduce, the reference's posteriors.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.functions.normal import qlogis
from trialscope.operators.fits import (ORDINAL_FORMS, censored_fit, glm2_fit, heuristic_shares, llo_hierarchical, logit_fit,  # noqa: F401
                                       mixture_fit, ordinal_fit, probit_fit)

# H1 ------------------------------------------------------------------------
def llo_fit(df: DataFrame, keys: Sequence[str], y: str = "lo_p_sup", x: str = "lo_ground_truth") -> DataFrame:
    """Linear in log odds per group: least-squares slope, intercept, R^2 and residual sd."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _ols2(sw, sx, sy, sxx, sxy):
    """Weighted 2-parameter least squares from sums, as Columns: (intercept, slope)."""
    det = sw * sxx - sx * sx
    slope = F.try_divide(sw * sxy - sx * sy, det)
    return F.try_divide(sy - slope * sx, sw), slope


# H2 ------------------------------------------------------------------------
def normal_equations(df: DataFrame, features: Sequence[Column], y: Column, weight: Column | None = None):
    """X'WX and X'Wy from one aggregate (p(p+1)/2 + p sums), returned as NumPy arrays."""
    p = len(features)
    w = weight if weight is not None else F.lit(1.0)
    aggs = [F.sum(w * features[i] * features[j]).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(w * features[i] * y).alias(f"xy_{i}") for i in range(p)]
    aggs += [F.sum(w).alias("sw")]
    row = df.agg(*aggs).first()
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = row[f"xx_{i}_{j}"] or 0.0
    xty = np.array([row[f"xy_{i}"] or 0.0 for i in range(p)])
    return xtx, xty, row["sw"]


def llo_pooled(df: DataFrame, features: dict[str, Column], y: str = "lo_p_sup",
               prior: dict[str, tuple[float, float]] | None = None, weight: Column | None = None) -> dict[str, float]:
    """Pooled linear model with interactions; a Normal(m, s) prior on a coefficient is a
    ridge penalty towards m (MAP with unit residual variance)."""
    names = list(features)
    xtx, xty, _ = normal_equations(df, [features[n] for n in names], F.col(y), weight)
    if prior:
        for i, n in enumerate(names):
            if n in prior:
                m, s = prior[n]
                xtx[i, i] += 1.0 / (s * s)
                xty[i] += m / (s * s)
    beta = np.linalg.solve(xtx, xty)
    return dict(zip(names, beta.tolist()))


def coefficients_df(spark, coefs: dict[str, float], **labels) -> DataFrame:
    rows = [(*labels.values(), k, float(v)) for k, v in coefs.items()]
    schema = ", ".join([f"{k} string" for k in labels] + ["term string", "estimate double"])
    return spark.createDataFrame(rows, schema)


def predict(df: DataFrame, features: dict[str, Column], coefs: dict[str, float], out: str = "fitted") -> DataFrame:
    expr = F.lit(0.0)
    for n, c in features.items():
        expr = expr + features[n] * F.lit(coefs[n])
    return df.withColumn(out, expr)


# H3 ------------------------------------------------------------------------
def llo_shrink(df: DataFrame, worker: str = "worker_id", y: str = "lo_p_sup", x: str = "lo_ground_truth",
               keys: Sequence[str] = ()) -> DataFrame:
    """Per-worker LLO slopes shrunk toward the population (empirical Bayes).

    Worker slope b_w with sampling variance v_w = s_w^2 / Sxx_w; between-worker variance
    tau^2 = max(0, var(b) - mean(v)) by moments; shrunk b = (tau^2 b_w + v_w mu) / (tau^2 + v_w).
    Workers need at least 3 distinct trials; all in two grouped passes.
    """
    per = df.groupBy(*keys, worker).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"))
    per = per.filter((F.col("n") >= 3) & (F.col("sxx") > 0))
    rss = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    per = per.withColumn("v", F.greatest(rss, F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    pop = per.groupBy(*keys).agg(F.avg("slope").alias("mu"),
                                 F.greatest(F.var_samp("slope") - F.avg("v"), F.lit(0.0)).alias("tau2"))
    if keys:
        j = per.join(pop, list(keys), "inner")
    else:  # population values as scalar subqueries, no join needed
        j = per.withColumns({"mu": pop.select("mu").scalar(), "tau2": pop.select("tau2").scalar()})
    shrunk = F.when(F.col("tau2") + F.col("v") > 0,
                    (F.col("tau2") * F.col("slope") + F.col("v") * F.col("mu")) / (F.col("tau2") + F.col("v"))
                    ).otherwise(F.col("mu"))
    return j.select(*keys, worker, "slope", "intercept", "n", "v", "mu", "tau2", shrunk.alias("slope_shrunk"))


# H9 ------------------------------------------------------------------------
def _poisson1_cuts(kmax: int = 8) -> list[float]:
    cdf, p, cuts = 0.0, math.exp(-1.0), []
    for k in range(kmax):
        cdf += p
        cuts.append(cdf)
        p = p / (k + 1)
    return cuts


POISSON1_CUTS = _poisson1_cuts()


def poisson1(u: Column) -> Column:
    """Poisson(1) count from a uniform by inverse CDF (counts above 7 have mass < 1e-5)."""
    expr = None
    for k, c in enumerate(POISSON1_CUTS):
        expr = F.when(u < c, k) if expr is None else expr.when(u < c, k)
    return expr.otherwise(len(POISSON1_CUTS))


def bootstrap_draws(df: DataFrame, keys: Sequence[str], n: int, seed: int = 7, worker: str = "worker_id",
                    y: str = "lo_p_sup", x: str = "lo_ground_truth") -> DataFrame:
    """Draws of (intercept, slope) per group by a Poisson bootstrap over workers.

    Trials are first reduced to per-(group, worker) sufficient statistics (a partial
    aggregate), so the replicate expansion is workers x n, not trials x n.
    """
    from trialscope.operators.draws import hash_uniform
    keys = list(keys)
    suff = df.groupBy(*keys, worker).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    rep = suff.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rep = rep.withColumn("_w", poisson1(hash_uniform(worker, "draw", seed=seed))).filter(F.col("_w") > 0)
    w = F.col("_w")
    s = rep.groupBy(*keys, "draw").agg(F.sum(w * F.col("c")).alias("sw"), F.sum(w * F.col("sx")).alias("sx"),
                                       F.sum(w * F.col("sy")).alias("sy"), F.sum(w * F.col("sxx")).alias("sxx"),
                                       F.sum(w * F.col("sxy")).alias("sxy"))
    a, b = _ols2(F.col("sw"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("sxy"))
    return s.select(*keys, "draw", a.alias("intercept"), b.alias("slope"))


# H4 ------------------------------------------------------------------------
def log_sigma_fit(df: DataFrame, mean_features: dict[str, Column], sigma_features: dict[str, Column],
                  y: str = "lo_p_sup") -> dict[str, dict[str, float]]:
    """Two passes: the mean model by least squares, then ln(residual^2) regressed on the
    spread predictors (+1.27 corrects E[ln chi2_1]); returns both coefficient sets."""
    mean_c = llo_pooled(df, mean_features, y)
    r = predict(df, mean_features, mean_c, "_fit").withColumn(
        "_lr2", F.ln(F.greatest((F.col(y) - F.col("_fit")) ** 2, F.lit(1e-12))) + 1.2704)
    sig = llo_pooled(r, sigma_features, "_lr2")
    return {"mean": mean_c, "log_sigma": {k: v / 2.0 for k, v in sig.items()}}


# H13 -----------------------------------------------------------------------
def intercept_fit(df: DataFrame, col: str, keys: Sequence[str] = (), binary: str | None = None) -> DataFrame:
    """Intercept-only models in one pass: mean and sd of ``col`` (gaussian), log odds of the mean of ``binary`` (bernoulli)."""
    aggs = [F.avg(col).alias("intercept"), F.stddev_samp(col).alias("sigma")]
    if binary is None:
        return df.groupBy(*keys).agg(*aggs)
    return df.groupBy(*keys).agg(*aggs, F.avg(F.col(binary).cast("double")).alias("_p")).select(
        *keys, "intercept", "sigma", qlogis("_p").alias("intercept_decision"))


# G4 ------------------------------------------------------------------------
def worker_draws(df: DataFrame, n: int, seed: int = 21, worker: str = "worker_id", row: str = "event_id",
                 y: str = "lo_p_sup", x: str = "lo_ground_truth") -> DataFrame:
    """Worker-level (intercept, slope) draws: a Poisson bootstrap over each worker's own trials.

    Every trial is expanded n times with a hashed Poisson(1) weight; the (worker, draw) sums
    are combined map-side before the shuffle, so a hot worker costs n rows per map task.
    """
    from trialscope.operators.draws import hash_uniform
    rep = df.select(worker, row, x, y).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rep = rep.withColumn("_w", poisson1(hash_uniform(row, "draw", seed=seed))).filter(F.col("_w") > 0)
    w = F.col("_w").cast("double")
    s = rep.groupBy(worker, "draw").agg(F.sum(w).alias("sw"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col(y)).alias("sy"),
                                        F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(x) * F.col(y)).alias("sxy"))
    a, b = _ols2(F.col("sw"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("sxy"))
    return s.select(worker, "draw", a.alias("intercept"), b.alias("slope"))


def worker_effect_draws(df: DataFrame, population: DataFrame, seed: int = 31, group: str = "condition", worker: str = "worker_id",
                        y: str = "lo_p_sup", x: str = "lo_ground_truth") -> DataFrame:
    """Lines of workers under each draw of the population's line: (group, worker, draw, intercept, slope).

    ``population`` is (group, draw, intercept, slope).  A worker's effect is the difference of their own least-squares line
    from their group's, with its 2 x 2 sampling covariance, drawn by Cholesky from two hashed normals of (worker, draw). All
    of it comes from one row of sums a worker, so only workers x draws rows are made. Workers need three trials and two
    values of x.
    """
    from trialscope.operators.draws import hash_normal
    sums = [F.regr_count(y, x).cast("double").alias("_n"), F.regr_avgx(y, x).alias("_mx"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"),
            F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy")]
    per = df.groupBy(group, worker).agg(*sums).where("_n >= 3 and _sxx > 0")
    whole = df.groupBy(group).agg(F.regr_slope(y, x).alias("_gb"), F.regr_intercept(y, x).alias("_ga"))
    s2 = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0)) / (F.col("_n") - 2)
    per = per.join(whole, group).select(group, worker, (F.col("_a") - F.col("_ga")).alias("_u0"), (F.col("_b") - F.col("_gb")).alias("_u1"),
                                        "_mx", "_n", "_sxx", s2.alias("_s2"))
    root = F.sqrt(1 / F.col("_n") + F.col("_mx") * F.col("_mx") / F.col("_sxx"))
    # Cholesky factor of s2 (X'X)^-1; the last pivot is s2 / sxx less the part that the intercept explains
    sd = F.sqrt("_s2")
    l10 = -F.col("_mx") / F.col("_sxx") / root
    per = per.withColumns({"_l00": sd * root, "_l10": sd * l10, "_l11": sd * F.sqrt(F.greatest(1 / F.col("_sxx") - l10 * l10, F.lit(0.0)))})
    each = per.join(population, group)
    each = each.withColumns({"_z0": hash_normal(worker, "draw", seed=seed), "_z1": hash_normal(worker, "draw", seed=seed + 1)})
    return each.select(group, worker, "draw", (F.col("intercept") + F.col("_u0") + F.col("_l00") * F.col("_z0")).alias("intercept"),
                       (F.col("slope") + F.col("_u1") + F.col("_l10") * F.col("_z0") + F.col("_l11") * F.col("_z1")).alias("slope"))
