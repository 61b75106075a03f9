"""Rows-only operators against NumPy versions on small fixtures (brute force)."""
import math

import numpy as np
from pyspark.sql import functions as F

from trialscope.operators import draws as G
from trialscope.operators import models as H


def _toy(spark, n_workers=12, n=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for w in range(n_workers):
        for i in range(n):
            x = rng.uniform(-2, 2)
            y = 0.3 + 0.6 * x + rng.normal(0, 0.4)
            p = 1 / (1 + math.exp(-(-0.5 + 1.7 * x)))
            rows.append((w, i, x, y, int(rng.uniform() < p)))
    return spark.createDataFrame(rows, "worker_id int, i int, x double, y double, d int"), rows


def test_pooled_ols_matches_numpy(spark):
    df, rows = _toy(spark)
    coefs = H.llo_pooled(df, {"intercept": F.lit(1.0), "x": F.col("x")}, "y")
    X = np.array([[1.0, r[2]] for r in rows]); y = np.array([r[3] for r in rows])
    ref = np.linalg.lstsq(X, y, rcond=None)[0]
    assert abs(coefs["intercept"] - ref[0]) < 1e-9 and abs(coefs["x"] - ref[1]) < 1e-9


def _newton(X, y, iters=25):
    b = np.zeros(X.shape[1])
    for _ in range(iters):
        p = 1 / (1 + np.exp(-X @ b))
        W = p * (1 - p)
        b = b + np.linalg.solve(X.T @ (X * W[:, None]), X.T @ (y - p))
    return b


def test_logit_per_worker_matches_newton(spark):
    df, rows = _toy(spark, n_workers=4, n=200)
    got = {r.worker_id: (r.intercept, r.slope) for r in H.glm2_fit(df, ["worker_id"], "d", "x", "logit", iters=12).collect()}
    for w in range(4):
        X = np.array([[1.0, r[2]] for r in rows if r[0] == w]); y = np.array([r[4] for r in rows if r[0] == w])
        ref = _newton(X, y)
        assert np.allclose(got[w], ref, atol=1e-6)


def test_pooled_logit_no_keys(spark):
    df, rows = _toy(spark, n_workers=3, n=150)
    r = H.glm2_fit(df, [], "d", "x", "logit", iters=12).first()
    X = np.array([[1.0, r_[2]] for r_ in rows]); y = np.array([r_[4] for r_ in rows])
    assert np.allclose([r.intercept, r.slope], _newton(X, y), atol=1e-6)


def test_waic_and_loo_pit_match_numpy(spark):
    rng = np.random.default_rng(1)
    S, N = 50, 6
    ll = rng.normal(-1, 0.3, size=(N, S)); pred = rng.normal(0, 1, size=(N, S)); y = rng.normal(0, 1, size=N)
    rows = [(i, s, float(ll[i, s]), float(pred[i, s]), float(y[i])) for i in range(N) for s in range(S)]
    df = spark.createDataFrame(rows, "obs int, draw int, ll double, prediction double, y double")
    w = G.waic(df, ["obs"]).first()
    lppd = np.sum(np.log(np.mean(np.exp(ll), axis=1))); pw = np.sum(np.var(ll, axis=1, ddof=1))
    assert abs(w.lppd - lppd) < 1e-9 and abs(w.p_waic - pw) < 1e-9 and abs(w.waic + 2 * (lppd - pw)) < 1e-8
    got = {r.obs: r.loo_pit for r in G.loo_pit(df, ["obs"], "y").collect()}
    for i in range(N):
        wt = np.exp(-ll[i]); wt = np.minimum(wt, np.sqrt(S) * wt.mean())
        ref = np.sum(wt * (pred[i] <= y[i])) / np.sum(wt)
        assert abs(got[i] - ref) < 1e-9


def test_rhat_matches_numpy(spark):
    rng = np.random.default_rng(2)
    C, n = 4, 40
    vals = rng.normal(0, 1, size=(C, n)) + np.arange(C)[:, None] * 0.1
    rows = [(c * 1000 + i, c, 0, float(vals[c, i])) for c in range(C) for i in range(n)]
    df = spark.createDataFrame(rows, "draw int, chain int, term int, beta double")
    got = G.rhat(df).first().rhat
    halves = np.concatenate([vals[:, : n // 2], vals[:, n // 2:]])
    m = halves.shape[1]
    W = halves.var(axis=1, ddof=1).mean(); B_ = halves.mean(axis=1).var(ddof=1)
    ref = math.sqrt(((m - 1) / m * W + B_) / W)
    assert abs(got - ref) < 1e-10


def test_bootstrap_draws_reproducible_and_centred(spark):
    df, _ = _toy(spark, n_workers=30, n=20)
    a = H.bootstrap_draws(df, [], 100, seed=3, y="y", x="x").orderBy("draw").collect()
    b = H.bootstrap_draws(df, [], 100, seed=3, y="y", x="x").orderBy("draw").collect()
    assert a == b and len(a) == 100
    slopes = np.array([r.slope for r in a])
    assert abs(slopes.mean() - 0.6) < 0.1


def test_exact_quantiles_type7(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {round(r.p, 3): r.q for r in G.exact_quantiles(df, "v", [0.1, 0.5, 0.9]).collect()}
    for p in (0.1, 0.5, 0.9):
        assert abs(got[p] - float(np.quantile(vals, p))) < 1e-12


def test_mixture_recovers_share(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        x = rng.uniform(-2, 2)
        y = 0.5 + 0.8 * x + rng.normal(0, 0.2) if rng.uniform() < 0.7 else rng.normal(0, 0.2)
        rows.append(("a", x, y))
    df = spark.createDataFrame(rows, "g string, x double, y double")
    r = H.mixture_fit(df, ["g"], "y", "x", const=0.0, iters=25).first()
    assert abs(r.share - 0.7) < 0.08 and abs(r.b - 0.8) < 0.1


def test_waic_of_far_apart_draws(spark):
    ll = {1: [-3.0, -2000.0, -511.9, -512.1], 2: [-90000.25, -90001.5], 3: [700.0, 1100.0, 1100.5]}
    df = spark.createDataFrame([(o, x) for o, xs in ll.items() for x in xs], "obs int, ll double")
    got = {r.obs: r for r in G.waic_pointwise(df, ["obs"]).collect()}
    for o, xs in ll.items():
        x = np.array(xs)
        lppd = x.max() + np.log(np.exp(x - x.max()).sum()) - np.log(len(x))
        assert abs(got[o].lppd - lppd) < 1e-9 and math.isclose(got[o].p_waic, x.var(ddof=1), rel_tol=1e-9)
    assert G.waic_pointwise(df.limit(1), ["obs"]).first().p_waic is None


def test_noise_differs_by_every_part_of_a_grid_row(spark):
    rows = [(c, t, d, 0.0) for c in range(4) for t in range(3) for d in range(5)]
    df = spark.createDataFrame(rows, "cell int, ti int, draw int, value double")
    got = {r.prediction for r in G.predicted_draws(df, ["cell", "ti"], 1.0, seed=99).collect()}
    assert len(got) == len(rows)


def test_noise_is_normal_and_independent(spark):
    n, d = 400, 250
    z = np.zeros((n, d))
    for r in spark.range(n).selectExpr("id", f"explode(sequence(0, {d - 1})) AS draw").select("id", "draw", G.hash_normal("id", "draw", seed=5).alias("z")).collect():
        z[r.id, r.draw] = r.z
    flat = np.sort(z.ravel())
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs((z ** 3).mean()) < 0.03 and abs((z ** 4).mean() - 3) < 0.08
    p = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in flat[::50]])
    assert np.max(np.abs(p - (np.arange(len(flat)) + 0.5)[::50] / len(flat))) < 0.006  # Kolmogorov distance
    for a, b in ((z[:, 1:], z[:, :-1]), (z[1:], z[:-1]), (z[:, 7:], z[:, :-7]), (z[10:], z[:-10]), (z[1:, 1:], z[:-1, :-1])):
        assert abs((a * b).mean()) < 0.015 and abs((a ** 2 * b ** 2).mean() - 1) < 0.05
    assert np.abs(z.mean(axis=1)).max() < 5 / math.sqrt(d) and np.abs(z.mean(axis=0)).max() < 5 / math.sqrt(n)
    assert len(np.unique(z)) > 0.999 * z.size


def test_worker_effects_have_the_line_s_covariance(spark):
    df, rows = _toy(spark, n_workers=3, n=30)
    df = df.withColumn("g", F.lit("a"))
    population = spark.range(4000).select(F.lit("a").alias("g"), F.col("id").alias("draw"), F.lit(1.0).alias("intercept"), F.lit(2.0).alias("slope"))
    got = H.worker_effect_draws(df, population, group="g", y="y", x="x").toPandas()
    X = np.array([[1.0, r[2]] for r in rows]); y = np.array([r[3] for r in rows])
    whole = np.linalg.lstsq(X, y, rcond=None)[0]
    for w in range(3):
        at = [r[0] == w for r in rows]
        beta, res, *_ = np.linalg.lstsq(X[at], y[at], rcond=None)
        V = res[0] / 28 * np.linalg.inv(X[at].T @ X[at])
        d = got[got.worker_id == w][["intercept", "slope"]].to_numpy()
        assert len(d) == 4000
        assert np.allclose(d.mean(axis=0), beta - whole + [1.0, 2.0], atol=5 * np.sqrt(np.diag(V) / 4000))
        assert np.allclose(np.cov(d.T), V, rtol=0.15, atol=0.05 * V.max())


def test_prior_is_a_ridge_towards_its_mean(spark):
    df, rows = _toy(spark)
    coefs = H.llo_pooled(df, {"intercept": F.lit(1.0), "x": F.col("x")}, "y", prior={"x": (2.0, 0.05)})
    X = np.array([[1.0, r[2]] for r in rows]); y = np.array([r[3] for r in rows])
    pull = np.diag([0.0, 1 / 0.05 ** 2])
    ref = np.linalg.solve(X.T @ X + pull, X.T @ y + pull @ [0.0, 2.0])
    assert np.allclose([coefs["intercept"], coefs["x"]], ref, atol=1e-9)
    loose = H.llo_pooled(df, {"intercept": F.lit(1.0), "x": F.col("x")}, "y")
    assert loose["x"] < coefs["x"] < 2.0


def test_log_sigma_two_passes(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, 3000); g = rng.integers(0, 2, 3000)
    y = 0.4 + 0.9 * x + rng.normal(size=3000) * np.exp(-1 + 0.7 * g)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, g, y)], "x double, g int, y double")
    got = H.log_sigma_fit(df, {"intercept": F.lit(1.0), "x": F.col("x")}, {"intercept": F.lit(1.0), "g": F.col("g").cast("double")}, "y")
    X, Z = np.column_stack([np.ones(3000), x]), np.column_stack([np.ones(3000), g])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    spread = np.linalg.lstsq(Z, np.log(np.maximum((y - X @ beta) ** 2, 1e-12)) + 1.2704, rcond=None)[0] / 2
    assert np.allclose(list(got["mean"].values()), beta, atol=1e-9) and np.allclose(list(got["log_sigma"].values()), spread, atol=1e-9)
    assert abs(got["log_sigma"]["g"] - 0.7) < 0.1
