"""Iterative fits against NumPy: every group to its own convergence, NULL where no maximum exists."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialscope.operators import fits


def minimum(f, x, steps=200):
    """Newton with finite differences and halving, down to steps that no longer help."""
    x = np.asarray(x, float)
    p, h = len(x), 1e-5
    for _ in range(steps):
        e = np.eye(p) * h
        g = np.array([(f(x + e[i]) - f(x - e[i])) / (2 * h) for i in range(p)])
        H = np.array([[(f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h * h)
                       for j in range(p)] for i in range(p)])
        size, turn = np.linalg.eigh(H)
        d = -turn @ ((turn.T @ g) / np.maximum(np.abs(size), 1e-8))
        t, f0 = 1.0, f(x)
        while f(x + t * d) > f0 and t > 1e-12:
            t /= 2
        x = x + t * d
        if np.max(np.abs(t * d)) < 1e-9:
            break
    return x


erf = np.vectorize(math.erf)
erfc = np.vectorize(math.erfc)


def cdf(z):
    return erfc(-np.asarray(z) / math.sqrt(2)) / 2


def points(seed, n, slope=1.3):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, n).round(1)
    return x, (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.4 + slope * x)))).astype(int)


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_glm_per_group(spark, link):
    rows, want = [], {}
    for g in range(6):
        x, y = points(g, 60 + 200 * g, 0.5 + g)
        rows += [(g, float(a), int(b)) for a, b in zip(x, y)]
        p = (lambda e: 1 / (1 + np.exp(-e))) if link == "logit" else cdf
        want[g] = minimum(lambda b: -np.sum(np.where(y == 1, np.log(p(b[0] + b[1] * x)), np.log(p(-b[0] - b[1] * x)))), [0, 0])
    rows += [(10, 1.0, 1), (10, 2.0, 1), (11, 1.0, 0), (11, 2.0, 1), (12, 3.0, 0), (12, 3.0, 1), (13, None, 1), (14, 1.0, None),
             (None, 0.0, 0), (None, 1.0, 1), (None, 2.0, 0), (None, 3.0, 1)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    got = {r.g: r for r in fits.glm2_fit(df, ["g"], "y", "x", link).collect()}
    for g, b in want.items():
        assert np.allclose([got[g].intercept, got[g].slope], b, atol=1e-6) and got[g].converged
    for g in (10, 11, 12):  # one outcome, parted outcomes, one value
        assert got[g].intercept is None and got[g].slope is None and got[g].converged is False
    assert got[None].converged and got[None].n == 4 and 13 not in got and 14 not in got
    assert len({r.iterations for r in got.values()}) > 1  # groups leave at different rounds


def test_few_rounds_are_told(spark):
    x, y = points(3, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    r = fits.glm2_fit(df, [], "y", "x", iters=2).first()
    assert r.converged is False and r.iterations == 2
    r = fits.glm2_fit(df, [], "y", "x").first()
    assert r.converged and r.n == 300


def test_step_halving(spark):
    """Far outliers send the full step beyond the maximum; the likelihood never falls."""
    rows = [(0, float(v), int(v > 0)) for v in (-300, -40, -1, 1, 40, 300)] + [(0, -0.5, 1), (0, 0.5, 0)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    got = fits.glm2_fit(df, ["g"], "y", "x").first()
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    e = lambda b: b[0] + b[1] * x
    want = minimum(lambda b: np.sum(np.logaddexp(0, e(b)) - y * e(b)), [0, 0])
    assert np.allclose([got.intercept, got.slope], want, atol=1e-5) and got.converged


def test_censored(spark):
    lo, hi, rows, want = -0.8, 1.1, [], {}
    for g in range(3):
        rng = np.random.default_rng(g)
        x = rng.uniform(-1, 1, 300).round(2)
        y = np.clip(0.2 + (0.5 + g) * x + rng.normal(0, 0.6, 300), lo, hi)
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]

        def nll(b):
            m, s = b[0] + b[1] * x, math.exp(b[2])
            z = (y - m) / s
            return -np.sum(np.where(y <= lo, np.log(cdf((lo - m) / s)), np.where(y >= hi, np.log(cdf((m - hi) / s)), -0.5 * z * z - math.log(s))))
        b = minimum(nll, [0, 0.5, -0.5])
        want[g] = [b[0], b[1], math.exp(b[2])]
    rows += [(8, 1.0, 0.3), (8, 2.0, 0.3), (9, 1.0, 0.1), (9, 1.0, 0.4)]
    got = {r.g: r for r in fits.censored_fit(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "y", "x", lo, hi).collect()}
    for g, b in want.items():
        assert np.allclose([got[g].intercept, got[g].slope, got[g].sigma], b, atol=1e-6) and got[g].converged
    assert got[8].slope is None and got[9].slope is None and not got[8].converged


def test_mixture(spark):
    rows, want = [], {}
    for g in range(3):
        rng = np.random.default_rng(g + 10)
        x = rng.uniform(-2, 2, 500)
        y = np.where(rng.uniform(size=500) < 0.5 + 0.15 * g, 0.5 + 0.8 * x + rng.normal(0, 0.3, 500), rng.normal(0, 0.2, 500))
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]

        def nll(t):
            one = -0.5 * ((y - t[0] - t[1] * x) / math.exp(t[2])) ** 2 - t[2] - np.logaddexp(0, -t[4])
            two = -0.5 * (y / math.exp(t[3])) ** 2 - t[3] - np.logaddexp(0, t[4])
            return -np.sum(np.logaddexp(one, two))
        t = minimum(nll, [0.5, 0.8, -1.2, -1.6, 0.4])
        want[g] = [t[0], t[1], math.exp(t[2]), math.exp(t[3]), 1 / (1 + math.exp(-t[4]))]
    got = fits.mixture_fit(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "y", "x").collect()
    for r in got:
        assert r.converged and np.allclose([r.a, r.b, r.s1, r.s0, r.share], want[r.g], atol=1e-6)
        assert r.iterations < 100


def em_shares(L, w, steps=200_000, prior=None, strength=0.0):
    p = np.full(L.shape[1], 1 / L.shape[1])
    for _ in range(steps):
        r = p * L
        r = r / r.sum(axis=1, keepdims=True)
        new = np.maximum((w @ r + (0 if prior is None else strength * prior)) / (w.sum() + (0 if prior is None else strength)), 1e-12)
        if np.max(np.abs(new - p)) < 1e-13:
            return new
        p = new
    return p


def test_heuristic_shares(spark):
    rng = np.random.default_rng(5)
    est = {c: [20.0 + 10 * c, 60.0 - 5 * c, 99.75] for c in range(4)}
    rows = []
    for worker in range(5):
        mix = rng.dirichlet([1, 1, 1])
        for _ in range(40 + 30 * worker):
            c = int(rng.integers(4))
            rows.append((worker, c, float(np.clip(rng.normal(est[c][rng.choice(3, p=mix)], 8), 0, 100).round())))
    rows += [(None, 1, 33.0), (0, 1, None), (0, 77, 50.0)]
    trials = spark.createDataFrame(rows, "worker_id int, cell int, answer double")
    h = spark.createDataFrame([(c, n, e) for c, es in est.items() for n, e in zip(("a_truth", "b_other", "c_one"), es)], "cell int, heuristic string, estimate double")
    got = fits.heuristic_shares(trials, h, ["cell"], strength=2.0, tol=1e-9).collect()

    def lik(select):
        use = [(c, a) for w, c, a in rows if a is not None and c in est and select(w)]
        return np.array([[math.exp(-0.5 * ((a - e) / 10) ** 2) for e in est[c]] for c, a in use])
    L = lik(lambda w: True)
    every = em_shares(L, np.ones(len(L)))
    table = {(r.level, r.worker_id, r.heuristic): r.share for r in got}
    assert np.allclose([table["overall", None, n] for n in ("a_truth", "b_other", "c_one")], every, atol=1e-6)
    for worker in (0, 3, 4, None):
        L = lik(lambda w: w == worker)
        want = em_shares(L, np.ones(len(L)), prior=every, strength=2.0)
        assert np.allclose([table["worker", worker, n] for n in ("a_truth", "b_other", "c_one")], want, atol=1e-6)
    assert all(r.converged for r in got) and abs(sum(v for k, v in table.items() if k[0] == "overall") - 1) < 1e-9


def test_shares_of_small_groups_take_no_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(w) if w else None, rng.normal(-3, 2, 3).round(1).tolist(), float(rng.integers(1, 4))) for w in rng.integers(0, 6, 150)]
    rows += [(7, [0.0, None, -1.0], 2.0), (8, [-1.0, float("nan"), 0.0], 1.0), (9, [-2.0, -2.0, -2.0], 1.0)]
    data = spark.createDataFrame(rows, "g int, ll array<double>, _w double")

    def shares(most, strength):
        monkeypatch.setattr(fits, "LOCAL_ROWS", most)
        toward = F.array(*map(F.lit, (0.5, 0.3, 0.2))) if strength else None
        return {r.g: r for r in fits.mixture_shares(data, ["g"], 3, toward=toward, strength=strength, iters=8).collect()}

    for strength in (0.0, 1.5):
        rounds, mixed = shares(0, strength), shares(25, strength)
        with monkeypatch.context() as m:
            m.setattr(fits, "squarem", None)
            local = shares(4096, strength)
        for got in (local, mixed):
            assert set(got) == set(rounds)
            for g, r in rounds.items():
                assert (got[g].n, got[g].converged, got[g].iterations) == (r.n, r.converged, r.iterations)
                assert np.allclose(got[g].shares, r.shares, atol=1e-9, equal_nan=True)


def ordinal_nll(form, k, x, z, y):
    def f(b):
        th = b[:k - 1]
        if form == "cumulative":
            eta = b[k - 1] * x + b[k] * z
            if np.any(np.diff(th) <= 0):
                return 1e9
            c = np.column_stack([np.zeros_like(x)] + [1 / (1 + np.exp(-(t - eta))) for t in th] + [np.ones_like(x)])
            return -np.sum(np.log(c[np.arange(len(y)), y] - c[np.arange(len(y)), y - 1]))
        spread = [b[k + j] for j in range(k - 1)] if form == "category_specific" else [b[k]] * (k - 1)
        u = np.cumsum(np.column_stack([np.zeros_like(x)] + [b[k - 1] * x + spread[j] * z - th[j] for j in range(k - 1)]), axis=1)
        return -np.sum(u[np.arange(len(y)), y - 1] - np.log(np.exp(u).sum(axis=1)))
    return f


@pytest.mark.parametrize("k", [2, 3, 4])
@pytest.mark.parametrize("form", fits.ORDINAL_FORMS)
def test_ordinal(spark, form, k):
    rng = np.random.default_rng(k)
    x, z = rng.normal(size=400).round(1), rng.integers(0, 2, 400).astype(float)
    latent = 0.9 * x + 0.5 * z + rng.logistic(size=400)
    y = 1 + np.searchsorted(np.linspace(-1, 1.5, k - 1), latent)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, z, y)] + [(None, 1.0, 1), (1.0, 1.0, 99)], "x double, z double, y int")
    coefs, told = fits.ordinal_fit(df, "y", {"x": F.col("x"), "z": F.col("z")}, k, form, ["z"])
    start = np.concatenate((np.linspace(-1, 1, k - 1), np.zeros(2 if form != "category_specific" else k)))
    f = ordinal_nll(form, k, x, z, y)
    want = minimum(f, start)
    assert told["converged"] and abs(told["loglik"] + f(want)) < 1e-6
    assert np.allclose(list(coefs.values()), want, atol=1e-4)


def test_ordinal_missing_class(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 3)], "x double, y int")
    coefs, told = fits.ordinal_fit(df, "y", {"x": F.col("x")}, 3)
    assert not told["converged"] and all(math.isnan(v) for v in coefs.values())


def test_workers_around_a_population(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for g in range(2):
        stats = []
        for worker in range(40):
            n = int(rng.integers(1, 25))
            u = np.array([[0.5, 0.0], [-0.2, 0.3]]) @ rng.normal(size=2)
            x = rng.uniform(-2, 2, n).round(2)
            y = 0.3 + u[0] + (0.7 + 0.2 * g + u[1]) * x + rng.normal(0, 0.4, n)
            rows += [(g, worker, float(a), float(b)) for a, b in zip(x, y)]
            stats.append((worker, np.column_stack([np.ones(n), x]), y))

        def covariance(t):
            L = np.array([[math.exp(t[2]), 0], [t[3], math.exp(t[4])]])
            return L @ L.T

        def nll(t):
            total = 0.0
            for _, X, y in stats:
                V = X @ covariance(t) @ X.T + math.exp(2 * t[5]) * np.eye(len(y))
                r = y - X @ t[:2]
                total += 0.5 * (np.linalg.slogdet(V)[1] + r @ np.linalg.solve(V, r) + len(y) * math.log(2 * math.pi))
            return total
        t = minimum(nll, [0.2, 0.6, -0.7, 0.0, -1.2, -0.9])
        lines = {}
        for worker, X, y in stats:
            V = X @ covariance(t) @ X.T + math.exp(2 * t[5]) * np.eye(len(y))
            lines[worker] = t[:2] + covariance(t) @ X.T @ np.linalg.solve(V, y - X @ t[:2])
        want[g] = (t, nll(t), lines)
    got = fits.llo_hierarchical(spark.createDataFrame(rows, "g int, worker_id int, x double, y double"), ["g"], y="y", x="x", tol=1e-8).collect()
    assert len(got) == 80
    for r in got:
        t, least, lines = want[r.g]
        assert r.converged and abs(r.loglik + least) < 1e-6
        assert np.allclose([r.mu_intercept, r.mu_slope, r.sigma], [t[0], t[1], math.exp(t[5])], atol=1e-5)
        assert np.allclose([r.sd_intercept, r.sd_slope], [math.exp(t[2]), math.hypot(t[3], math.exp(t[4]))], atol=1e-5)
        assert np.allclose([r.intercept, r.slope], lines[r.worker_id], atol=1e-5)
