"""Iterative fits of many groups at once, each to its own convergence.

A round is one aggregate over the rows of the groups still at work: sums per group, then a new state per group in
columns.  A group whose step has become small, or whose system cannot be solved, leaves the working table; when half of
the groups have left, their rows leave the data too, so late rounds read only what is still open.  Rows are first reduced
to distinct rows with weights, partial sums are taken before the shuffle, and states are broadcast only where the number
of open groups, counted every round, is bounded; so a group of a third of all rows costs partial sums, not a task.

Mixture shares (H12) of a group of few distinct rows need no rounds of Spark: the group's rows are brought together once and
fitted in their task.

Newton fits (``newton``) halve a step that lowers the likelihood; EM fits (``squarem``) extrapolate two EM steps and fall
back to the plain step where that lowers it.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialscope.functions.normal import LOGIT_075, norm_logpdf, plogis, pnorm, softplus
from trialscope.session import cut_lineage

ROUNDS = 200
#: states are broadcast up to so many open groups (some 150 bytes each)
BROADCAST_GROUPS = 50_000
#: mixture shares of groups of at most so many distinct rows are fitted within a task, which takes groups of some so many rows in all
LOCAL_ROWS = 4_096
TASK_ROWS = 50_000
TINY = 1e-300
SQRT_2PI = math.sqrt(2 * math.pi)


def dnorm(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / SQRT_2PI


def weighted(df: DataFrame, keys: Sequence[str], **columns: Column) -> DataFrame:
    """Distinct rows of keys and columns with their number ``_w``; rows with a NULL column are left out. Materialised."""
    narrow = cut_lineage(df.select(*keys, *(c.alias(n) for n, c in columns.items())).groupBy(*keys, *columns).agg(
        F.count(F.lit(1)).cast("double").alias("_w")))
    return narrow.dropna(subset=list(columns))


def fit_groups(data: DataFrame, keys: Sequence[str], start: DataFrame, sums: dict[str, Column],
               update: Callable[[], dict[str, Column]], tol: float, rounds: int = ROUNDS, derive: Sequence[dict[str, Column]] = (),
               after: Sequence[dict[str, Column]] = ()) -> DataFrame:
    """The state of every group of ``start`` after its last round, with ``converged`` and ``iterations``.

    ``derive`` adds columns to a row beside its group's state, one dict after the other; ``sums`` are aggregates over these
    rows, and ``after`` adds columns to these; ``update()`` gives the new state from state and sums,
    and ``change``: the size of the step, NULL where the system cannot be solved (``converged`` is then NULL too).
    """
    keys = list(keys)
    state = [c for c in start.columns if c not in keys]
    active = cut_lineage(start.withColumn("iterations", F.lit(0)))
    left = kept = active.count()
    ended = []
    for _ in range(rounds):
        if not left:
            break
        side = active.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        side = F.broadcast(side) if left <= BROADCAST_GROUPS else side
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
        held = [F.first(c).alias(c) for c in (*state, "iterations")]
        rows = reduce(DataFrame.withColumns, derive, data.join(side, same))
        totals = rows.groupBy(*keys).agg(*held, *(c.alias(n) for n, c in sums.items()))
        totals = reduce(DataFrame.withColumns, after, totals)
        stepped = cut_lineage(totals.select(*keys, (F.col("iterations") + 1).alias("iterations"), *(v.alias(n) for n, v in update().items())))
        settled = F.col("change").isNull() | (F.col("change") <= tol)
        ended.append(stepped.where(settled).select(*keys, *state, (F.col("change") <= tol).alias("converged"), "iterations"))
        active = stepped.where(~settled).select(*keys, *state, "iterations")
        left = active.count()
        if left * 2 <= kept and left:
            open_ = active.select(*(F.col(k).alias(f"_of_{k}") for k in keys))
            data, kept = cut_lineage(data.join(open_, same, "left_semi")), left
    ended.append(active.select(*keys, *state, F.lit(False).alias("converged"), "iterations"))
    return reduce(DataFrame.unionByName, ended)


# Newton --------------------------------------------------------------------
def solve(h: list[list[Column]], g: list[Column]) -> tuple[list[Column], Column]:
    """Solution of a small symmetric system in columns by elimination, and whether its pivots are positive."""
    n = len(g)
    a = [[h[i][j] for j in range(n)] + [g[i]] for i in range(n)]
    fine = F.lit(True)
    for k in range(n):
        fine = fine & (a[k][k] > 1e-12 * h[k][k]) & (h[k][k] > 0)
        for i in range(k + 1, n):
            f = F.try_divide(a[i][k], a[k][k])
            a[i] = [a[i][j] - f * a[k][j] if j > k else a[i][j] for j in range(n + 1)]
    x: list[Column] = [F.lit(0.0)] * n
    for k in range(n - 1, -1, -1):
        rest = reduce(lambda s, j: s - a[k][j] * x[j], range(k + 1, n), a[k][n])
        x[k] = F.try_divide(rest, a[k][k])
    return x, fine


def newton(data: DataFrame, keys: Sequence[str], start: DataFrame, loglik: Column, gradient: list[Column],
           information: dict[tuple[int, int], Column], tol: float, rounds: int, valid: Column | None = None,
           derive: Sequence[dict[str, Column]] = ()) -> DataFrame:
    """Maximum of a concave log likelihood per group: ``start`` holds keys and b0..b(p-1).

    ``loglik``, ``gradient`` and ``information`` (i <= j) are row terms in the data's columns and b0..; each counts ``_w``
    times. A point that is not ``valid`` or lowers the likelihood is given up for half the step. Returns b0.., ``loglik``,
    ``converged``, ``iterations``; b0.. are NULL where the information is singular.
    """
    p = len(gradient)
    b, a, s = ([f"{x}{i}" for i in range(p)] for x in "bas")
    start = start.withColumns({**{x: F.lit(0.0) for x in (*a, *s)}, "best": F.lit(float("-inf"))})
    sums = {"ll": F.sum(F.col("_w") * loglik)} | {f"g{i}": F.sum(F.col("_w") * g) for i, g in enumerate(gradient)}
    sums |= {f"h{i}{j}": F.sum(F.col("_w") * h) for (i, j), h in information.items()}

    up = F.col("ll") >= F.col("best") - 1e-11 * (1 + F.abs("best"))
    up = F.when(F.col("best") == float("-inf"), True).otherwise(up) & ~F.isnan("ll")
    full, fine = solve([[F.col(f"h{min(i, j)}{max(i, j)}") for j in range(p)] for i in range(p)], [F.col(f"g{i}") for i in range(p)])
    after = [{"_up": F.coalesce(up if valid is None else up & valid, F.lit(False)), "_fine": fine} | {f"_full{i}": x for i, x in enumerate(full)}]

    def update() -> dict[str, Column]:
        full, fine, up = [F.col(f"_full{i}") for i in range(p)], F.col("_fine"), F.col("_up")
        step = [F.when(up, x).otherwise(F.col(y) / 2) for x, y in zip(full, s)]
        base = [F.when(up, F.col(x)).otherwise(F.col(y)) for x, y in zip(b, a)]
        size = F.greatest(*(F.abs(x) / (1 + F.abs(y)) for x, y in zip(full, map(F.col, b)))) if p > 1 else F.abs(full[0]) / (1 + F.abs(b[0]))
        out = {x: u + v for x, u, v in zip(b, base, step)} | dict(zip(a, base)) | dict(zip(s, step))
        return out | {"best": F.when(up, F.col("ll")).otherwise(F.col("best")), "change": F.when(~up, 1.0).when(fine, size)}

    out = fit_groups(data, keys, start, sums, update, tol, rounds, derive, after)
    solved = F.col("converged").isNotNull()
    return out.select(*keys, *(F.when(solved, F.col(x)).alias(x) for x in b), F.when(solved, F.col("best")).alias("loglik"),
                      F.coalesce("converged", F.lit(False)).alias("converged"), "iterations")


# H5 / H6 -------------------------------------------------------------------
def glm2_fit(df: DataFrame, keys: Sequence[str], y: str, x: str, link: str = "logit", iters: int = ROUNDS, tol: float = 1e-9) -> DataFrame:
    """Two-parameter GLM (intercept, slope) per group by Newton (logit) or scoring (probit), every group to ``tol``.

    NULL coefficients and ``converged`` = false where no finite maximum exists: one outcome only, or a value of x that
    parts the outcomes. The test is exact for two parameters: each outcome's range of x must reach into the other's.
    """
    pooled = not keys
    keys = list(keys) or ["_g"]
    df = df.withColumn("_g", F.lit(0)) if pooled else df
    data = weighted(df, keys, _y=F.col(y).cast("double"), _x=F.col(x).cast("double"))
    one = F.col("_y") == 1
    per = cut_lineage(data.groupBy(*keys).agg(
        F.sum("_w").cast("long").alias("n"), F.min(F.when(one, F.col("_x"))).alias("lo1"), F.max(F.when(one, F.col("_x"))).alias("hi1"),
        F.min(F.when(~one, F.col("_x"))).alias("lo0"), F.max(F.when(~one, F.col("_x"))).alias("hi0")))
    finite = F.coalesce((F.col("lo0") < F.col("hi1")) & (F.col("lo1") < F.col("hi0")), F.lit(False))
    start = per.where(finite).select(*keys, F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"))
    x, y, eta, mu = (F.col(c) for c in ("_x", "_y", "_eta", "_mu"))
    derive = [{"_eta": F.col("b0") + F.col("b1") * x}]  # staged, so that no stage repeats the one before
    if link == "logit":
        derive += [{"_mu": plogis(eta)}, {"_ll": y * eta - softplus(eta), "_r": y - mu, "_h": mu * (1 - mu)}]
    else:
        derive += [{"_mu": F.least(F.greatest(pnorm("_eta"), F.lit(1e-15)), F.lit(1 - 1e-15)), "_d": dnorm(eta)}, {"_v": mu * (1 - mu)},
                   {"_ll": y * F.ln(mu) + (1 - y) * F.ln(1 - mu), "_r": F.col("_d") * (y - mu) / F.col("_v"), "_h": F.col("_d") * F.col("_d") / F.col("_v")}]
    r, h = F.col("_r"), F.col("_h")
    fit = newton(data, keys, start, F.col("_ll"), [r, r * x], {(0, 0): h, (0, 1): h * x, (1, 1): h * x * x}, tol, iters, derive=derive)
    fit = fit.withColumnsRenamed({"b0": "intercept", "b1": "slope"}).unionByName(per.where(~finite).select(
        *keys, *(F.lit(None).cast("double").alias(c) for c in ("intercept", "slope", "loglik")), F.lit(False).alias("converged"), F.lit(0).alias("iterations")))
    sizes = per.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "n")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return fit.join(sizes, same).select(*([] if pooled else keys), "intercept", "slope", "n", "converged", "iterations")


def logit_fit(df: DataFrame, keys: Sequence[str] = (), y: str = "intervene", x: str = "evidence") -> DataFrame:
    """Logistic decision model per group, with PSE and JND from its coefficients."""
    c = glm2_fit(df, keys, y, x, "logit")
    return c.withColumns({"pse": F.try_divide(-F.col("intercept"), F.col("slope")),
                          "jnd": F.try_divide(F.lit(LOGIT_075), F.col("slope"))})


def probit_fit(df: DataFrame, keys: Sequence[str] = (), y: str = "intervene", x: str = "evidence") -> DataFrame:
    return glm2_fit(df, keys, y, x, "probit")


# H10 -----------------------------------------------------------------------
def censored_fit(df: DataFrame, keys: Sequence[str], y: str, x: str, lo: float, hi: float, iters: int = ROUNDS, tol: float = 1e-9) -> DataFrame:
    """Tobit (censored normal) linear fit per group: intercept, slope, sigma.

    Newton on (intercept, slope, 1) / sigma, in which the likelihood is concave; NULL where x or the answers are constant.
    """
    keys = list(keys)
    data = weighted(df, keys, _y=F.col(y).cast("double"), _x=F.col(x).cast("double"))
    flat = data.groupBy(*keys).agg(*(F.expr(f"sum(_w * {e})").alias(n) for n, e in (
        ("n", "1"), ("sx", "_x"), ("sy", "_y"), ("sxx", "_x * _x"), ("sxy", "_x * _y"), ("syy", "_y * _y"))))
    (b0, b1), fine = solve([[F.col("n"), F.col("sx")], [F.col("sx"), F.col("sxx")]], [F.col("sy"), F.col("sxy")])
    rss = F.col("syy") - b0 * F.col("sy") - b1 * F.col("sxy")
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    t = F.try_divide(F.lit(1.0), F.sqrt(F.greatest(rss, spread * 1e-4, F.lit(0.0)) / F.col("n")))
    fine = F.coalesce(fine & (spread > 1e-12 * F.col("syy")) & t.isNotNull(), F.lit(False))
    flat = cut_lineage(flat.select(*keys, (b0 * t).alias("b0"), (b1 * t).alias("b1"), t.alias("b2"), fine.alias("fine")))
    x, y, t = F.col("_x"), F.col("_y"), F.col("b2")
    below, above = y <= lo, y >= hi
    # answers beyond the bounds: the bound, and the side that is open
    data = data.withColumns({"_out": below | above, "_side": F.when(below, 1.0).otherwise(-1.0), "_at": F.when(below, lo).when(above, hi).otherwise(y)})
    out, at, side, z, ratio, k = (F.col(c) for c in ("_out", "_at", "_side", "_z", "_ratio", "_k"))
    derive = [{"_u": t * at - F.col("b0") - F.col("b1") * x}, {"_z": F.when(out, side * F.col("_u")).otherwise(F.col("_u"))},
              {"_area": F.greatest(pnorm("_z"), F.lit(TINY))}, {"_ratio": dnorm(z) / F.col("_area")},
              {"_k": F.when(out, ratio * (ratio + z)).otherwise(1.0), "_d": F.when(out, -side * ratio).otherwise(z),
               "_ll": F.when(out, F.ln("_area")).otherwise(F.ln(F.when(t > 0, t)) - 0.5 * z * z)}]
    d = F.col("_d")  # by intercept / sigma
    g = [d, d * x, F.when(out, side * ratio * at).otherwise(F.try_divide(F.lit(1.0), t) - z * y)]
    h = {(0, 0): k, (0, 1): k * x, (1, 1): k * x * x, (0, 2): -k * at, (1, 2): -k * x * at,
         (2, 2): F.when(out, k * at * at).otherwise(F.try_divide(F.lit(1.0), t * t) + y * y)}
    fit = newton(data, keys, flat.where("fine").drop("fine"), F.col("_ll"), g, h, tol, iters, t > 0, derive)
    fit = fit.unionByName(flat.where("not fine").select(
        *keys, *(F.lit(None).cast("double").alias(c) for c in ("b0", "b1", "b2", "loglik")), F.lit(False).alias("converged"), F.lit(0).alias("iterations")))
    return fit.select(*keys, F.try_divide("b0", "b2").alias("intercept"), F.try_divide("b1", "b2").alias("slope"),
                      F.try_divide(F.lit(1.0), F.col("b2")).alias("sigma"), "converged", "iterations")


# EM ------------------------------------------------------------------------
def _zip(f: Callable[..., Column], a: Column, b: Column) -> Column:
    return F.zip_with(a, b, f)


def _most(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def squarem(data: DataFrame, keys: Sequence[str], start: DataFrame, sums: dict[str, Column], em: Column, loglik: Column,
            tol: float, rounds: int, proper: Callable[[Column], Column] = lambda x: x, held: Sequence[str] = (),
            derive: Sequence[dict[str, Column]] = ()) -> DataFrame:
    """Fixed point of an EM step per group, sped up by squared extrapolation.

    ``start``: keys, ``state`` (array) and the ``held`` columns, constants of a group that ``em`` may read. ``em``: the EM step's array from the sums at ``state``; ``loglik``: their likelihood.
    Rounds go x0 -> x1 -> x2, then a leap along both differences (``proper`` brings it back into range) that counts only if it
    does not lower the likelihood; otherwise x2 goes on. ``tol`` bounds the largest change of a plain EM step.
    """
    nothing = F.array().cast("array<double>")
    start = start.withColumns({"x0": nothing, "x1": nothing, "phase": F.lit(0), "ll0": F.lit(float("-inf"))})

    x, x0, x1, phase, step = (F.col(c) for c in ("state", "x0", "x1", "phase", "_em"))
    r, v = F.col("_r"), F.col("_v")
    length = [F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, e: s + e * e)) for c in (r, v)]
    bad = lambda a: F.exists(a, lambda e: F.isnan(e) | e.isNull())
    leap = _zip(lambda p, q: p + q, x0, _zip(lambda p, q: 2 * F.col("_alpha") * p + F.col("_alpha") * F.col("_alpha") * q, r, v))
    after = [{"_em": em}, {"_r": _zip(lambda p, q: q - p, x0, x1), "_broken": bad(step)},
             {"_v": _zip(lambda p, q: q - p, r, _zip(lambda p, q: q - p, x1, step))},
             {"_alpha": F.greatest(F.try_divide(*length), F.lit(1.0)), "_still": ~(length[1] > 0)}, {"_leap": leap},
             {"_leap": F.when(F.col("_still") | bad(F.col("_leap")), step).otherwise(proper(F.col("_leap"))),
              "_good": F.coalesce((F.col("ll") >= F.col("ll0") - 1e-11 * (1 + F.abs("ll0"))) & ~F.isnan("ll"), F.lit(False)),
              "change": F.when(phase == 2, F.lit(1.0)).otherwise(F.when(~F.col("_broken"), _most(_zip(lambda p, q: p - q, x, step))))}]

    def update() -> dict[str, Column]:
        # phase 2 stands at the leap; x1 holds x2, the plain way on
        new = F.when(phase == 0, step).when(phase == 1, F.col("_leap")).otherwise(F.when(F.col("_good"), step).otherwise(x1))
        return {"state": F.when(F.col("change") <= tol, step).otherwise(new), "x0": F.when(phase == 0, x).otherwise(x0),
                "x1": F.when(phase < 2, step).otherwise(x1), "phase": (phase + 1) % 3,
                "ll0": F.when(phase == 0, F.col("ll")).otherwise(F.col("ll0")), "change": F.col("change")} | {c: F.col(c) for c in held}

    sums = sums | {"ll": loglik}
    return fit_groups(data, keys, start, sums, update, tol, rounds, derive, after).select(
        *keys, "state", *held, F.col("ll0").alias("loglik"), F.coalesce("converged", F.lit(False)).alias("converged"), "iterations")


# H8 ------------------------------------------------------------------------
def mixture_fit(df: DataFrame, keys: Sequence[str], y: str = "lo_p_sup", x: str = "lo_ground_truth", const: float = 0.0,
                iters: int = ROUNDS, tol: float = 1e-8) -> DataFrame:
    """Two components per group: the LLO line (a, b, s1), or a constant answer (``const``, s0); ``share`` is the line's.

    EM on (a, b, ln s1, ln s0, log odds of the share), with spreads of 0.001 at least. Infinite answers are left out.
    """
    keys = list(keys)
    y, x = F.col(y).cast("double"), F.col(x).cast("double")
    inf = float("inf")
    df = df.where((F.abs(y) < inf) & (F.abs(x) < inf))
    data = weighted(df, keys, _y=y, _x=x)
    w, at, y = F.col("_w"), F.col("_x"), F.col("_y")
    s = lambda e: F.expr(f"sum(_w * {e})")
    flat = data.groupBy(*keys).agg(s("1").alias("n"), s("_x").alias("sx"), s("_y").alias("sy"), s("_x * _x").alias("sxx"),
                                   s("_x * _y").alias("sxy"), s("_y * _y").alias("syy"))
    (b0, b1), _ = solve([[F.col("n"), F.col("sx")], [F.col("sx"), F.col("sxx")]], [F.col("sy"), F.col("sxy")])
    sd = F.ln(F.greatest(F.sqrt(F.greatest(F.col("syy") / F.col("n") - (F.col("sy") / F.col("n")) ** 2, F.lit(0.0))), F.lit(1e-3)))
    start = flat.select(*keys, F.array(b0, b1, sd, sd, F.lit(0.0)).alias("state"))
    th = [F.col("state")[i] for i in range(5)]
    line, fixed, r = F.col("_line"), F.col("_fixed"), F.col("_r")
    derive = [{"_line": norm_logpdf(y, th[0] + th[1] * at, F.exp(th[2])) - softplus(-th[4]), "_fixed": norm_logpdf(y, F.lit(const), F.exp(th[3])) - softplus(th[4])},
              {"_r": plogis(line - fixed), "_ll": F.greatest(line, fixed) + F.log1p(F.exp(-F.abs(line - fixed)))}]
    sums = {"n": F.sum(w)} | {c: F.sum(w * r * e) for c, e in (("rw", F.lit(1.0)), ("rx", at), ("ry", y), ("rxx", at * at), ("rxy", at * y), ("ryy", y * y))}
    sums |= {"w0": F.sum(w * (1 - r)), "ss0": F.sum(w * (1 - r) * (y - const) * (y - const))}
    (a, b), fine = solve([[F.col("rw"), F.col("rx")], [F.col("rx"), F.col("rxx")]], [F.col("ry"), F.col("rxy")])
    rss = F.greatest(F.col("ryy") - a * F.col("ry") - b * F.col("rxy"), F.lit(0.0))
    em = F.array(F.when(fine, a), F.when(fine, b), F.ln(F.greatest(F.sqrt(F.try_divide(rss, F.col("rw"))), F.lit(1e-3))),
                 F.ln(F.greatest(F.sqrt(F.col("ss0") / F.greatest(F.col("w0"), F.lit(1e-9))), F.lit(1e-3))),
                 F.ln(F.col("rw") / F.greatest(F.col("w0"), F.lit(1e-9))))
    out = squarem(data, keys, start, sums, em, F.sum(w * F.col("_ll")), tol, iters, derive=derive)
    th = [F.col("state")[i] for i in range(5)]
    return out.select(*keys, th[0].alias("a"), th[1].alias("b"), F.exp(th[2]).alias("s1"), F.exp(th[3]).alias("s0"), plogis(th[4]).alias("share"),
                      "converged", "iterations")


# H12 -----------------------------------------------------------------------
def _local_shares(groups: pa.Table, k: int, strength: float, rounds: int, tol: float) -> pa.Table:
    """``squarem`` of the shares for all groups of a task at once. ``groups``: keys, ``_rows`` (each _ll, _w), ``_n`` and maybe ``_prior``."""
    packed = groups["_rows"].combine_chunks()
    flat = packed.flatten()
    values = flat.field("_ll").flatten()
    fit = ~pc.is_null(values).to_numpy(zero_copy_only=False).reshape(-1, k).any(axis=1)  # sums pass over rows with a NULL
    ll, w = values.to_numpy(zero_copy_only=False).reshape(-1, k)[fit], flat.field("_w").to_numpy()[fit]
    sizes = np.bincount(np.repeat(np.arange(len(packed)), packed.value_lengths().to_numpy())[fit], minlength=len(packed))
    prior = np.zeros((len(packed), k))
    if "_prior" in groups.column_names:
        prior = groups["_prior"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k) * strength
    n = groups["_n"].to_numpy() + (strength if "_prior" in groups.column_names else 0.0)
    state, done, took = np.full((len(packed), k), 1.0 / k), np.zeros(len(packed), dtype=bool), np.zeros(len(packed), dtype=np.int32)
    open_, x = np.arange(len(packed)), state.copy()
    x0, x1, ll0 = x, x, np.full(len(packed), -np.inf)
    with np.errstate(all="ignore"):
        for turn in range(rounds):
            if not len(open_):
                break
            g, filled = np.repeat(np.arange(len(open_)), sizes), sizes > 0
            e = np.log(x)[g] + ll
            top = e.max(axis=1, initial=-np.inf)
            e = np.exp(e - top[:, None])
            total = e.sum(axis=1)
            cuts = (np.cumsum(sizes) - sizes)[filled]
            r, like = np.zeros_like(x), np.full(len(open_), np.nan)
            if len(cuts):
                r[filled] = np.add.reduceat(e * (w / total)[:, None], cuts)
                like[filled] = np.add.reduceat(w * (top + np.log(total)), cuts)
            like += (prior * np.log(x)).sum(axis=1)
            step = np.where(filled[:, None], np.maximum((r + prior) / n[:, None], 1e-12), 1e-12)
            change = np.abs(x - step).max(axis=1)
            if turn % 3 == 0:
                x0, x1, ll0, new = x, step, like, step
            elif turn % 3 == 1:
                r, v = x1 - x0, step - x1 - (x1 - x0)
                still = ~(np.linalg.norm(v, axis=1) > 0)
                alpha = np.maximum(np.where(still, 1.0, np.linalg.norm(r, axis=1) / np.linalg.norm(v, axis=1)), 1.0)[:, None]
                leap = np.maximum(x0 + 2 * alpha * r + alpha * alpha * v, 1e-12)
                stay = still | np.isnan(leap).any(axis=1)
                x1, new = step, np.where(stay[:, None], step, leap / leap.sum(axis=1, keepdims=True))
            else:
                change = np.ones(len(open_))
                new = np.where((like >= ll0 - 1e-11 * (1 + np.abs(ll0)))[:, None], step, x1)
            x = np.where((change <= tol)[:, None], step, new)
            state[open_], done[open_], took[open_] = x, change <= tol, turn + 1
            go = change > tol
            if not go.all():
                rows = np.repeat(go, sizes)
                ll, w, sizes, prior, n, open_ = ll[rows], w[rows], sizes[go], prior[go], n[go], open_[go]
                x, x0, x1, ll0 = x[go], x0[go], x1[go], ll0[go]
    out = groups.drop_columns([c for c in ("_t", "_rows", "_prior") if c in groups.column_names])
    shares = pa.ListArray.from_arrays(pa.array(np.arange(len(packed) + 1, dtype=np.int32) * k), pa.array(state.ravel()))
    return out.append_column("state", shares).append_column("converged", pa.array(done)).append_column("iterations", pa.array(took))


def mixture_shares(data: DataFrame, keys: Sequence[str], k: int, ll: str = "ll", weight: str = "_w", toward: Column | None = None,
                   strength: float = 0.0, iters: int = ROUNDS, tol: float = 1e-7) -> DataFrame:
    """Shares of ``k`` fixed components per group, by EM on rows that hold all log likelihoods of a trial in one array.

    Groups of up to ``LOCAL_ROWS`` rows are fitted in the task that holds them. For larger ones a step is one aggregate: the
    responsibilities of a row are computed in the row and summed by component. ``strength`` trials are added in the shares
    ``toward`` (an array column or literal), which draws groups of few trials to them.
    Returns keys, ``shares``, ``n``, ``converged``, ``iterations``.
    """
    keys = list(keys)
    data = data.select(*keys, F.col(ll).alias("_ll"), F.col(weight).alias("_w"), *([] if toward is None else [toward.alias("_to")]))
    start = data.groupBy(*keys).agg(*([] if toward is None else [F.first("_to").alias("_prior")]), F.sum("_w").alias("_n"),
                                    F.count(F.lit(1)).alias("_rows"))
    start = cut_lineage(start.withColumn("state", F.array_repeat(F.lit(1.0 / k), k)))
    larger = start.where(F.col("_rows") > LOCAL_ROWS).drop("_rows")
    total, most = start.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    few, parts = data, []
    if most > LOCAL_ROWS:
        large = larger.select(*(F.col(c).alias(f"_of_{c}") for c in keys))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys))
        few = data.join(large, same, "left_anti")
        parts.append(_shares_in_rounds(cut_lineage(data.join(large, same, "left_semi").drop("_to")), keys, larger, k, toward is not None, strength, iters, tol))
    few = few.groupBy(*keys).agg(F.collect_list(F.struct("_ll", "_w")).alias("_rows"), F.sum("_w").alias("_n"),
                                 *([] if toward is None else [F.first("_to").alias("_prior")]))
    fields = [few.schema[c] for c in (*keys, "_n")]
    schema = T.StructType(fields).add("state", T.ArrayType(T.DoubleType())).add("converged", T.BooleanType()).add("iterations", T.IntegerType())

    def fit(groups: pa.Table) -> pa.Table:
        return _local_shares(groups, k, strength, iters, tol)

    tasks = F.lit(max(1, -(-total // TASK_ROWS)))
    parts.append(few.withColumn("_t", F.pmod(F.xxhash64(*keys), tasks)).groupBy("_t").applyInArrow(fit, schema))
    return reduce(DataFrame.unionByName, parts).select(
        *keys, F.col("state").alias("shares"), F.col("_n").cast("long").alias("n"), "converged", "iterations")


def _shares_in_rounds(data: DataFrame, keys: Sequence[str], start: DataFrame, k: int, drawn: bool, strength: float, iters: int,
                      tol: float) -> DataFrame:
    """(keys, state, _n, converged, iterations) of the groups of ``start``, a round being one aggregate over their rows."""
    # the array of a row, once, before the sums read its elements
    derive = [{"_lp": _zip(lambda s, x: F.ln(s) + x, F.col("state"), F.col("_ll"))}, {"_top": F.array_max("_lp")},
              {"_e": F.transform("_lp", lambda v: F.exp(v - F.col("_top")))}, {"_total": F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)}]
    sums = {f"r{i}": F.sum(F.col("_w") * F.element_at("_e", i + 1) / F.col("_total")) for i in range(k)}
    prior = [F.col("_prior")[i] * strength if drawn else F.lit(0.0) for i in range(k)]
    size = F.col("_n") + (strength if drawn else 0.0)
    em = F.array(*(F.greatest((F.col(f"r{i}") + prior[i]) / size, F.lit(1e-12)) for i in range(k)))
    loglik = F.sum(F.col("_w") * (F.col("_top") + F.ln("_total")))
    if drawn:  # the prior's part is the same for all rows of a group
        part = _zip(lambda p, s: p * strength * F.ln(s), F.col("_prior"), F.col("state"))
        derive.append({"_part": F.aggregate(part, F.lit(0.0), lambda s, v: s + v)})
        loglik = loglik + F.first("_part")
    held = ["_n"] + (["_prior"] if drawn else [])

    def proper(x: Column) -> Column:
        x = F.transform(x, lambda v: F.greatest(v, F.lit(1e-12)))
        return F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, u: s + u))

    out = squarem(data, keys, start, sums, em, loglik, tol, iters, proper, held, derive)
    return out.select(*keys, "_n", "state", "converged", "iterations")


def heuristic_shares(trials: DataFrame, heuristics: DataFrame, cell: Sequence[str], worker: str = "worker_id", answer: str = "answer",
                     sigma: float = 10.0, strength: float = 1.0, tol: float = 1e-7) -> DataFrame:
    """Share of trials that each heuristic explains, over all trials (``level`` overall) and per worker.

    ``heuristics`` is (cell.., heuristic, estimate), a bounded table of the design's cells; an answer is Normal(estimate,
    sigma). Workers' shares are drawn to the overall ones by ``strength`` trials.  Long form: level, worker, heuristic, share,
    n, converged, iterations; the worker is NULL overall.
    """
    names = [r[0] for r in heuristics.select("heuristic").distinct().orderBy("heuristic").collect()]
    k = len(names)
    cells = heuristics.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("heuristic", "estimate"))).alias("_h"))
    cells = cells.where(F.size("_h") == k)
    rows = trials.where(F.col(answer).isNotNull()).groupBy(worker, *cell, F.col(answer).cast("double").alias("_a")).agg(
        F.count(F.lit(1)).cast("double").alias("_w"))
    rows = rows.join(cells, list(cell)).select(worker, "_w", F.transform("_h.estimate", lambda e: norm_logpdf(F.col("_a"), e, sigma)).alias("ll"))
    rows = cut_lineage(rows.groupBy(worker, "ll").agg(F.sum("_w").alias("_w")))
    distinct = rows.groupBy("ll").agg(F.sum("_w").alias("_w"))
    every = mixture_shares(distinct.withColumn("_g", F.lit(0)), ["_g"], k, tol=tol)
    every = cut_lineage(every.select(F.lit("overall").alias("level"), F.lit(None).cast(rows.schema[worker].dataType).alias(worker),
                                     "shares", "n", "converged", "iterations"))
    toward = every.select("shares").scalar()
    each = mixture_shares(rows, [worker], k, toward=toward, strength=strength, tol=tol).select(
        F.lit("worker").alias("level"), worker, "shares", "n", "converged", "iterations")
    both = every.unionByName(each).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    labels = F.array(*map(F.lit, names))
    return both.select("level", worker, labels[F.col("_i")].alias("heuristic"), F.col("shares")[F.col("_i")].alias("share"), "n", "converged", "iterations")


# H7 ------------------------------------------------------------------------
ORDINAL_FORMS = ("cumulative", "adjacent", "category_specific")


def ordinal_fit(df: DataFrame, y: str, features: dict[str, Column], k: int = 3, form: str = "cumulative", specific: Sequence[str] = (),
                iters: int = ROUNDS, tol: float = 1e-8) -> tuple[dict[str, float], dict[str, float]]:
    """Ordinal model of classes 1..k by scoring steps on the likelihood itself: (coefficients, loglik / converged / iterations).

    ``cumulative``: P(Y <= j) = plogis(theta_j - eta).  ``adjacent``: log P(j + 1) / P(j) = eta - theta_j.
    ``category_specific``: adjacent, where each feature of ``specific`` has its own coefficient at every step j.
    The rows are reduced to distinct ones; each round sums a p-vector and a p x p matrix, which alone reach the driver.
    """
    names, specific = list(features), list(specific) if form == "category_specific" else []
    common = [n for n in names if n not in specific]
    labels = [f"theta_{j}" for j in range(1, k)] + common + [f"{n}_{j}" for n in specific for j in range(1, k)]
    p = len(labels)
    data = weighted(df, [], _y=F.col(y).cast("int"), **{f"_x{i}": features[n].cast("double") for i, n in enumerate(names)})
    data = data.where(F.col("_y").between(1, k))
    x = {n: F.col(f"_x{i}") for i, n in enumerate(names)}
    theta = [F.col("th")[i] for i in range(p)]
    zero = F.lit(0.0)
    eta = reduce(lambda s, n: s + x[n] * theta[labels.index(n)], common, zero)
    at, prob = [F.col(f"_at{j}") for j in range(k - 1)], [F.col(f"_p{c}") for c in range(k)]
    # staged, so that no stage repeats the one before: places, then densities, then chances, then scores
    if form == "cumulative":
        stages = [{f"_at{j}": theta[j] - eta for j in range(k - 1)},
                  {f"_lo{j}": plogis(at[j]) for j in range(k - 1)} | {f"_up{j}": plogis(-at[j]) for j in range(k - 1)}]
        lo, up = [F.col(f"_lo{j}") for j in range(k - 1)], [F.col(f"_up{j}") for j in range(k - 1)]
        dens = [zero, *(a * b for a, b in zip(lo, up)), zero]
        # differences of one tail, so that far classes keep their digits
        inner = [F.when(at[j] > 0, up[j - 1] - up[j]).otherwise(lo[j] - lo[j - 1]) for j in range(1, k - 1)]
        stages.append({f"_p{c}": F.greatest(v, F.lit(TINY)) for c, v in enumerate([lo[0], *inner, up[-1]])})
        score = [[(dens[j + 1] if t == j else -dens[j] if t == j - 1 else zero) / prob[j] for t in range(k - 1)]
                 + [(dens[j] - dens[j + 1]) / prob[j] * x[n] for n in common] for j in range(k)]
    else:
        stages = [{f"_at{j}": eta - theta[j] + reduce(lambda s, n: s + x[n] * theta[labels.index(f"{n}_{j + 1}")], specific, zero) for j in range(k - 1)}]
        stages.append({f"_u{c}": reduce(lambda s, j: s + at[j], range(c), zero) for c in range(k)})
        u = [F.col(f"_u{c}") for c in range(k)]
        stages.append({"_top": F.greatest(*u)})
        stages.append({f"_e{c}": F.exp(u[c] - F.col("_top")) for c in range(k)})
        total = reduce(lambda s, c: s + F.col(f"_e{c}"), range(k), zero)
        stages.append({f"_p{c}": F.greatest(F.col(f"_e{c}") / total, F.lit(TINY)) for c in range(k)})
        d = [[F.lit(-1.0 if t < c else 0.0) for t in range(k - 1)] + [x[n] * float(c) for n in common]
             + [x[n] if t < c else zero for n in specific for t in range(k - 1)] for c in range(k)]
        stages.append({f"_m{i}": reduce(lambda s, c: s + prob[c] * d[c][i], range(k), zero) for i in range(p)})
        score = [[d[c][i] - F.col(f"_m{i}") for i in range(p)] for c in range(k)]
    stages.append({f"_s{i}_{c}": score[c][i] for i in range(p) for c in range(k)})
    mine = F.col("_y") - 1
    picked = lambda names: F.array(*names)[mine]
    stages.append({"_ll": F.ln(picked(prob))} | {f"_g{i}": picked([F.col(f"_s{i}_{c}") for c in range(k)]) for i in range(p)})
    info = {f"h{i}_{j}": reduce(lambda t, c: t + prob[c] * F.col(f"_s{i}_{c}") * F.col(f"_s{j}_{c}"), range(k), zero) for i in range(p) for j in range(i, p)}
    terms = {"ll": F.col("_ll")} | {f"g{i}": F.col(f"_g{i}") for i in range(p)} | info
    spark = df.sparkSession

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        now = data.crossJoin(F.broadcast(spark.createDataFrame([(at.tolist(),)], "th array<double>")))  # one row
        row = reduce(DataFrame.withColumns, stages, now).agg(*(F.sum(F.col("_w") * v).alias(n) for n, v in terms.items())).first()
        h = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        return row["ll"], np.array([row[f"g{i}"] for i in range(p)]), h

    counts = {r["_y"]: r["w"] for r in data.groupBy("_y").agg(F.sum("_w").alias("w")).collect()}  # k numbers
    if len(counts) < k:
        return dict.fromkeys(labels, float("nan")), {"loglik": float("nan"), "converged": 0.0, "iterations": 0.0}
    share = np.cumsum([counts[c] for c in range(1, k + 1)]) / sum(counts.values())
    start = np.zeros(p)
    start[:k - 1] = np.log(share[:-1] / (1 - share[:-1])) if form == "cumulative" else [np.log(counts[c] / counts[c + 1]) for c in range(1, k)]
    now, (ll, g, h) = start, sums(start)
    for done in range(1, iters + 1):
        try:
            move = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            return dict.fromkeys(labels, float("nan")), {"loglik": float("nan"), "converged": 0.0, "iterations": float(done)}
        if np.max(np.abs(move) / (1 + np.abs(now))) <= tol:
            return dict(zip(labels, (now + move).tolist())), {"loglik": ll, "converged": 1.0, "iterations": float(done)}
        for _ in range(60):
            new = now + move
            ordered = form != "cumulative" or np.all(np.diff(new[:k - 1]) > 0)
            if ordered and (found := sums(new))[0] >= ll - 1e-11 * (1 + abs(ll)):
                break
            move = move / 2
        else:
            break
        now, (ll, g, h) = new, found
    return dict(zip(labels, now.tolist())), {"loglik": ll, "converged": 0.0, "iterations": float(iters)}


# H3 ------------------------------------------------------------------------
def llo_hierarchical(df: DataFrame, keys: Sequence[str] = (), worker: str = "worker_id", y: str = "lo_p_sup", x: str = "lo_ground_truth",
                     iters: int = ROUNDS, tol: float = 1e-6) -> DataFrame:
    """LLO lines of workers around a population line per group: intercept and slope vary together between workers.

    EM on the 2 x 2 covariance between workers, the population line and the residual sd, from each worker's sums (one row
    a worker; trials are read once).  Workers need one trial.  Returns keys, worker, n, ``intercept`` and ``slope`` (drawn
    to the population by the worker's own precision), ``mu_intercept``, ``mu_slope``, ``sd_intercept``, ``sd_slope``, ``cor``,
    ``sigma``, ``loglik``, ``converged``, ``iterations``.  A between-worker sd is 1e-4 at least.
    """
    pooled = not keys
    keys = list(keys) or ["_g"]
    df = df.withColumn("_g", F.lit(0)) if pooled else df
    x, y, floor = F.col(x).cast("double"), F.col(y).cast("double"), 1e-4
    per = df.where(x.isNotNull() & y.isNotNull()).groupBy(*keys, worker).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(x).alias("_sx"), F.sum(y).alias("_sy"), F.sum(x * x).alias("_sxx"),
        F.sum(x * y).alias("_sxy"), F.sum(y * y).alias("_syy"))
    per = cut_lineage(per)
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("_n", "_sx", "_sy", "_sxx", "_sxy", "_syy"))
    flat = per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("_n", "_sx", "_sy", "_sxx", "_sxy", "_syy")))
    (b0, b1), fine = solve([[n, sx], [sx, sxx]], [sy, sxy])
    sd = F.greatest(F.sqrt(F.greatest(syy - b0 * sy - b1 * sxy, F.lit(0.0)) / n), F.lit(1e-4))
    start = flat.select(*keys, F.when(fine, F.array(b0, b1, sd / 2, F.lit(0.0), sd / 2, sd)).alias("state")).where(F.col("state").isNotNull())
    th = [F.col("state")[i] for i in range(6)]
    c = F.col
    derive = [{"_b0": th[0], "_b1": th[1], "_o00": th[2] * th[2], "_o01": th[2] * th[3], "_o11": th[3] * th[3] + th[4] * th[4],
               "_s2": th[5] * th[5], "_lo": 2 * (F.ln(th[2]) + F.ln(th[4]))}]  # _lo: log determinant of the covariance
    derive += [{"_a00": n / c("_s2") + c("_o11") * F.exp(-c("_lo")), "_a01": sx / c("_s2") - c("_o01") * F.exp(-c("_lo")),
                "_a11": sxx / c("_s2") + c("_o00") * F.exp(-c("_lo")), "_r0": (sy - n * c("_b0") - sx * c("_b1")) / c("_s2"),
                "_r1": (sxy - sx * c("_b0") - sxx * c("_b1")) / c("_s2")},
               {"_da": c("_a00") * c("_a11") - c("_a01") * c("_a01")},
               {"_v00": c("_a11") / c("_da"), "_v01": -c("_a01") / c("_da"), "_v11": c("_a00") / c("_da")},
               {"_m0": c("_v00") * c("_r0") + c("_v01") * c("_r1"), "_m1": c("_v01") * c("_r0") + c("_v11") * c("_r1")},
               {"_q": syy - 2 * (c("_m0") * sy + c("_m1") * sxy) + n * (c("_m0") ** 2 + c("_v00")) + 2 * sx * (c("_m0") * c("_m1") + c("_v01"))
                + sxx * (c("_m1") ** 2 + c("_v11")),
                "_ll": -0.5 * (n * math.log(2 * math.pi) + n * F.ln("_s2") + c("_lo") + F.ln("_da") - c("_m0") * c("_r0") - c("_m1") * c("_r1")
                               + (syy - 2 * (c("_b0") * sy + c("_b1") * sxy) + n * c("_b0") ** 2 + 2 * sx * c("_b0") * c("_b1") + sxx * c("_b1") ** 2) / c("_s2"))}]
    sums = {"k": F.count(F.lit(1)), "o00": F.sum(c("_m0") ** 2 + c("_v00")), "o01": F.sum(c("_m0") * c("_m1") + c("_v01")),
            "o11": F.sum(c("_m1") ** 2 + c("_v11")), "n": F.sum(n), "sx": F.sum(sx), "sxx": F.sum(sxx), "q": F.sum("_q"),
            "g0": F.sum(sy - n * c("_m0") - sx * c("_m1")), "g1": F.sum(sxy - sx * c("_m0") - sxx * c("_m1"))}
    (b0, b1), _ = solve([[c("n"), c("sx")], [c("sx"), c("sxx")]], [c("g0"), c("g1")])
    s2 = (c("q") - 2 * (b0 * c("g0") + b1 * c("g1")) + b0 * b0 * c("n") + 2 * b0 * b1 * c("sx") + b1 * b1 * c("sxx")) / c("n")
    l0 = F.sqrt(F.greatest(c("o00") / c("k"), F.lit(1e-8)))
    l1 = c("o01") / c("k") / l0
    l2 = F.sqrt(F.greatest(c("o11") / c("k") - l1 * l1, F.lit(1e-8)))
    em = F.array(b0, b1, l0, l1, l2, F.sqrt(F.greatest(s2, F.lit(1e-8))))

    def proper(a: Column) -> Column:
        return F.transform(a, lambda v, i: F.when(i.isin(2, 4, 5), F.greatest(v, F.lit(floor))).otherwise(v))

    fit = cut_lineage(squarem(per, keys, start, sums, em, F.sum("_ll"), tol, iters, proper, derive=derive))
    fit = fit.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    out = reduce(DataFrame.withColumns, derive, per.join(fit, same))
    return out.select(*([] if pooled else keys), worker, n.cast("long").alias("n"), (c("_b0") + c("_m0")).alias("intercept"), (c("_b1") + c("_m1")).alias("slope"),
                      c("_b0").alias("mu_intercept"), c("_b1").alias("mu_slope"), F.sqrt("_o00").alias("sd_intercept"), F.sqrt("_o11").alias("sd_slope"),
                      (c("_o01") / F.sqrt(c("_o00") * c("_o11"))).alias("cor"), F.sqrt("_s2").alias("sigma"), "loglik", "converged", "iterations")
