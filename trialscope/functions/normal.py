"""Normal and logistic distribution functions as pure Column expressions.

Spark 4.1 has no ``erf``/``qnorm``: both are built here from published rational
approximations so that they stay inside whole-stage codegen (no Python UDF).
The same coefficient tables also render DuckDB SQL text for the oracle queries.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Published coefficients, must stay exactly as printed.
# Wichura (1988), Algorithm AS 241 "PPND16", Applied Statistics 37(3).
# Each list is highest power first (Horner order).
# ---------------------------------------------------------------------------
AS241_A = [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4,
           4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3,
           1.3314166789178437745e2, 3.3871328727963666080e0]
AS241_B = [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4,
           2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2,
           4.2313330701600911252e1, 1.0]
AS241_C = [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
           1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0,
           4.63033784615654529590e0, 1.42343711074968357734e0]
AS241_D = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
           1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0,
           2.05319162663775882187e0, 1.0]
AS241_E = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
           2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0,
           5.46378491116411436990e0, 6.65790464350110377720e0]
AS241_F = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
           7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
           5.99832206555887937690e-1, 1.0]
# Hart (1968) algorithm 5666 for the normal CDF, double precision form (West 2005).
HART_P = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
          112.079291497871, 221.213596169931, 220.206867912376]
HART_Q = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
          296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_SWITCH = 7.07106781186547
SQRT_2PI = 2.506628274631
Z975 = 1.959963984540054  # qnorm(0.975), the 95 % interval half-width in sd units
LOGIT_075 = math.log(3.0)  # qlogis(0.75), the JND criterion


def _horner(coefs, x):
    acc = coefs[0]
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def qnorm(p, mean=0.0, sd=1.0) -> Column:
    """Standard normal quantile (AS 241); NULL outside (0, 1), +-inf at 0/1 like R.

    Given a column name, the expression is parsed from SQL text in one call (cheaper to
    build than ~300 Column objects); given a Column, it is built in place.  Stage complex
    inputs in their own projection first: the input is referenced many times.
    """
    if isinstance(p, str):
        z = F.expr(_qnorm_text(f"`{p}`"))
        return z if (mean == 0.0 and sd == 1.0) else _col(mean) + _col(sd) * z
    p = _col(p)
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(AS241_A, r_c) / _horner(AS241_B, r_c)
    tail_p = F.when(q < 0, p).otherwise(F.lit(1.0) - p)
    r = F.sqrt(-F.ln(tail_p))
    near = _horner(AS241_C, r - 1.6) / _horner(AS241_D, r - 1.6)
    far = _horner(AS241_E, r - 5.0) / _horner(AS241_F, r - 5.0)
    tail = F.when(r <= 5.0, near).otherwise(far)
    z = (F.when(p.isNull(), None)
         .when((p < 0) | (p > 1), None)
         .when(p == 0, float("-inf"))
         .when(p == 1, float("inf"))
         .when(F.abs(q) <= 0.425, central)
         .when(q < 0, -tail)
         .otherwise(tail))
    return z if (mean == 0.0 and sd == 1.0) else _col(mean) + _col(sd) * z


def pnorm(x, mean=0.0, sd=1.0) -> Column:
    """Standard normal CDF (Hart 5666), lower tail; a column name is parsed from SQL text."""
    if isinstance(x, str) and mean == 0.0 and sd == 1.0:
        return F.expr(_pnorm_text(f"`{x}`"))
    x = _col(x)
    if not (mean == 0.0 and sd == 1.0):
        x = (x - _col(mean)) / _col(sd)
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    inner = e * _horner(HART_P, a) / _horner(HART_Q, a)
    cf = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = a + F.lit(k) / cf
    outer = e / (cf * SQRT_2PI)
    lower = F.when(a > 37.0, 0.0).when(a < HART_SWITCH, inner).otherwise(outer)
    return F.when(x.isNull(), None).when(x > 0, F.lit(1.0) - lower).otherwise(lower)


def qlogis(p) -> Column:
    """Log odds ln(p/(1-p)); +-inf at the bounds as in R, NULL outside [0, 1]."""
    p = _col(p)
    return (F.when((p < 0) | (p > 1), None)
            .when(p == 0, float("-inf")).when(p == 1, float("inf"))
            .otherwise(F.ln(p / (F.lit(1.0) - p))))


def plogis(x) -> Column:
    """Inverse logit, split on sign so exp never overflows; of a NumPy array too."""
    if isinstance(x, np.ndarray):
        e = np.exp(-np.abs(x))
        return np.where(x >= 0, 1.0, e) / (e + 1.0)
    x = _col(x)
    return F.when(x >= 0, F.lit(1.0) / (F.exp(-x) + 1.0)).otherwise(F.exp(x) / (F.exp(x) + 1.0))


def softplus(x) -> Column:
    """ln(1 + e^x) without overflow."""
    x = _col(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def norm_logpdf(x, mu, sigma) -> Column:
    """log density of Normal(mu, sigma); of NumPy arrays too."""
    if isinstance(mu, np.ndarray):
        z = (x - mu) / sigma
        return -0.5 * z * z - math.log(sigma) - 0.5 * math.log(2 * math.pi)
    z = (_col(x) - _col(mu)) / _col(sigma)
    return -F.lit(0.5) * z * z - F.ln(_col(sigma)) - F.lit(0.5 * math.log(2 * math.pi))


def bern_logit_logpmf(y, eta) -> Column:
    """Bernoulli log likelihood with a logit link, y in {0, 1}."""
    return _col(y) * _col(eta) - softplus(eta)


def normal_interval(mean, sd, z: float = Z975):
    """(lower, upper) of the central interval, default 95 %."""
    return _col(mean) - _col(sd) * z, _col(mean) + _col(sd) * z


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


# ---------------------------------------------------------------------------
# DuckDB text of the same functions, for oracle SQL only.
# ---------------------------------------------------------------------------
def _lit_sql(c: float) -> str:
    return f"CAST({c!r} AS DOUBLE)"


def _horner_sql(coefs, x: str) -> str:
    acc = _lit_sql(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}*({x})+{_lit_sql(c)})"
    return acc


def _qnorm_text(p: str) -> str:
    q = f"(({p})-0.5)"
    rc = f"(0.180625-{q}*{q})"
    central = f"({q}*{_horner_sql(AS241_A, rc)}/{_horner_sql(AS241_B, rc)})"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1.0-({p}) END))"
    near = f"({_horner_sql(AS241_C, r + '-1.6')}/{_horner_sql(AS241_D, r + '-1.6')})"
    far = f"({_horner_sql(AS241_E, r + '-5.0')}/{_horner_sql(AS241_F, r + '-5.0')})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN ({p}) IS NULL OR ({p}) < 0 OR ({p}) > 1 THEN NULL "
            f"WHEN ({p}) = 0 THEN CAST('-inf' AS DOUBLE) WHEN ({p}) = 1 THEN CAST('inf' AS DOUBLE) "
            f"WHEN abs({q}) <= 0.425 THEN {central} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def _pnorm_text(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-{a}*{a}/2.0)"
    inner = f"({e}*{_horner_sql(HART_P, a)}/{_horner_sql(HART_Q, a)})"
    cf = f"({a}+0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"({a}+{k}/{cf})"
    outer = f"({e}/({cf}*{_lit_sql(SQRT_2PI)}))"
    lower = f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < {_lit_sql(HART_SWITCH)} THEN {inner} ELSE {outer} END)"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0 THEN 1.0-{lower} ELSE {lower} END)"


def _let(name: str, value: str, body: str) -> str:
    """DuckDB text of ``body`` with ``value`` bound to ``name``, so that it is written (and computed) once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def qnorm_sql(p: str) -> str:
    q = "(_p-0.5)"
    rc = f"(0.180625-{q}*{q})"
    central = f"({q}*{_horner_sql(AS241_A, rc)}/{_horner_sql(AS241_B, rc)})"
    r = f"CASE WHEN _p > 0 AND _p < 1 THEN sqrt(-ln(CASE WHEN {q} < 0 THEN _p ELSE 1.0-_p END)) END"
    near = f"({_horner_sql(AS241_C, '_r-1.6')}/{_horner_sql(AS241_D, '_r-1.6')})"
    far = f"({_horner_sql(AS241_E, '_r-5.0')}/{_horner_sql(AS241_F, '_r-5.0')})"
    tail = f"(CASE WHEN _r <= 5.0 THEN {near} ELSE {far} END)"
    out = _let("_r", r, f"(CASE WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")
    return _let("_p", p, (f"(CASE WHEN _p IS NULL OR _p < 0 OR _p > 1 THEN NULL "
                          f"WHEN _p = 0 THEN CAST('-inf' AS DOUBLE) WHEN _p = 1 THEN CAST('inf' AS DOUBLE) "
                          f"WHEN abs({q}) <= 0.425 THEN {central} ELSE {out} END)"))


def pnorm_sql(x: str) -> str:
    e = "exp(-_a*_a/2.0)"
    inner = f"({e}*{_horner_sql(HART_P, '_a')}/{_horner_sql(HART_Q, '_a')})"
    cf = "(_a+0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"(_a+{k}/{cf})"
    outer = f"({e}/({cf}*{_lit_sql(SQRT_2PI)}))"
    lower = f"(CASE WHEN _a > 37.0 THEN 0.0 WHEN _a < {_lit_sql(HART_SWITCH)} THEN {inner} ELSE {outer} END)"
    return _let("_x", x, _let("_a", "abs(_x)", f"(CASE WHEN _x IS NULL THEN NULL WHEN _x > 0 THEN 1.0-{lower} ELSE {lower} END)"))


def qlogis_sql(p: str) -> str:
    return f"ln(({p})/(1.0-({p})))"


def plogis_sql(x: str) -> str:
    return (f"(CASE WHEN ({x}) >= 0 THEN 1.0/(exp(-({x}))+1.0) "
            f"ELSE exp({x})/(exp({x})+1.0) END)")


# ---------------------------------------------------------------------------
# Staged forms for hot paths: shared subexpressions (q, r, |x|, exp) become their own
# columns, each computed once per row.  Catalyst keeps the projections apart because the
# staged values are non-trivial and referenced many times, so the generated code stays
# small and the per-row cost is a few dozen flops plus one ln / sqrt / exp.
# Results are bit-identical to ``qnorm`` / ``pnorm``: the same operations in the same order.
# ---------------------------------------------------------------------------
def with_qnorm(df, p: str, out: str):
    q, rc, r = f"_{out}_q", f"_{out}_c", f"_{out}_r"
    df = df.withColumn(q, F.col(p) - F.lit(0.5))
    df = df.withColumns({
        rc: F.lit(0.180625) - F.col(q) * F.col(q),
        r: F.when(F.abs(F.col(q)) > 0.425,
                  F.sqrt(-F.ln(F.when(F.col(q) < 0, F.col(p)).otherwise(F.lit(1.0) - F.col(p))))),
    })
    central = F.col(q) * _horner(AS241_A, F.col(rc)) / _horner(AS241_B, F.col(rc))
    near = _horner(AS241_C, F.col(r) - 1.6) / _horner(AS241_D, F.col(r) - 1.6)
    far = _horner(AS241_E, F.col(r) - 5.0) / _horner(AS241_F, F.col(r) - 5.0)
    tail = F.when(F.col(r) <= 5.0, near).otherwise(far)
    pc = F.col(p)
    z = (F.when(pc.isNull() | (pc < 0) | (pc > 1), None)
         .when(pc == 0, float("-inf")).when(pc == 1, float("inf"))
         .when(F.abs(F.col(q)) <= 0.425, central)
         .when(F.col(q) < 0, -tail).otherwise(tail))
    return df.withColumn(out, z).drop(q, rc, r)


def with_pnorm(df, x: str, out: str):
    a, e = f"_{out}_a", f"_{out}_e"
    df = df.withColumn(a, F.abs(F.col(x)))
    df = df.withColumn(e, F.exp(-F.col(a) * F.col(a) / 2.0))
    A, E = F.col(a), F.col(e)
    inner = E * _horner(HART_P, A) / _horner(HART_Q, A)
    cf = A + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = A + F.lit(k) / cf
    outer = E / (cf * SQRT_2PI)
    lower = F.when(A > 37.0, 0.0).when(A < HART_SWITCH, inner).otherwise(outer)
    xc = F.col(x)
    return df.withColumn(out, F.when(xc.isNull(), None).when(xc > 0, F.lit(1.0) - lower).otherwise(lower)).drop(a, e)
