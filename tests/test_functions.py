"""Normal / logistic functions against the standard library, and array helpers."""
import math
from statistics import NormalDist

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialscope.functions import arrays as FA
from trialscope.functions.normal import plogis, pnorm, qlogis, qnorm, with_pnorm, with_qnorm

N = NormalDist()


def test_qnorm_matches_stdlib(spark):
    ps = [1e-300, 1e-10, 0.001, 0.02, 0.3, 0.5, 0.7, 0.975, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    rows = df.select("p", qnorm("p").alias("a"), qnorm(F.col("p")).alias("b")).collect()
    staged = {r.p: r.z for r in with_qnorm(df, "p", "z").collect()}
    for r in rows:
        ref = N.inv_cdf(r.p)
        assert abs(r.a - ref) <= 1e-12 * max(1.0, abs(ref))
        assert r.a == r.b == staged[r.p]


def test_qnorm_bounds_and_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (1.5,)], "p double")
    out = [r.z for r in df.select(qnorm("p").alias("z")).collect()]
    assert out[0] == float("-inf") and out[1] == float("inf") and out[2] is None and out[3] is None


def test_pnorm_matches_erfc(spark):
    xs = [-40.0, -10.0, -7.5, -3.0, -1.0, 0.0, 0.3, 2.5, 6.9, 7.2, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", pnorm("x").alias("a"), pnorm(F.col("x")).alias("b")).collect()
    staged = {r.x: r.c for r in with_pnorm(df, "x", "c").collect()}
    for r in rows:
        ref = 0.5 * math.erfc(-r.x / math.sqrt(2))
        tol = 5e-14 if abs(r.x) < 7 else 1e-8  # relative; deep-tail error of the rational form
        assert abs(r.a - ref) <= tol * max(ref, 1e-300) or abs(r.a - ref) < 1e-300
        assert r.a == r.b == staged[r.x]


@settings(max_examples=25, deadline=None)
@given(st.floats(min_value=1e-6, max_value=1 - 1e-6))
def test_plogis_inverts_qlogis(spark, p):
    v = spark.range(1).select(plogis(qlogis(F.lit(p))).alias("v")).first().v
    assert abs(v - p) < 1e-12


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0, 0.5],)], "a array<double>")
    r = df.select(FA.softmax("a").alias("s"), FA.logsumexp("a").alias("l"), FA.arr_mean("a").alias("m"),
                  FA.arr_range("a").alias("rg"), FA.arr_count_below("a").alias("n"),
                  FA.ppoints(F.lit(5)).alias("pp"), FA.ppoints(F.lit(12)).alias("pp12")).first()
    assert abs(sum(r.s) - 1) < 1e-12
    assert abs(r.l - math.log(sum(math.exp(x) for x in [1.0, -2.0, 3.0, 0.5]))) < 1e-12
    assert r.m == 0.625 and r.rg == 5.0 and r.n == 1
    assert [round(x, 12) for x in r.pp] == [round((i - 3 / 8) / (5 + 1 - 3 / 4), 12) for i in range(1, 6)]
    assert [round(x, 12) for x in r.pp12] == [round((i - 0.5) / 12, 12) for i in range(1, 13)]
