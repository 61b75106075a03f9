"""R vs Spark differences: NULL in conditions, aggregates, clamps, rounding."""
from pyspark.sql import functions as F

from trialscope.operators import aggregates as D
from trialscope.operators import clean as B
from trialscope.operators import draws as G


def test_if_na_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    out = [r.y for r in df.select(B.if_na(F.col("x") > 2, "big", "small").alias("y")).collect()]
    assert out == [None, "small", "big"]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.0,), (100.0,), (42.0,)], "p double")
    assert [r.c for r in df.select(B.clamp("p").alias("c")).collect()] == [None, 0.5, 99.5, 42.0]


def test_n_distinct_counts_null(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (1, 2.0), (2, 5.0)], "g int, x double")
    got = {r.g: r.n for r in df.groupBy("g").agg(D.n_distinct("x").alias("n")).collect()}
    assert got == {1: 2, 2: 1}


def test_mean_propagate(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, 4.0)], "g int, x double")
    got = {r.g: r.m for r in df.groupBy("g").agg(D.mean_na("x", "propagate").alias("m")).collect()}
    assert got == {1: None, 2: 4.0}


def test_bround_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    assert [r.b for r in df.select(B.bin_duration("x").alias("b")).collect()] == [2.0, 4.0, -2.0]


def test_repair_never_leaves_minus_one(spark):
    from tests.conftest import SMALL
    from trialscope.sources.fixtures import responses
    r = B.repair_decision(responses(spark, SMALL))
    assert r.filter(F.col("intervene") == -1).count() == 0
    assert r.filter(~F.col("intervene").isin(0, 1)).count() == 0


def test_contrasts_antisymmetric(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.5), (1, "a", 2.0), (1, "b", -1.0)],
                               "draw int, lvl string, value double")
    ab = {r.draw: r.value for r in G.compare_levels(df, "value", "lvl", ["a", "b"], []).collect()}
    ba = {r.draw: r.value for r in G.compare_levels(df, "value", "lvl", ["b", "a"], []).collect()}
    assert ab == {0: 2.5, 1: -3.0} and all(ab[k] == -ba[k] for k in ab)


def test_marginalise_constant(spark):
    df = spark.createDataFrame([(d, c, 7.0) for d in range(3) for c in "xyz"], "draw int, cell string, value double")
    assert {r.value for r in G.marginalise(df, []).collect()} == {7.0}


def test_window_exclusions_equal_join_form(spark):
    from tests.conftest import SMALL
    from trialscope.sources.fixtures import responses
    t = B.op_trials(responses(spark, SMALL))
    a = D.with_exclusions(t).select("event_id", "exclude")
    b = D.apply_exclusions(t, D.exclusions(t)).select("event_id", "exclude")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.filter("exclude").count() > 0
