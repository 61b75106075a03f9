"""Draw queries: md5 noise of whole arrays, likelihoods of distinct observations, pairs spread over tasks."""
import numpy as np
from pyspark.sql import functions as F

from trialscope.functions.md5_noise import md5_normals, names
from trialscope.functions.normal import norm_logpdf, plogis
from trialscope.operators import blocks
from trialscope.operators import clean as B
from trialscope.operators import draws as G
from trialscope.plans import ORACLE, QUERIES
from trialscope.plans.q_draws import cell, patterns, unfold

from .conftest import SMALL


def test_md5_noise_of_arrays_equals_that_of_rows(spark):
    keys = [0, 7, -3, 10 ** 6, 10 ** 18, None]
    ids = [0, 5, 10, 12345, -2, 10 ** 17, None, 5]
    df = spark.createDataFrame([(k, [(d, 0.0) for d in ids]) for k in keys], "k long, draws array<struct<draw long, b0 double>>")
    z = df.withColumn("z", md5_normals(F.col("k"), names(F.col("draws")), 99))
    each = z.select("k", F.explode(F.arrays_zip("draws", "z")).alias("e")).select("k", F.col("e.draws.draw").alias("draw"), F.col("e.z").alias("z"))
    rows = each.withColumn("want", G.md5_normal("k", "draw", seed=99)).collect()
    assert len(rows) == len(keys) * len(ids)
    assert np.allclose([r.z for r in rows], [r.want for r in rows], rtol=0, atol=1e-12)


def test_predictions_come_from_md5_noise_on_both_sides(spark):
    for name in ("G2_predicted_draws", "G12_predicted_error", "G21_tally_predictions"):
        assert ORACLE[name].count("md5(") >= 2, name


def _trials(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ["densities", "HOPs"][i % 2], [5, 15][i // 2 % 2], bool(i % 3), float(i % 4) - 1.5, float(i % 5) / 2) for i in range(60)]
    rows += rows[:7] + rows[:3] + [(11, "HOPs", 5, True, 0.25, 0.75), (12, "HOPs", 15, True, None, 0.5)]  # repeated ids, equal and other rows
    draws = [(d, rng.normal(size=32).tolist()) for d in range(40)] + [(40, None)]
    return (spark.createDataFrame(rows, "event_id long, condition string, sd_diff int, means boolean, lo_ground_truth double, lo_p_sup double"),
            spark.createDataFrame(draws, "draw long, beta array<double>"))


def test_waic_and_loo_of_distinct_observations(spark):
    trials, draws = _trials(spark)
    coefs = G.chunked(G.cell_coefficients(draws))
    cell = G.cell_index(levels=["densities", "intervals", "HOPs", "QDPs"])
    direct = G.fitted_by_cell(trials, coefs, cell, "lo_ground_truth", value="mu").withColumn("ll", norm_logpdf("lo_p_sup", "mu", 1.0))
    ll, of = patterns(trials, coefs)
    assert of.select("pattern").distinct().count() < of.count() == 60
    want = G.waic(direct, ["event_id"]).first()
    got = G.waic(ll, ["pattern"], counts=of.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))).first()
    assert got.n_obs == want.n_obs == 60 and np.allclose(got[:4], want[:4], rtol=1e-10)
    a = {r.event_id: (r.log_mean_w, r.n_draws) for r in G.loo_stats(direct, ["event_id"]).collect()}
    b = {r.event_id: (r.log_mean_w, r.n_draws) for r in of.join(G.loo_stats(ll, ["pattern"]), "pattern").collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-10) for k in a)


def test_pairs_are_spread_over_tasks(spark, monkeypatch):
    trials, draws = _trials(spark)
    coefs = G.chunked(G.cell_coefficients(draws))
    monkeypatch.setattr(G, "PAIRS", 2048)  # two trials by a chunk
    assert G.spread(trials, coefs, "event_id").rdd.getNumPartitions() == 36


def _odd(spark):
    """Trials with repeated and null keys, a null truth and answer, a cell of one trial; draws without a vector, an id or a term."""
    trials, draws = _trials(spark)
    more = spark.createDataFrame([(None, "HOPs", 5, True, 0.5, 0.25), (-7, "HOPs", 5, True, 0.5, None), (10 ** 12, "QDPs", 5, False, 1.5, 0.0),
                                  (90, None, 5, True, 0.5, 0.25)], trials.schema)
    part = [None if i == 17 else 0.1 * i for i in range(32)]
    return trials.union(more), draws.union(spark.createDataFrame([(None, part), (5, part), (41, part)], draws.schema))


def test_blocks_give_the_loo_pit_of_rows(spark, monkeypatch):
    trials, draws = _odd(spark)
    monkeypatch.setattr(blocks, "TRIALS", 3)
    monkeypatch.setattr(blocks, "TILE", 50)
    monkeypatch.setattr(G, "CHUNK", 16)
    coefs = G.chunked(G.cell_coefficients(draws))
    assert coefs[1] > 1
    ll, of = patterns(trials, coefs)
    m = trials.join(of.join(G.loo_stats(ll, ["pattern"]), "pattern").drop("pattern"), "event_id")
    want = {r.event_id: r.loo_pit for r in G.loo_share(unfold(m, coefs), ["event_id"], "lo_p_sup").collect()}
    got = {r.event_id: r.loo_pit for r in G.loo_share(unfold(m, coefs, packed=True), ["event_id"], "lo_p_sup").collect()}
    assert len(want) >= 62 and got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], [want[k] for k in want], rtol=0, atol=1e-10)


def test_blocks_give_the_tally_of_rows(spark, monkeypatch):
    trials, draws = _odd(spark)
    monkeypatch.setattr(blocks, "TRIALS", 3)
    monkeypatch.setattr(blocks, "LARGE_TILE", 50)
    monkeypatch.setattr(blocks, "HELD", 2)
    monkeypatch.setattr(G, "CHUNK", 16)
    coefs = G.chunked(G.cell_coefficients(draws))
    rows = G.predicted_draws(G.fitted_by_cell(trials, coefs, cell(), "lo_ground_truth", value="mu"), ["event_id"], 1.0, value="mu", noise=G.md5_normal)
    want = {(r.draw, r.category): r.n for r in G.tally_predictions(rows, B.ordinal_bet(plogis("prediction") * 1000)).collect()}
    packed = G.fitted_by_cell(trials, coefs, cell(), "lo_ground_truth", value="mu", packed=True)
    packed = G.predicted_draws(packed, ["event_id"], 1.0, value="mu", noise=G.md5_normal)
    got = {(r.draw, r.category): r.n for r in G.tally_predictions(packed, lambda p: B.ordinal_bet(plogis(p["prediction"]) * 1000)).collect()}
    assert got == want and any(c is None for _, c in want) and any(d is None for d, _ in want)


def test_pairs_neither_become_rows_nor_wait_for_python(spark):
    """Before, each trial waited beside the names of a chunk's draws in a queue that goes to disk, and every pair was a row."""
    for name in ("G19_loo_pit", "G21_tally_predictions"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and "explode(draws" not in plan and "explode(arrays_zip" not in plan, name
        assert plan.count("MapInArrow") == 2, name
