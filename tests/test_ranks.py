"""Positions, running sums, lags and quantiles over ranges against plain Python, with a hot group, ties and NULL keys."""
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialscope.operators import aggregates, ranks, reshape


def rows(seed, n, values):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["b", "c", "d", None]
    return [(i, r.choice(keys), r.choice(values) if r.random() < 0.9 else None) for i in range(n)] + [(n, "alone", 1.5)]


def by_key(data):
    out = defaultdict(list)
    for i, k, v in data:
        out[k].append((v, i))
    return {k: sorted(g, key=lambda e: (e[0] is not None, e[0] or 0, e[1])) for k, g in out.items()}


@pytest.mark.parametrize("ranges", [1, 5, 23])
def test_running_and_lag(spark, ranges):
    data = rows(ranges, 800, [0.5, 1.0, 2.0])
    df = spark.createDataFrame(data, "i int, k string, v double")
    at, prev, total = {}, {}, {}
    for group in by_key(data).values():
        for n, (v, i) in enumerate(group):
            at[i], total[i], prev[i] = n, len(group), group[n - 1] if n else (None, None)
    got = ranks.running(df, ["k"], ["v", "i"], ranges=ranges).collect()
    assert {r.i: r._before for r in got} == at and {r.i: r._total for r in got} == total
    weighed = ranks.running(df, [], ["i"], F.col("i"), ranges).collect()
    assert all(r._before == r.i * (r.i - 1) // 2 for r in weighed)
    got = ranks.lagged(df, ["k"], ["v", "i"], ["v", "i"], ranges).collect()
    assert {r.i: (r.prev_v, r.prev_i) for r in got} == prev


def test_ordered(spark):
    data = rows(1, 500, [3.0, 1.0, 2.0])
    got = ranks.ordered(spark.createDataFrame(data, "i int, k string, v double"), ["v", "i"], ranges=7).collect()
    want = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    assert [r.i for r in sorted(got, key=lambda r: r._at)] == [r[0] for r in want]


@pytest.mark.parametrize("values,ranges", [([1.0], 4), ([0.0, 1.0, 7.5], 9), ([x / 7 for x in range(900)], 16)])
def test_quantiles(spark, values, ranges):
    data = rows(len(values), 1500, values)
    ps = [0.0, 0.025, 0.25, 0.5, 0.77, 1.0]
    got = {(r.k, r.p): r.q for r in ranks.quantiles(spark.createDataFrame(data, "i int, k string, v double"), "v", ps, ["k"], ranges).collect()}
    groups = {k: [v for v, _ in g if v is not None] for k, g in by_key(data).items()}
    assert set(got) == {(k, p) for k, g in groups.items() if g for p in ps}
    for (k, p), q in got.items():
        assert abs(q - np.quantile(groups[k], p)) < 1e-12
    whole = {r.p: r.q for r in ranks.quantiles(spark.createDataFrame(data, "i int, k string, v double"), "v", ps).collect()}
    assert all(abs(q - np.quantile(sum(groups.values(), []), p)) < 1e-12 for p, q in whole.items())


def test_empty(spark):
    df = spark.createDataFrame([], "i int, k string, v double")
    assert ranks.quantiles(df, "v", [0.5], ["k"]).count() == 0
    assert ranks.running(df, ["k"], ["i"]).count() == 0 and ranks.lagged(df, ["k"], ["i"], ["v"]).count() == 0
    assert ranks.ordered(df, ["i"]).count() == 0


def test_rank_of_ties_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("a", 3.0, 3), (None, 2.0, 4), (None, None, 5)], "k string, v double, i int")
    got = {r.i: r["rank"] for r in reshape.ranked(df, ["k"], ["v"]).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 5: 1, 4: 2}


def test_a_hot_group_is_spread(spark):
    """No task of the last windows holds more than a few ranges' rows of a group that holds nearly all."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.rand(3).alias("v"), F.col("id").alias("i"))
    dealt = ranks.ranged(df, ["k", "v"], 16)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 20_000 / 16 * 3
    got = aggregates.qq_table(df, "v", ["k"], "i")
    assert got.count() == 20_000
