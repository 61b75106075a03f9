"""Grouped summaries.

All of them are ``groupBy().agg()`` with built-in aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle and a hot group only costs one
row per map task.  Distinct counts per group shuffle on (group, value) first,
which also spreads a hot group.  Nothing is collected to the driver.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions.normal import _col, with_qnorm
from trialscope.operators import clean as B
from trialscope.operators import ranks


def share(cond) -> Column:
    """Share of rows where ``cond`` holds: sum(cond) / n(), NULL conditions count as rows."""
    return F.sum(_col(cond).cast("int")) / F.count(F.lit(1))


def mean_na(c, na: str = "skip") -> Column:
    """Mean; ``na='propagate'`` gives NULL when any input is NULL, as R ``mean``."""
    c = _col(c)
    if na == "propagate":
        return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))
    return F.avg(c)


def n_distinct(c) -> Column:
    """R ``length(unique(x))``: NULL counts as one more value."""
    c = _col(c)
    return (F.countDistinct(c) + F.max(c.isNull().cast("int"))).cast("long")


# D1 ------------------------------------------------------------------------
def decision_rates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        share(F.col("intervene") == 1).alias("proportion_intervene"),
        F.avg(F.col("should_intervene").cast("double")).alias("optimal_decision"))


# D2 ------------------------------------------------------------------------
def decision_by_answer(df: DataFrame, keys: Sequence[str] = ("means", "condition", "p_superiority")) -> DataFrame:
    return df.groupBy(*keys).agg(share(F.col("intervene") == 1).alias("proportion_intervene"))


# D3 ------------------------------------------------------------------------
def correct_by_duration(df: DataFrame, keys: Sequence[str] = ("condition", "baseline")) -> DataFrame:
    return (df.withColumn("trial_dur_binned", B.bin_duration("trial_dur"))
            .groupBy(*keys, "trial_dur_binned").agg(share("correct").alias("proportion_correct")))


# D4 ------------------------------------------------------------------------
def mean_abs_error(df: DataFrame, keys: Sequence[str], na: str = "skip") -> DataFrame:
    return df.groupBy(*keys).agg(mean_na("abs_err_p_sup", na).alias("avg_abs_err_p_sup"))


# D5 ------------------------------------------------------------------------
def mean_error(df: DataFrame, keys: Sequence[str] = ("ground_truth", "means", "condition")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("err_p_sup").alias("avg_err_p_sup"))


# D6 ------------------------------------------------------------------------
def prop_correct(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(share("correct").alias("proportion_correct"))


# D7 ------------------------------------------------------------------------
def mean_answer(df: DataFrame, keys: Sequence[str] = ("ground_truth", "exclude")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("p_superiority").alias("avg_p_sup"))


# D8 ------------------------------------------------------------------------
def mean_error_reflected(df: DataFrame, keys: Sequence[str] = ("condition",)) -> DataFrame:
    return (df.withColumns({"ground_truth_50_100": B.reflect_truth(), "framing": B.frame()})
            .groupBy("ground_truth_50_100", *keys, "framing").agg(F.avg("err_p_sup").alias("avg_err_p_sup")))


# D9 ------------------------------------------------------------------------
def worker_quality(df: DataFrame, worker: str = "worker_id") -> DataFrame:
    """Per-worker exclusion signals. One value only is told by the extremes and the number of NULLs (a value too),
    which leaves a single distinct count: the rows are not expanded."""
    answered, rows = F.count("intervene"), F.count(F.lit(1))
    one_value = (answered == 0) | ((answered == rows) & (F.min("intervene") == F.max("intervene")))
    return df.groupBy(worker).agg(
        F.sum(B.failed_check().cast("int")).cast("long").alias("failed_attention_checks"),
        n_distinct("p_superiority").alias("unique_p_sup"),
        one_value.alias("speeding_intervene"),
        (F.sum((F.col("p_superiority") < 50).cast("int")) / rows).alias("p_sup_less_than_50"))


# D10 -----------------------------------------------------------------------
def exclusions(df: DataFrame, listed: Sequence = (), min_levels: int = 3, checks_only: bool = False,
               worker: str = "worker_id") -> DataFrame:
    """(worker, exclude): any failed check, fewer than ``min_levels`` answers used, or listed."""
    q = worker_quality(df, worker)
    ex = F.col("failed_attention_checks") > 0
    if not checks_only:
        ex = ex | (F.col("unique_p_sup") < min_levels)
    if listed:
        ex = ex | F.col(worker).isin(list(listed))
    return q.select(worker, ex.alias("exclude"))


def with_exclusions(df: DataFrame, listed: Sequence = (), min_levels: int = 3, worker: str = "worker_id") -> DataFrame:
    """D10 + C1 in one pass: the exclusion flag as a window over each worker's trials.

    The trial log is already hash-partitioned (and sorted) by worker, so the window adds
    no shuffle, and no second scan / join of the per-worker table is needed.  The set of
    distinct answers per worker is bounded by the answer scale (0-100 in halves).
    """
    w = Window.partitionBy(worker)
    p = F.col("p_superiority")
    failed = F.sum(B.failed_check().cast("int")).over(w)
    levels = F.size(F.collect_set(p).over(w)) + F.max(p.isNull().cast("int")).over(w)
    ex = (failed > 0) | (levels < min_levels)
    if listed:
        ex = ex | F.col(worker).isin(list(listed))
    return df.withColumn("exclude", ex)


# D11 -----------------------------------------------------------------------
def exclusion_rates(df: DataFrame, keys: Sequence[str] = ("condition",), n_checks: int = 2) -> DataFrame:
    per_worker = (df.groupBy("worker_id", *keys)
                  .agg((F.sum(B.passed_check().cast("int")) == n_checks).alias("passed_attention_checks")))
    return (per_worker.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_participants"),
        F.sum(F.col("passed_attention_checks").cast("int")).cast("long").alias("final_sample"))
        .withColumn("exclusion_rate",
                    (F.col("total_participants") - F.col("final_sample")) / F.col("total_participants")))


# D12 -----------------------------------------------------------------------
def workers_per_cell(df: DataFrame, keys: Sequence[str] = ("condition", "start_means")) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct("worker_id").alias("n_workers"))


# D13 -----------------------------------------------------------------------
def missing_trials(df: DataFrame, expected: int, keys: Sequence[str] = ("condition", "start_means", "worker_id")) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"))
            .withColumn("dropped_trials", F.lit(expected) - F.col("n_trials"))
            .filter(F.col("dropped_trials") > 0))


# D14 -----------------------------------------------------------------------
def duplicate_trials(df: DataFrame, key: Sequence[str] = ("worker_id", "trial_key")) -> DataFrame:
    """How often each trial of a worker appears, then a histogram of that count.

    The reference right-joins the trial grid to the responses (many to many) and counts
    matches; the count per (worker, trial) gives the same numbers without the join blow-up.
    """
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    per_worker = per.groupBy(key[0]).agg(F.sum((F.col("copies") > 1).cast("int")).cast("long").alias("n_duplicated"))
    return per_worker.groupBy("n_duplicated").agg(F.count(F.lit(1)).alias("n_workers"))


# D15 -----------------------------------------------------------------------
def worker_profile(df: DataFrame, cols: Sequence[str], worker: str = "worker_id") -> DataFrame:
    """One row per worker with its constant columns; ``constant`` is false if any column varies."""
    aggs = [F.min(c).alias(c) for c in cols]
    same = [(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0)) for c in cols]
    ok = same[0]
    for s in same[1:]:
        ok = ok & s
    return df.groupBy(worker).agg(*aggs, ok.alias("constant"))


# D16 -----------------------------------------------------------------------
def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


# D17 -----------------------------------------------------------------------
def code_share(df: DataFrame, num: Column, den: Column, keys: Sequence[str] = ("condition",),
               prefix: str = "") -> DataFrame:
    """Count of rows with ``num and den`` and its share of rows with ``den`` (NULL when 0/0)."""
    n_num = F.sum((num & den).cast("int")).cast("long")
    n_den = F.sum(den.cast("int")).cast("long")
    return df.groupBy(*keys).agg(n_num.alias(f"{prefix}count"), n_den.alias(f"{prefix}base"),
                                 F.try_divide(n_num, n_den).alias(f"{prefix}share"))


# D18 -----------------------------------------------------------------------
def strategy_table(df: DataFrame, flags: Sequence[str], key: str = "condition", total: str = "Overall") -> DataFrame:
    """Counts of each yes-flag per condition plus an overall row, in one rollup pass."""
    aggs = [F.sum((F.col(f) == "yes").cast("int")).cast("long").alias(f) for f in flags]
    out = df.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.grouping(key).alias("_g"), *aggs)
    return out.withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key))).drop("_g")


# D19 -----------------------------------------------------------------------
def answer_rate(df: DataFrame, flag: str = "answered", key: str = "condition") -> DataFrame:
    """Answered count and base rate per condition, both from one conditional aggregate."""
    g = df.groupBy(key).agg(F.count_if(flag).alias("n_answered"), F.count(F.lit(1)).alias("n_total"))
    return g.withColumn("answer_rate", F.col("n_answered") / F.col("n_total"))


# D20 -----------------------------------------------------------------------
def tally(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# D21 -----------------------------------------------------------------------
def collect_first(df: DataFrame, keys: Sequence[str], order: Sequence, col: str, k: int) -> DataFrame:
    """First ``k`` values of each group in an explicit order, as an array (bounded by k)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return (ranked.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("_rn", col))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s[col]).alias(col)))


#: positions of a group that one list of ``collect_chunks`` holds
CHUNK = 1024


def collect_chunks(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str], size: int | None = None) -> DataFrame:
    """All values of each group in an explicit order: ``cols`` as equal-length arrays of at most ``size`` (``CHUNK``)
    values, one row per (group, chunk), with ``offset``, the number of the group's rows before the chunk.  Rows are numbered
    by ranges of the order, so no task reads a whole group."""
    size = size or CHUNK
    ranked = ranks.running(df.select(*dict.fromkeys((*keys, *order, *cols))), keys, order).withColumn("_rn", F.col("_before") + 1)
    return (ranked.groupBy(*keys, (F.col("_rn") - 1 - (F.col("_rn") - 1) % size).alias("offset"))
            .agg(F.sort_array(F.collect_list(F.struct("_rn", *cols))).alias("_s"))
            .select(*keys, "offset", *[F.col("_s").getField(c).alias(c) for c in cols]))


# D22 ------------------------------------------------------------------------
def quantiles(df: DataFrame, col: str, ps: Sequence[float], keys: Sequence[str] = (), prefix: str = "q") -> DataFrame:
    """Exact type-7 quantiles (R default) per group, one column per probability.

    Computed from the (group, value) frequency table, so no group is ever buffered whole.
    """
    from trialscope.operators.draws import exact_quantiles
    q = exact_quantiles(df, col, ps, keys)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"{prefix}{int(round(p * 1000)):03d}")
                                  for p in ps])


# D23 -----------------------------------------------------------------------
def interval_bands(df: DataFrame, col: str, keys: Sequence[str], widths=(0.5, 0.8, 0.95)) -> DataFrame:
    """Median and equal-tailed intervals per group, one row per (group, width)."""
    from trialscope.operators.draws import exact_quantiles
    ps = sorted({0.5, *[p for w in widths for p in ((1 - w) / 2, (1 + w) / 2)]})
    q = exact_quantiles(df, col, ps, keys)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(f"_p{i}") for i, p in enumerate(ps)])
    pos = {p: i for i, p in enumerate(ps)}
    bands = F.array(*[F.struct(F.col(f"_p{pos[(1 - w) / 2]}").alias("lower"), F.col(f"_p{pos[(1 + w) / 2]}").alias("upper"),
                               F.lit(w).alias("width")) for w in widths])
    return (wide.select(*keys, F.col(f"_p{pos[0.5]}").alias(col), F.explode(bands).alias("_b"))
            .select(*keys, col, "_b.lower", "_b.upper", "_b.width"))


# D24 -----------------------------------------------------------------------
def histogram(df: DataFrame, col: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of ``width`` centred on multiples of it, with density = n / (total * width)."""
    b = (F.floor(F.col(col) / width + 0.5) * width).alias("bin")
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    if not keys:  # total over all rows as a scalar subquery instead of a one-partition window
        total = df.filter(F.col(col).isNotNull()).agg(F.count(F.lit(1))).scalar()
        return counts.withColumn("density", F.col("n") / (total * width))
    return counts.withColumn("density", F.col("n") / (tot * width))


# D25 -----------------------------------------------------------------------
def density_grid(df: DataFrame, col: str, keys: Sequence[str], lo: float, hi: float, n: int = 64,
                 bin_width: float | None = None, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an ``n``-point grid per group, from pre-binned counts.

    Values are binned first (bounded rows per group), then each bin spreads its count
    over the grid: the work is bins x grid points, independent of the number of rows.
    """
    bw_bin = bin_width or (hi - lo) / (4 * n)
    binned = (df.filter(F.col(col).isNotNull())
              .groupBy(*keys, (F.floor((F.col(col) - lo) / bw_bin) * bw_bin + lo + bw_bin / 2).alias("_c"))
              .agg(F.count(F.lit(1)).alias("_n")))
    if bandwidth is None:
        stats = df.groupBy(*keys).agg(F.stddev_samp(col).alias("_sd"), F.count(col).alias("_tot"))
        h = F.lit(1.06) * F.col("_sd") * F.pow(F.col("_tot").cast("double"), -0.2)
    else:
        stats = df.groupBy(*keys).agg(F.count(col).alias("_tot"))
        h = F.lit(bandwidth)
    step = (hi - lo) / (n - 1)
    g = binned.join(stats, list(keys), "inner").withColumn("_h", h) \
        .withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(lo) + i * step)))
    z = (F.col("x") - F.col("_c")) / F.col("_h")
    w = F.col("_n") * F.exp(-0.5 * z * z) / (F.col("_h") * F.lit(2.5066282746310002))
    return g.groupBy(*keys, "x").agg((F.sum(w) / F.first("_tot")).alias("density"))


# D26 -----------------------------------------------------------------------
def qq_table(df: DataFrame, col: str, keys: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Sample quantiles against normal theoretical quantiles qnorm((i - a) / (n + 1 - 2a)), R ``ppoints``.

    ``tie``: an id that spreads the rows of a frequent value.
    """
    t = ranks.running(df.where(F.col(col).isNotNull()).select(*keys, col, *([tie] if tie else [])), keys, [col, *([tie] if tie else [])])
    a = F.when(F.col("_total") <= 10, 3.0 / 8).otherwise(0.5)
    t = t.withColumn("_p", (F.col("_before") + 1 - a) / (F.col("_total") + 1 - 2 * a))
    return with_qnorm(t, "_p", "theoretical").select(*keys, F.col(col).alias("sample"), "theoretical")


# D27 -----------------------------------------------------------------------
def above_threshold(df: DataFrame, col: str = "evidence", keys: Sequence[str] = ("condition",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(col) > 0).cast("double")).alias("share_above"))


# D28 -----------------------------------------------------------------------
def expected_category(df: DataFrame, keys: Sequence[str], k: str = "category", p: str = "p") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(k) * F.col(p)).alias("expected_category"))


# D29 -----------------------------------------------------------------------
def payoff_table(df: DataFrame, key: str = "baseline", payoff: str = "expected_payoff", k: str = "award_value", n: Column | None = None,
                 budget: float = 2.5) -> DataFrame:
    """Per ``key``: expected and greatest value of an account, the rate that turns the expected value into the budget, bonuses.

    The account starts at n + n / 2 * K for ``n`` trials (an aggregate; by default the rows) of award value ``k``.
    """
    g = df.groupBy(key).agg((F.count(F.lit(1)) if n is None else n).alias("_n"), F.max(k).alias("_k"), F.sum(payoff).alias("_p"))
    half = F.col("_n") / 2 * F.col("_k")
    g = g.select(key, (F.col("_n") + half + F.col("_p")).alias("expected_value"), (F.col("_n") + half + half).alias("max_value"))
    g = g.withColumn("exchange_rate", F.bround(F.try_divide(F.lit(budget), F.col("expected_value")), 5))
    # bonuses at 4 decimals: value x 5-decimal rate has exact ties at the 7th
    return g.withColumns({f"{v}_bonus": F.bround(F.col(f"{v}_value") * F.col("exchange_rate"), 4) for v in ("expected", "max")})


# D30 -----------------------------------------------------------------------
def optimal_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("should_intervene").cast("int")).cast("long").alias("n_optimal"),
                                 F.count(F.lit(1)).alias("n"))


# D31 / D32 -----------------------------------------------------------------
def mean_of(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias(f"mean_{col}"))


def wmean(df: DataFrame, col: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    if weight is None:
        return df.groupBy(*keys).agg(F.avg(col).alias(f"wmean_{col}"))
    return df.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(col)) / F.sum(weight)).alias(f"wmean_{col}"))


# D33 -----------------------------------------------------------------------
def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``distinct(.keep_all = TRUE)`` with a defined winner: the first row in ``order``.

    ``max_by`` over a struct would also do; a window keeps all columns without listing them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


# Flagship slice (OP notebook) ---------------------------------------------
def apply_exclusions(df: DataFrame, flags: DataFrame, keep_excluded: bool = True, worker: str = "worker_id") -> DataFrame:
    """Left join of per-worker flags.  Flags grow with workers, so no broadcast hint:
    AQE turns the join into a broadcast at run time when the flag side is small."""
    out = df.join(flags, worker, "left")
    return out if keep_excluded else out.filter(~F.col("exclude"))


def overall_performance(responses: DataFrame, listed: Sequence = ()) -> DataFrame:
    """OP end to end: exclusions, checks removed, error and optimal decisions by condition x exclusion."""
    t = B.drop_checks(with_exclusions(B.op_trials(responses), listed))
    t = t.withColumns({"abs_err_p_sup": F.abs(F.col("p_superiority") - F.col("ground_truth") * 100),
                       "should_intervene": B.should_intervene()})
    t = t.withColumn("correct", B.correct())
    return t.groupBy("condition", "exclude").agg(
        F.avg("abs_err_p_sup").alias("avg_abs_err_p_sup"),
        share("correct").alias("proportion_correct"),
        F.countDistinct("worker_id").alias("n_workers"),
        F.count(F.lit(1)).alias("n_trials"))
