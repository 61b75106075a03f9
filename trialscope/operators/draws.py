"""Analytics over tables of model draws.

Layout: coefficient draws are vectors, ``(draw, chain, beta)``, or long, ``(draw, chain,
term, beta)``; a prediction grid is a small table of design cells with their terms.

Scale: fitted values of a design grid are computed on a draw's vector where it is stored
(the grid is one array value, its size checked), so the draws are not shuffled; later
aggregates keyed by (..., draw) combine in the same task before they shuffle.  Trials meet
the draws of their cell in chunks and unfold them within the row, or (G19, G21) are computed with them in blocks.  Quantiles over draws are exact (R type 7) by distributed
selection (``ranks.quantiles``), never by sorting a whole group.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions.md5_noise import box_muller, normals_of
from trialscope.functions.normal import LOGIT_075, _col, plogis, with_qnorm
from trialscope.operators import ranks
from trialscope.operators.blocks import Blocks, Pairs, blocks, per_draw, per_trial
from trialscope.session import cut_lineage

#: draws of a chunk of coefficients
CHUNK = 1024
#: trials x draws of a task
PAIRS = 1 << 24
#: chunks of draws (some 400 kB each) that are broadcast; more are joined by key
BROADCAST_CHUNKS = 64
#: rows of a design grid
MAX_GRID = 100_000


def by_draw(draws: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """Hash-partition draws by ``draw`` so every later (..., draw) aggregate is local."""
    return draws.repartition(n_partitions, "draw") if n_partitions else draws.repartition("draw")


# Stand-in model layout ---------------------------------------------------------
def cell_index(condition="condition", sd_diff="sd_diff", means="means", levels: Sequence[str] = ()) -> Column:
    """Design cell 0..15 of condition x sd_diff x means (cell-means parametrisation)."""
    cond = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(condition)) - 1
    return (cond * 4 + (_col(sd_diff) == 15).cast("int") * 2 + _col(means).cast("int")).cast("int")


def llo_design(cell: Column, x: Column, offset: int = 0) -> Column:
    """Intercept term ``offset + 2 cell`` with x = 1, slope term ``offset + 2 cell + 1`` with x."""
    return F.array(F.struct((F.lit(offset) + cell * 2).cast("int").alias("term"), F.lit(1.0).alias("x")),
                   F.struct((F.lit(offset) + cell * 2 + 1).cast("int").alias("term"), x.cast("double").alias("x")))


# G1 ------------------------------------------------------------------------
def fitted_draws(grid: DataFrame, draws: DataFrame, design: Column, link: str = "identity", value: str = "value") -> DataFrame:
    """Fitted value per grid row and draw: sum over terms of x * beta.

    ``draws`` holds one vector a draw (draw, beta); ``grid`` is a table of design cells (factor levels crossed, bounded by
    the design and checked), which becomes one array value: a draw is read once, where it is stored, and moves nowhere.
    """
    cells = F.collect_list(F.struct(*grid.columns, design.alias("_d")))
    cells = F.when(F.count(F.lit(1)) <= MAX_GRID, cells).otherwise(F.raise_error(f"a grid of more than {MAX_GRID} rows"))
    each = draws.select("draw", "beta", F.explode(grid.agg(cells).scalar()).alias("_g"))
    fit = F.aggregate("_g._d", F.lit(0.0), lambda s, d: s + d["x"] * F.element_at(F.col("beta"), d["term"] + 1))
    return each.select(*(F.col(f"_g.{c}").alias(c) for c in grid.columns), "draw", (plogis(fit) if link == "logit" else fit).alias(value))


# G2 / G3 ---------------------------------------------------------------------
def hash_uniform(*cols, seed: int = 0) -> Column:
    """Uniform on (0, 1) from md5 of the keys and a seed: same on every engine and rerun."""
    s = F.concat_ws("|", *[_col(c).cast("string") for c in cols], F.lit(str(seed)))
    bits = F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(2 ** 52)


# A prime modulus and multipliers of full period for it, as tabulated for congruential generators.
M31 = 2147483647
MULTIPLIERS = (742938285, 950706376, 1226874159, 62089911)
LAST = (1343714438, 630360016)


def noise_state(*cols, seed: int = 0) -> Column:
    """A 31-bit hash of integer keys and a seed in plain 64-bit arithmetic, the same on every engine."""
    x = F.lit(seed % M31).cast("long")
    for k, c in enumerate(cols):
        x = ((x + F.pmod(_col(c).cast("long"), F.lit(M31))) % M31) * MULTIPLIERS[k % 2] % M31
    for k, shift in enumerate((13, 11)):
        x = x.bitwiseXOR(F.shiftright(x, shift)) * MULTIPLIERS[2 + k] % M31
    return x


def noise_uniform(*cols, seed: int = 0) -> Column:
    """Uniform on (0, 1) from ``noise_state``."""
    return (noise_state(*cols, seed=seed) * LAST[0] % M31 + 0.5) / float(M31)


def hash_normal(*cols, seed: int = 0) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller) of integer keys: one ln, sqrt and cos per row, no
    branches and no strings, so it stays cheap inside generated code; reproducible on any engine."""
    u1, u2 = ((noise_state(*cols, seed=seed) * m % M31 + 0.5) / float(M31) for m in LAST)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _mod31(x: np.ndarray) -> np.ndarray:
    """``x`` modulo ``M31`` for unsigned 64-bit numbers below ``M31`` squared: the halves' sum, less ``M31`` where it reaches it."""
    x = (x & np.uint64(M31)) + (x >> np.uint64(31))
    return np.minimum(x, x - np.uint64(M31))  # below M31 the difference wraps to a large number


def hash_normals(p: Pairs, keys: Sequence[str], seed: int = 0) -> np.ndarray:
    """``hash_normal`` of the keys for all pairs of a block, in the same whole numbers."""
    x = np.array([[seed % M31]], dtype=np.uint64)
    for k, c in enumerate(keys):
        x = _mod31(_mod31(x + np.mod(p[c], M31).astype(np.uint64)) * np.uint64(MULTIPLIERS[k % 2]))
    for k, shift in enumerate((13, 11)):
        x = _mod31((x ^ (x >> np.uint64(shift))) * np.uint64(MULTIPLIERS[2 + k]))
    return box_muller(*((_mod31(x * np.uint64(m)) + 0.5) / float(M31) for m in LAST))


def md5_normal(*cols, seed: int = 0) -> Column:
    """Standard normal from two md5 uniforms (Box-Muller) of keys of any type, with 52 bits each."""
    u1, u2 = hash_uniform(*cols, seed=seed), hash_uniform(*cols, seed=seed + 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def predicted_draws(fitted: DataFrame, row_keys: Sequence[str], sigma, seed: int = 1234, value: str = "value",
                    out: str = "prediction", noise: Callable[..., Column] = hash_normal) -> DataFrame:
    """Fitted value plus Normal(0, sigma) noise from hashed uniforms of (row keys, draw, seed)."""
    if isinstance(fitted, Blocks):
        keys = [*row_keys, "draw"]

        def step(p: Pairs) -> None:
            if noise is md5_normal:  # a null key is left out of the hashed text
                p.put(out, p[value] + sigma * normals_of(*(p.raw[k] for k in keys), seed), p.null(value))
            else:
                p.put(out, p[value] + sigma * hash_normals(p, keys, seed), p.null(value, *keys))
        return fitted.add(step)
    return fitted.withColumn(out, F.col(value) + _col(sigma) * noise(*row_keys, "draw", seed=seed))


def cell_coefficients(draws: DataFrame, offset: int = 0, n_cells: int = 16) -> DataFrame:
    """Vectors of the cell-means layout (draw, beta) as one row per (draw, cell) with (b0, b1); a vector stays in its task."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n_cells - 1)), lambda c: F.struct(
        c.alias("cell"), F.element_at(F.col("beta"), c * 2 + (offset + 1)).alias("b0"), F.element_at(F.col("beta"), c * 2 + (offset + 2)).alias("b1")))
    return draws.select("draw", F.explode(pairs).alias("_c")).select("draw", "_c.*")


def chunked(coefs: DataFrame) -> tuple[DataFrame, int]:
    """(cell, chunk, draws): the (draw, b0, b1) of a cell in arrays of some ``CHUNK`` draws, and the number of chunks."""
    n = max(1, -(-coefs.agg(F.approx_count_distinct("draw")).first()[0] // CHUNK))
    chunk = F.pmod(F.xxhash64("draw"), F.lit(n)).cast("int")
    return coefs.groupBy("cell", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("draw", "b0", "b1"))).alias("draws")), n


def spread(trials: DataFrame, coefs: tuple[DataFrame, int], by: str) -> DataFrame:
    """``trials``, materialised and dealt by ``by`` to as many tasks as their pairs with the draws need.

    Before they unfold, trials are few bytes, so partitions sized by bytes would put nearly all pairs into one task.
    """
    trials = cut_lineage(trials)
    tasks = -(-trials.count() * coefs[1] * CHUNK // PAIRS)
    return trials.repartition(max(tasks, int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by)


def fitted_by_cell(df: DataFrame, coefs: tuple[DataFrame, int], cell: Column, x: str, value: str = "value", parts: bool = False,
                   packed: bool = False) -> DataFrame | Blocks:
    """Fitted value b0 + b1 * x for every row and draw; with ``parts``, b0 and b1 too; with ``packed`` as ``Blocks``.

    ``coefs`` comes from ``chunked``: a row meets each chunk of its cell once, in an equi-join on (cell, chunk) with keys
    that grow with the draws, and the draws unfold within the row, so rows x draws are never joined or shuffled.
    """
    table, n = coefs
    small = F.broadcast if n <= BROADCAST_CHUNKS else lambda t: t
    if packed:
        def step(p: Pairs) -> None:
            p.put(value, p["b0"] + p[x] * p["b1"], p.null("b0", "b1", x))
        return blocks(df, df.columns, cell, table, n, small).add(step)
    rows = df.select("*", cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"))
    own = [F.col(f"_d.{b}").alias(b) for b in ("b0", "b1")] if parts else []
    each = rows.join(small(table), ["cell", "chunk"]).select(*df.columns, F.explode("draws").alias("_d"))
    return each.select(*df.columns, F.col("_d.draw").alias("draw"), *own, (F.col("_d.b0") + F.col(x) * F.col("_d.b1")).alias(value))


def take_draws(draws: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """A seeded subsample of ``n`` draw ids (the limit is the feature), kept by semi join."""
    ids = draws.select("draw").distinct().withColumn("_h", F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(str(seed)))))
    chosen = ids.orderBy("_h").limit(n).select("draw")
    return draws.join(F.broadcast(chosen), "draw", "left_semi")


# G5 ------------------------------------------------------------------------
def level_text(v) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def compare_levels(df: DataFrame, value: str, by: str, levels: Sequence, keys: Sequence[str],
                   comparison: str = "pairwise", out: str | None = None) -> DataFrame:
    """Per (keys, draw): differences ``later - earlier`` between levels of ``by``.

    One grouped pass with a conditional aggregate per level (no self-join, no pairs
    beyond the listed comparisons); the result is long, one row per contrast.
    """
    levels = list(levels)
    if comparison == "pairwise":
        pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i + 1:]]
    elif comparison == "control":
        pairs = [(levels[0], b) for b in levels[1:]]
    else:  # ordered
        pairs = list(zip(levels[:-1], levels[1:]))
    aggs = [F.first(F.when(F.col(by) == F.lit(v), F.col(value)), ignorenulls=True).alias(f"_l{i}")
            for i, v in enumerate(levels)]
    wide = df.groupBy(*keys, "draw").agg(*aggs)
    idx = {v: i for i, v in enumerate(levels)}
    diffs = [F.struct(F.lit(f"{level_text(b)} - {level_text(a)}").alias("c"),
                      (F.col(f"_l{idx[b]}") - F.col(f"_l{idx[a]}")).alias("v")) for a, b in pairs]
    return (wide.select(*keys, "draw", F.explode(F.array(*diffs)).alias("_p"))
            .select(*keys, "draw", F.col("_p.c").alias(by), F.col("_p.v").alias(out or value)))


# G6 / G7 / G8 ------------------------------------------------------------------
def slopes_intercepts(fitted: DataFrame, keys: Sequence[str], x: str, value: str = "value") -> DataFrame:
    """Slope = value(x=1) - value(x=0) and intercept = value(x=0), per (keys, draw), in one pass."""
    return fitted.groupBy(*keys, "draw").agg(
        (F.first(F.when(F.col(x) == 1.0, F.col(value)), ignorenulls=True)
         - F.first(F.when(F.col(x) == 0.0, F.col(value)), ignorenulls=True)).alias("slope"),
        F.first(F.when(F.col(x) == 0.0, F.col(value)), ignorenulls=True).alias("intercept"))


def psychometric(df: DataFrame, slope: str = "slope", intercept: str = "intercept") -> DataFrame:
    """PSE = -intercept / slope, JND = logit(.75) / slope (NULL when the slope is 0)."""
    return df.withColumns({"pse": F.try_divide(-F.col(intercept), F.col(slope)),
                           "jnd": F.try_divide(F.lit(LOGIT_075), F.col(slope))})


def to_award_scale(df: DataFrame, baseline: float, award_value: float, cols=("pse", "jnd")) -> DataFrame:
    """Evidence units back to the gain in award probability (one baseline and award value)."""
    c = baseline + 1.0 / award_value
    k = 1.0 / c - 1.0
    return df.withColumns({f"{x}_p_award": F.exp(F.col(x)) / (F.lit(k) + F.exp(F.col(x))) - c for x in cols})


# G9 ------------------------------------------------------------------------
def marginalise(df: DataFrame, keep: Sequence[str], value: str = "value") -> DataFrame:
    """Unweighted mean over the dropped grid columns, per (keep, draw)."""
    return df.groupBy(*keep, "draw").agg(F.avg(value).alias(value))


# G10 / D22 -----------------------------------------------------------------
def exact_quantiles(df: DataFrame, col: str, ps: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact type-7 quantiles (R default) per group, long form ``(keys, p, q)``: see ``ranks.quantiles``."""
    return ranks.quantiles(df, col, ps, keys)


def mean_qi(df: DataFrame, keys: Sequence[str], col: str = "value", width: float = 0.95) -> DataFrame:
    """Mean and equal-tailed interval over draws per group (``.lower``/``.upper`` as lower/upper)."""
    lo, hi = (1 - width) / 2, (1 + width) / 2
    q = exact_quantiles(df, col, [lo, hi], keys)
    qw = q.groupBy(*keys).agg(F.max(F.when(F.col("p") == lo, F.col("q"))).alias("lower"),
                              F.max(F.when(F.col("p") == hi, F.col("q"))).alias("upper"))
    m = df.groupBy(*keys).agg(F.avg(col).alias(col))
    return m.join(qw, list(keys), "inner").withColumn("width", F.lit(width))


# G16 -----------------------------------------------------------------------
def term_combinations(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Parameters that are sums of terms, per draw: ``weights`` is (name, term, weight), a
    small literal table, so the pivot / expression / unpivot is one join and one aggregate."""
    j = draws.join(F.broadcast(weights), "term")
    return j.groupBy("draw", "name").agg(F.sum(F.col("weight") * F.col("beta")).alias("value"))


# G17 -----------------------------------------------------------------------
def pit_residuals(pred: DataFrame, obs_keys: Sequence[str], y: str, prediction: str = "prediction") -> DataFrame:
    """Share of predicted draws below the observed answer, and its normal z-score."""
    s = pred.groupBy(*obs_keys).agg(F.avg((F.col(prediction) < F.col(y)).cast("double")).alias("pit"))
    s = s.withColumn("_pc", F.least(F.greatest(F.col("pit"), F.lit(1e-6)), F.lit(1 - 1e-6)))
    return with_qnorm(s, "_pc", "z").drop("_pc")


# G18 / G19 / H14 -------------------------------------------------------------
def observations(trials: DataFrame, obs: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Observations with the same rows of ``cols`` have the same likelihoods: (pattern, cols..) rows of each distinct one,
    and (observation, pattern).  Materialised; an observation is all rows of one ``obs``, which may repeat.
    """
    row = F.struct(*cols, F.col("_k"))
    each = trials.groupBy(obs, *cols).agg(F.count(F.lit(1)).alias("_k")).groupBy(obs).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    each = cut_lineage(each)
    distinct = cut_lineage(each.groupBy("_rows").agg(F.count(F.lit(1)).alias("n")).withColumn("pattern", F.monotonically_increasing_id()))
    rows = distinct.select("pattern", F.explode("_rows").alias("_r")).select(
        "pattern", *(F.col(f"_r.{c}").alias(c) for c in cols), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_r._k"))).alias("_i")).drop("_i")
    return rows, each.join(distinct, "_rows").select(obs, "pattern")


# G18 / H14 -------------------------------------------------------------------
def waic_pointwise(loglik: DataFrame, obs_keys: Sequence[str], ll: str = "ll") -> DataFrame:
    """Per observation: lppd = logsumexp(ll) - ln S, p_waic = var(ll) over draws.

    Draws are summed map-side in bands of 512 log units, within which exp() cannot vanish; an observation's few
    bands are then put together, so trials x draws rows are neither shuffled nor joined to their maximum.
    """
    bands = loglik.withColumn("_top", F.ceil(F.col(ll) / 512) * 512.0).groupBy(*obs_keys, "_top").agg(
        F.sum(F.exp(F.col(ll) - F.col("_top"))).alias("_e"), F.count(F.lit(1)).alias("_n"),
        F.avg(ll).alias("_a"), F.var_pop(ll).alias("_v"))
    obs = Window.partitionBy(*obs_keys)
    bands = bands.withColumns({"_m": F.max("_top").over(obs),
                               "_mean": F.sum(F.col("_n") * F.col("_a")).over(obs) / F.sum("_n").over(obs)})
    spread = F.sum(F.col("_n") * (F.col("_v") + (F.col("_a") - F.col("_mean")) ** 2))
    n = F.sum("_n")
    return bands.groupBy(*obs_keys).agg(
        (F.max("_m") + F.ln(F.sum(F.col("_e") * F.exp(F.col("_top") - F.col("_m")))) - F.ln(n.cast("double"))).alias("lppd"),
        F.when(n > 1, spread / (n - 1)).alias("p_waic"))


def waic(loglik: DataFrame, obs_keys: Sequence[str], ll: str = "ll", model_key: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """Sums over observations; with ``counts`` (observation keys, n) each stands for ``n`` of them."""
    pw = waic_pointwise(loglik, [*model_key, *obs_keys], ll)
    pw = pw.withColumn("n", F.lit(1)) if counts is None else pw.join(counts, list(obs_keys))
    lppd, p_waic = F.sum(F.col("n") * F.col("lppd")), F.sum(F.col("n") * F.col("p_waic"))
    return pw.groupBy(*model_key).agg(
        lppd.alias("lppd"), p_waic.alias("p_waic"), (lppd - p_waic).alias("elpd_waic"),
        (F.lit(-2.0) * (lppd - p_waic)).alias("waic"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_obs"))


# G19 -------------------------------------------------------------------------
def loo_stats(pred: DataFrame, obs_keys: Sequence[str], ll: str = "ll") -> DataFrame:
    """Per observation, of the weights exp(-ll): the log of their mean and the number of draws, in one aggregate.

    Weights are summed map-side in bands of 512 log units, as in ``waic_pointwise``.
    """
    lw = -F.col(ll)
    bands = pred.withColumn("_top", F.ceil(lw / 512) * 512.0).groupBy(*obs_keys, "_top").agg(
        F.sum(F.exp(lw - F.col("_top"))).alias("_e"), F.count(F.lit(1)).alias("_n"))
    bands = bands.withColumn("_m", F.max("_top").over(Window.partitionBy(*obs_keys)))
    s = F.sum("_n")
    return bands.groupBy(*obs_keys).agg(
        (F.max("_m") + F.ln(F.sum(F.col("_e") * F.exp(F.col("_top") - F.col("_m")))) - F.ln(s.cast("double"))).alias("log_mean_w"), s.alias("n_draws"))


def loo_share(pred: DataFrame, obs_keys: Sequence[str], y: str, ll: str = "ll", prediction: str = "prediction") -> DataFrame:
    """LOO-PIT of rows that carry their observation's ``loo_stats``: weights in units of their mean, truncated at sqrt(S)."""
    if isinstance(pred, Blocks):
        def sums(p: Pairs) -> dict[str, np.ndarray]:
            w = np.fmin(np.exp(-p[ll] - p["log_mean_w"]), np.sqrt(p["n_draws"].astype(float)))  # where there is no weight, sqrt(S)
            below = (p[prediction] <= p[y]) | np.isnan(p[y])
            null = p.null(prediction, y)
            below = below if null is False else below & ~null
            return {"_below": np.where(below, w, 0.0).sum(axis=1), "_w": w.sum(axis=1)}
        return per_trial(pred, obs_keys, sums, ["_below", "_w"]).groupBy(*obs_keys).agg((F.sum("_below") / F.sum("_w")).alias("loo_pit"))
    w = F.least(F.exp(-F.col(ll) - F.col("log_mean_w")), F.sqrt(F.col("n_draws").cast("double")))
    return pred.withColumn("_w", w).groupBy(*obs_keys).agg(
        (F.sum(F.when(F.col(prediction) <= F.col(y), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("loo_pit"))


def loo_pit(pred: DataFrame, obs_keys: Sequence[str], y: str, ll: str = "ll", prediction: str = "prediction") -> DataFrame:
    """Importance-weighted LOO-PIT of a stored table of predictions: weights 1/p(y|draw), truncated at sqrt(S) * mean
    weight, then the weighted share of predictions <= y.  Where predictions are computed from trials, give the trials
    their ``loo_stats`` before they unfold into draws, and take ``loo_share``."""
    return loo_share(pred.join(loo_stats(pred, obs_keys, ll), list(obs_keys)), obs_keys, y, ll, prediction)


# G20 -----------------------------------------------------------------------
def rhat(draws: DataFrame, chain: str = "chain", order: str = "draw", value: str = "beta", keys=("term",)) -> DataFrame:
    """Split R-hat per term: chains halved in draw order, then within / between variances."""
    d = ranks.running(draws.select(*keys, chain, order, value), [*keys, chain], [order])
    d = d.withColumns({"_i": F.col("_before") + 1, "_n": F.col("_total")})
    d = d.withColumn("_half", (F.col("_i") > F.col("_n") / 2).cast("int")).filter(
        ~((F.col("_n") % 2 == 1) & (F.col("_i") == (F.col("_n") + 1) / 2)))
    per = d.groupBy(*keys, chain, "_half").agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"),
                                               F.count(F.lit(1)).alias("_k"))
    agg = per.groupBy(*keys).agg(F.avg("_v").alias("W"), F.var_samp("_m").alias("_bm"), F.min("_k").alias("_k"))
    nn = F.col("_k").cast("double")
    var_plus = (nn - 1) / nn * F.col("W") + F.col("_bm")
    return agg.select(*keys, F.sqrt(var_plus / F.col("W")).alias("rhat"))


# G21 -----------------------------------------------------------------------
def tally_predictions(pred: DataFrame | Blocks, category: Column | Callable[[Pairs], np.ndarray], keys: Sequence[str] = (),
                      prediction: str = "prediction") -> DataFrame:
    """Rows of each (keys, draw, category). Of ``Blocks``, ``category`` is taken of the pairs, and null where ``prediction`` is."""
    if isinstance(pred, Blocks):
        if keys:
            raise ValueError("blocks are tallied by draw and category only")
        return per_draw(pred, category, prediction).groupBy("draw", "category").agg(F.sum("n").alias("n"))
    return pred.withColumn("category", category).groupBy(*keys, "draw", "category").agg(F.count(F.lit(1)).alias("n"))
