"""Cleaning, projections, filters and per-row derived columns.

Every operator is ``DataFrame -> DataFrame`` (or ``Column -> Column``) built from
built-in expressions, so Catalyst pushes the filters into the parquet scan and
whole-stage codegen fuses the projections.  NULL follows R where it matters:
``if_na`` keeps a missing condition missing instead of taking the else branch.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.functions.normal import _col, qlogis
from trialscope.operators import ranks


def if_na(cond: Column, yes, no) -> Column:
    """R ``if_else``: a NULL condition gives NULL, not the else branch (values, or Columns)."""
    v = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(cond.isNull(), None).when(cond, v(yes)).otherwise(v(no))


# B1 ------------------------------------------------------------------------
def snake(name: str) -> str:
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return s.lower()


def to_snake(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Rename camelCase columns to snake_case (or by an explicit map)."""
    mapping = dict(mapping) if mapping else {c: snake(c) for c in df.columns if snake(c) != c}
    return df.withColumnsRenamed(mapping)


# B2 ------------------------------------------------------------------------
def anonymize(df: DataFrame, col: str = "worker_id", strong: bool = False) -> DataFrame:
    """Stable pseudonym per id: 8 hex digits of crc32, or sha-256 when collisions matter."""
    b = F.col(col).cast("string").cast("binary")
    h = F.sha2(b, 256) if strong else F.lpad(F.lower(F.hex(F.crc32(b))), 8, "0")
    return df.withColumn(col, h)


# B3 ------------------------------------------------------------------------
def drop_practice(df: DataFrame, col: str = "trial_idx", labels: Iterable[str] = ("practice", "mock")) -> DataFrame:
    """Drop practice and mock trials (NULL labels dropped too, as ``filter`` in R)."""
    return df.filter(~F.col(col).isin(*labels))


# B4 ------------------------------------------------------------------------
def nudge_bounds(c, lo: float = 0.0, hi: float = 100.0, eps: float = 0.5) -> Column:
    """Move answers on a bound inward by ``eps``; NULL stays NULL."""
    c = _col(c)
    return F.when(c == lo, lo + eps).when(c == hi, hi - eps).otherwise(c)


# B5 ------------------------------------------------------------------------
def clamp(c, lo: float = 0.5, hi: float = 99.5) -> Column:
    """Clamp to [lo, hi] with a NULL guard (``least``/``greatest`` skip NULL)."""
    c = _col(c)
    return F.when(c.isNull(), None).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), c)))


# B6 ------------------------------------------------------------------------
def drop_missing(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols) or ["p_superiority"])


# B7 ------------------------------------------------------------------------
def repair_decision(df: DataFrame, framed: bool = False) -> DataFrame:
    """A lost decision (-1) is recovered from the payoff: paid for intervening means 1."""
    paid = (F.col("payoff") == F.col("award_value") - 1) | (F.col("payoff") == -1)
    if framed:  # gain / loss frames: losing the award costs the value instead
        paid = paid | (F.col("payoff") == -F.col("award_value") - 1)
    fixed = F.when(F.col("intervene") == -1, F.when(paid, 1).otherwise(0)).otherwise(F.col("intervene"))
    return df.withColumn("intervene", fixed.cast("int"))


# B8 ------------------------------------------------------------------------
def means_shown(start="start_means", trial="trial", n="n_trials", cut: float | None = None) -> Column:
    """Whether the chart of this trial showed means: first block if starting with means."""
    half = F.lit(cut) if cut is not None else _col(n) / 2
    s, t = _col(start), _col(trial)
    return (s & (t <= half)) | (~s & (t > half))


# B9 ------------------------------------------------------------------------
def nonneg(c) -> Column:
    c = _col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


# B10 -----------------------------------------------------------------------
def flip_loss(df: DataFrame, answer: str = "p_superiority", truth: str = "ground_truth") -> DataFrame:
    """In the loss frame (truth < .5) answers are given for the other team: 100 - x."""
    return df.withColumn(answer, F.when(F.col(truth) < 0.5, F.lit(100.0) - F.col(answer)).otherwise(F.col(answer)))


# B11 -----------------------------------------------------------------------
def level_index(c, levels: list) -> Column:
    """1-based position of a value in an ordered level list (0 when absent, NULL when NULL)."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c)).cast("int")


def with_level(df: DataFrame, col: str, levels: list | None = None, out: str | None = None) -> DataFrame:
    """Ordered factor code: listed levels keep their order; otherwise the place among the sorted distinct values.

    The listed form is a pure expression. The other joins a dictionary that is numbered by ranges, so a column may have any
    number of values. NULL has no code.
    """
    out = out or f"{col}_idx"
    if levels is not None:
        return df.withColumn(out, level_index(col, levels))
    return df.join(dictionary(df, col, out).withColumn(out, (F.col(out) + 1).cast("int")), col, "left")


def dictionary(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(col, out): the distinct values of a column, NULL left out, numbered from 0 in their order."""
    return ranks.ordered(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], out)


# B12 -----------------------------------------------------------------------
def centre_trial(df: DataFrame, trial: str = "trial", n: str = "n_trials", out: str = "trial_c") -> DataFrame:
    return df.withColumn(out, (F.col(trial) - F.col(n) / 2) / F.col(n))


# B13 -----------------------------------------------------------------------
def log_odds(df: DataFrame, answer: str = "p_superiority", truth: str = "ground_truth") -> DataFrame:
    return df.withColumns({"lo_p_sup": qlogis(F.col(answer) / 100.0), "lo_ground_truth": qlogis(truth)})


# B14 -----------------------------------------------------------------------
def evidence(df: DataFrame) -> DataFrame:
    """Evidence for intervening in log odds, and the raw probability difference."""
    return df.withColumns({
        "p_diff": F.col("p_award_with") - F.col("p_award_without"),
        "evidence": qlogis("p_award_with") - qlogis(F.col("p_award_without") + F.lit(1.0) / F.col("award_value")),
    })


# B15 -----------------------------------------------------------------------
def evidence_ratio(p_new="p_award_with", p_old="p_award_without", value="award_value") -> Column:
    """ln((p_new - p_old) * value); NULL when the difference is not positive."""
    d = (_col(p_new) - _col(p_old)) * _col(value)
    return F.when(d > 0, F.ln(d))


# B16 -----------------------------------------------------------------------
def frame(truth="ground_truth") -> Column:
    return F.when(_col(truth) > 0.5, "gain").otherwise("loss")


# B17 -----------------------------------------------------------------------
def reflect_truth(truth="ground_truth") -> Column:
    t = _col(truth)
    return F.when(t < 0.5, F.lit(1.0) - t).otherwise(t)


# B18 -----------------------------------------------------------------------
def starting_frame_only(df: DataFrame, start: str = "start_gain_frame", truth: str = "ground_truth") -> DataFrame:
    return df.filter((F.col(start) & (F.col(truth) > 0.5)) | (~F.col(start) & (F.col(truth) < 0.5)))


# B19 -----------------------------------------------------------------------
def censor(df: DataFrame, col: str = "p_superiority", lo: float = 50.5, hi: float = 99.5,
           out: str = "p_sup_censored") -> DataFrame:
    c = F.col(col)
    v = F.when(c < lo, lo).when(c > hi, hi).otherwise(c)
    code = F.when(v.isNull(), None).when(v == lo, "left").when(v == hi, "right").otherwise("none")
    return df.withColumns({out: v, "censored": code})


# B20 -----------------------------------------------------------------------
def ordinal_bet(bet="bet", cuts=(334, 667)) -> Column:
    if isinstance(bet, np.ndarray):
        return np.where(bet < cuts[0], 1, np.where(bet < cuts[1], 2, 3))
    b = _col(bet)
    return F.when(b < cuts[0], 1).when(b < cuts[1], 2).when(b.isNotNull(), 3)


def optimal_bin(truth="ground_truth", cuts=(0.34, 0.67)) -> Column:
    return ordinal_bet(truth, cuts)


# B21 -----------------------------------------------------------------------
def bin_duration(c="trial_dur") -> Column:
    """Round half to even, as R ``round``."""
    return F.bround(_col(c), 0)


# B22 -----------------------------------------------------------------------
def errors(df: DataFrame, truth: str = "ground_truth", answer: str = "p_superiority", scale: float = 100.0) -> DataFrame:
    err = F.col(truth) * scale - F.col(answer)
    return df.withColumns({"err_p_sup": err, "abs_err_p_sup": F.abs(err)})


# B23 -----------------------------------------------------------------------
def should_intervene(p_with="p_award_with", p_without="p_award_without", value="award_value") -> Column:
    """Utility-optimal rule: the gain in award probability beats the cost ratio."""
    return (_col(p_with) - _col(p_without)) > F.lit(1.0) / _col(value)


# B24 -----------------------------------------------------------------------
def should_intervene_framed(truth="ground_truth", p_new="p_award_with", p_old="p_award_without",
                            value="award_value") -> Column:
    gain = (_col(p_old) + F.lit(1.0) / _col(value)) < _col(p_new)
    loss = ((F.lit(1.0) - _col(p_old)) - F.lit(1.0) / _col(value)) > (F.lit(1.0) - _col(p_new))
    return F.when(_col(truth) > 0.5, gain).otherwise(loss)


# B25 -----------------------------------------------------------------------
def correct(decision="intervene", rule="should_intervene") -> Column:
    return _col(decision) == _col(rule).cast("int")


# B26 -----------------------------------------------------------------------
def failed_check(truth="ground_truth", decision="intervene", lo: float = 0.5, hi: float = 0.999) -> Column:
    """Attention checks: never intervene at truth .5, always at .999."""
    t, d = _col(truth), _col(decision)
    return ((t == lo) & (d != 0)) | ((t == hi) & (d != 1))


def passed_check(truth="ground_truth", decision="intervene", lo: float = 0.5, hi: float = 0.999) -> Column:
    t, d = _col(truth), _col(decision)
    return ((t == lo) & (d == 0)) | ((t == hi) & (d == 1))


# B27 -----------------------------------------------------------------------
def drop_checks(df: DataFrame, truth: str = "ground_truth", lo: float = 0.5, hi: float = 0.999) -> DataFrame:
    """Keep 0.5 < truth < 0.999: a range predicate the parquet reader can use."""
    return df.filter((F.col(truth) > lo) & (F.col(truth) < hi))


# B28 -----------------------------------------------------------------------
def keep_ids(df: DataFrame, ids, col: str = "worker_id") -> DataFrame:
    """Keep rows whose id is listed; a DataFrame of ids becomes a semi join."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(list(ids)))


def drop_ids(df: DataFrame, ids, col: str = "worker_id") -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_anti")
    ids = list(ids)
    return df.filter(~F.col(col).isin(ids)) if ids else df


# B29 -----------------------------------------------------------------------
def normalise_codes(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Lower-case coded answers and copy them to short column names."""
    return df.withColumns({short: F.lower(F.col(src)) for src, short in cols.items()})


# B30 -----------------------------------------------------------------------
def has_code(text, code: str) -> Column:
    """``str_detect`` of a literal code in a lower-cased text."""
    return F.lower(_col(text)).contains(code.lower())


# B31 -----------------------------------------------------------------------
def transmute(df: DataFrame, **exprs: Column) -> DataFrame:
    """Keep only the new columns (dplyr ``transmute``)."""
    return df.select(*[e.alias(k) for k, e in exprs.items()])


# B32 -----------------------------------------------------------------------
def bonus(value="account_value", cutoff: float = 55.0, rate: float = 0.5) -> Column:
    return (_col(value) - cutoff) * rate


# B33 -----------------------------------------------------------------------
def condition_name(sd_diff="sd_diff", p="p_superiority") -> Column:
    """``<sd>_sd_diff_<p rounded to 3>_p_sup`` (R prints numbers without trailing zeros)."""
    return F.concat_ws("_", _num_text(sd_diff), F.lit("sd_diff"), _num_text(F.bround(_col(p), 3)), F.lit("p_sup"))


def _num_text(c) -> Column:
    """Number as R ``paste`` prints it: integers without a decimal point."""
    c = _col(c)
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


# B34 -----------------------------------------------------------------------
def slice_rows(df: DataFrame, order: list, first: int, from_end: int, part: list | None = None) -> DataFrame:
    """Rows ``first .. n - from_end`` by position in an explicit order, per partition key."""
    w = Window.partitionBy(*(part or [])).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*(part or [])))
    return (df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
            .filter((F.col("_rn") >= first) & (F.col("_rn") <= F.col("_n") - from_end)).drop("_rn", "_n"))


# B35 -----------------------------------------------------------------------
def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# B36 -----------------------------------------------------------------------
def add_global_max_abs(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add ``max(abs(col))`` over the whole table to every row.

    A window over all rows would pull the table into one task; a scalar subquery runs the
    (partial, then final) aggregate as its own job and folds the value in as a constant.
    """
    out = out or f"max_abs_{col}"
    m = df.agg(F.max(F.abs(F.col(col))))
    return df.withColumn(out, m.scalar())


# Pipelines -------------------------------------------------------------------
def clean_trials(responses: DataFrame) -> DataFrame:
    """The exploratory cleaning chain: B3 -> B4 -> B6 -> B7 -> B8."""
    df = drop_practice(responses)
    df = drop_missing(df.withColumn("p_superiority", nudge_bounds("p_superiority")), "p_superiority")
    df = repair_decision(df)
    return df.withColumn("means", means_shown())


def op_trials(responses: DataFrame) -> DataFrame:
    """The overall-performance chain: practice dropped and decisions repaired, answers untouched."""
    return repair_decision(drop_practice(responses))


def framed(trials: DataFrame) -> DataFrame:
    """Gain/loss stand-in: the block without means is shown in the loss frame, where the
    truth is reported for the other team (1 - truth) and so is the answer (100 - answer)."""
    gain = means_shown()
    return trials.select(
        "event_id", "worker_id", "trial", "n_trials", "condition", "sd_diff",
        F.col("start_means").alias("start_gain_frame"),
        F.when(gain, F.col("ground_truth")).otherwise(F.lit(1.0) - F.col("ground_truth")).alias("ground_truth"),
        F.when(gain, F.col("p_superiority")).otherwise(F.lit(100.0) - F.col("p_superiority")).alias("p_superiority"),
        "intervene", "payoff", "award_value", "baseline", "p_award_with", "p_award_without")


def model_table(responses: DataFrame, listed=(), keep_excluded: bool = False) -> DataFrame:
    """The modelling chain: clean, clamp to [.5, 99.5], log odds, centred trial, exclusions, no checks."""
    from trialscope.operators.aggregates import with_exclusions
    df = repair_decision(drop_missing(drop_practice(responses), "p_superiority"))
    df = df.withColumns({"means": means_shown(), "p_superiority": clamp("p_superiority")})
    df = with_exclusions(centre_trial(log_odds(df)), listed)
    df = df if keep_excluded else df.filter(~F.col("exclude"))
    return drop_checks(df)
