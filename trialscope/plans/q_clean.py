"""Queries for sources (A) and cleaning operators (B)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialscope.operators import aggregates as D
from trialscope.operators import clean as B
from trialscope.plans.registry import query
from trialscope.plans.sqltext import with_ctes
from trialscope.sources import fixtures as X
from trialscope.sources import io as A

RESP_COLS = ("event_id worker_id trial n_trials trial_idx condition start_means sd_diff ground_truth "
             "p_superiority intervene payoff award_value baseline p_award_with p_award_without trial_dur").split()


def R(spark, sf):
    return X.responses(spark, sf)


def T(spark, sf):
    return B.clean_trials(X.responses(spark, sf))


def rnd(cols: str) -> str:
    return ", ".join(f"round_even({c}, 6) AS {c}" for c in cols.split())


# A -------------------------------------------------------------------------
@query("A1_read_trials", with_ctes(
    f"SELECT * REPLACE ({rnd('ground_truth p_superiority payoff award_value baseline p_award_with p_award_without trial_dur')}) FROM responses",
    "responses"))
def a1(spark, sf):
    """Events read with an explicit schema (FAILFAST), turned into the trial log."""
    ev = A.read_trials(spark, f"{sf}/events.parquet", A.EVENTS_SCHEMA, fmt="parquet")
    return X.responses_from_events(ev)


@query("A2_write_trials", with_ctes(
    f"SELECT event_id, worker_id, trial, condition, {rnd('p_superiority')} FROM trials", "trials"))
def a2(spark, sf):
    """Cleaned trials written as CSV to the shared scratch area and read back with the schema."""
    t = T(spark, sf).select("event_id", "worker_id", "trial", "condition", "p_superiority")
    path = A.write_trials(t, A.scratch_path(spark, "a2_trials"), fmt="csv")
    return A.read_trials(spark, path, t.schema, fmt="csv")


@query("A6_head", with_ctes(
    f"SELECT event_id, worker_id, trial, {rnd('p_superiority')} FROM trials ORDER BY worker_id, trial LIMIT 6", "trials"))
def a6(spark, sf):
    return A.head(T(spark, sf).select("event_id", "worker_id", "trial", "p_superiority"), ["worker_id", "trial"], 6)


# B -------------------------------------------------------------------------
@query("B1_to_snake", with_ctes(
    f"SELECT worker_id, ground_truth, sd_diff, {rnd('p_superiority')}, trial_idx FROM responses", "responses"))
def b1(spark, sf):
    camel = R(spark, sf).select(F.col("worker_id").alias("workerId"), F.col("ground_truth").alias("groundTruth"),
                                F.col("sd_diff").alias("sdDiff"), F.col("p_superiority").alias("pSup"),
                                F.col("trial_idx").alias("trialIdx"))
    renamed = B.to_snake(camel, {"pSup": "p_superiority"})
    return B.to_snake(renamed)


@query("B2_anonymize", with_ctes(
    "SELECT event_id, sha256(CAST(worker_id AS VARCHAR)) AS worker_id FROM responses", "responses"))
def b2(spark, sf):
    return B.anonymize(R(spark, sf).select("event_id", "worker_id"), strong=True)


@query("B3_drop_practice", with_ctes(
    "SELECT event_id, worker_id, trial, trial_idx FROM responses WHERE trial_idx NOT IN ('practice','mock')", "responses"))
def b3(spark, sf):
    return B.drop_practice(R(spark, sf).select("event_id", "worker_id", "trial", "trial_idx"))


@query("B4_nudge_bounds", with_ctes(
    "SELECT event_id, round_even(CASE WHEN p_superiority = 0 THEN 0.5 WHEN p_superiority = 100 THEN 99.5 "
    "ELSE p_superiority END, 6) AS p_superiority FROM responses", "responses"))
def b4(spark, sf):
    return R(spark, sf).select("event_id", B.nudge_bounds("p_superiority").alias("p_superiority"))


@query("B5_clamp", with_ctes(
    "SELECT event_id, round_even(CASE WHEN p_superiority IS NULL THEN NULL ELSE least(99.5, greatest(0.5, p_superiority)) END, 6)"
    " AS p_superiority FROM responses", "responses"))
def b5(spark, sf):
    return R(spark, sf).select("event_id", B.clamp("p_superiority", 0.5, 99.5).alias("p_superiority"))


@query("B6_drop_missing", with_ctes(
    f"SELECT event_id, {rnd('p_superiority')} FROM responses WHERE p_superiority IS NOT NULL", "responses"))
def b6(spark, sf):
    return B.drop_missing(R(spark, sf).select("event_id", "p_superiority"), "p_superiority")


@query("B7_repair_decision", with_ctes(
    "SELECT event_id, CASE WHEN intervene = -1 THEN CASE WHEN payoff = award_value - 1 OR payoff = -1 THEN 1 ELSE 0 END "
    "ELSE intervene END AS intervene FROM responses", "responses"))
def b7(spark, sf):
    return B.repair_decision(R(spark, sf)).select("event_id", "intervene")


@query("B8_means_shown", with_ctes("SELECT event_id, means FROM trials", "trials"))
def b8(spark, sf):
    return T(spark, sf).select("event_id", "means")


@query("B9_nonneg", with_ctes(
    "SELECT event_id, round_even(CASE WHEN trial_dur - 3600 < 0 THEN 0.0 ELSE trial_dur - 3600 END, 6) AS idle_dur FROM trials",
    "trials"))
def b9(spark, sf):
    """Idle time beyond one hour per trial, never negative."""
    return T(spark, sf).select("event_id", B.nonneg(F.col("trial_dur") - 3600).alias("idle_dur"))


@query("B10_flip_loss", with_ctes(
    "SELECT event_id, round_even(CASE WHEN ground_truth < 0.5 THEN 100.0 - p_superiority ELSE p_superiority END, 6) "
    "AS p_superiority FROM framed", "framed"))
def b10(spark, sf):
    return B.flip_loss(B.framed(T(spark, sf))).select("event_id", "p_superiority")


@query("B11_with_level", with_ctes(
    "SELECT event_id, CAST(CASE condition WHEN 'densities' THEN 1 WHEN 'intervals' THEN 2 WHEN 'HOPs' THEN 3 "
    "WHEN 'QDPs' THEN 4 END AS INT) AS condition_idx, CAST(dense_rank() OVER (ORDER BY sd_diff) AS INT) AS sd_diff_idx "
    "FROM trials", "trials"))
def b11(spark, sf):
    t = B.with_level(T(spark, sf), "condition", X.CONDITIONS)
    return B.with_level(t, "sd_diff").select("event_id", "condition_idx", "sd_diff_idx")


@query("B12_centre_trial", with_ctes(
    "SELECT event_id, round_even((trial - n_trials/2)/n_trials, 6) AS trial_c FROM trials", "trials"))
def b12(spark, sf):
    return B.centre_trial(T(spark, sf)).select("event_id", "trial_c")


@query("B13_log_odds", with_ctes(f"SELECT event_id, {rnd('lo_p_sup lo_ground_truth')} FROM model_lo", "model_lo"))
def b13(spark, sf):
    t = B.drop_missing(B.drop_practice(R(spark, sf)), "p_superiority").withColumn("p_superiority", B.clamp("p_superiority"))
    return B.log_odds(t).select("event_id", "lo_p_sup", "lo_ground_truth")


@query("B14_evidence", with_ctes(
    "SELECT event_id, round_even(p_award_with - p_award_without, 6) AS p_diff, "
    "round_even(ln(p_award_with/(1.0-p_award_with)) - ln((p_award_without + 1.0/award_value)/(1.0-(p_award_without + 1.0/award_value))), 6)"
    " AS evidence FROM trials", "trials"))
def b14(spark, sf):
    return B.evidence(T(spark, sf)).select("event_id", "p_diff", "evidence")


@query("B15_evidence_ratio", with_ctes(
    "SELECT event_id, round_even(CASE WHEN (p_award_with - p_award_without) * award_value > 0 "
    "THEN ln((p_award_with - p_award_without) * award_value) END, 6) AS evidence FROM trials", "trials"))
def b15(spark, sf):
    return T(spark, sf).select("event_id", B.evidence_ratio().alias("evidence"))


@query("B16_frame", with_ctes(
    "SELECT event_id, CASE WHEN ground_truth > 0.5 THEN 'gain' ELSE 'loss' END AS frame FROM framed", "framed"))
def b16(spark, sf):
    return B.framed(T(spark, sf)).select("event_id", B.frame().alias("frame"))


@query("B17_reflect_truth", with_ctes(
    "SELECT event_id, round_even(CASE WHEN ground_truth < 0.5 THEN 1.0 - ground_truth ELSE ground_truth END, 6) "
    "AS ground_truth_50_100 FROM framed", "framed"))
def b17(spark, sf):
    return B.framed(T(spark, sf)).select("event_id", B.reflect_truth().alias("ground_truth_50_100"))


@query("B18_starting_frame_only", with_ctes(
    "SELECT event_id, worker_id, trial FROM framed WHERE (start_gain_frame AND ground_truth > 0.5) "
    "OR (NOT start_gain_frame AND ground_truth < 0.5)", "framed"))
def b18(spark, sf):
    return B.starting_frame_only(B.framed(T(spark, sf))).select("event_id", "worker_id", "trial")


@query("B19_censor", with_ctes(
    "SELECT event_id, round_even(c, 6) AS p_sup_censored, CASE WHEN c IS NULL THEN NULL WHEN c = 50.5 THEN 'left' "
    "WHEN c = 99.5 THEN 'right' ELSE 'none' END AS censored FROM (SELECT event_id, CASE WHEN p_superiority < 50.5 THEN 50.5 "
    "WHEN p_superiority > 99.5 THEN 99.5 ELSE p_superiority END AS c FROM trials WHERE ground_truth > 0.5)", "trials"))
def b19(spark, sf):
    t = T(spark, sf).filter(F.col("ground_truth") > 0.5)
    return B.censor(t).select("event_id", "p_sup_censored", "censored")


@query("B20_ordinal_bet", with_ctes(
    "SELECT event_id, CASE WHEN p_superiority*10 < 334 THEN 1 WHEN p_superiority*10 < 667 THEN 2 ELSE 3 END AS ordinal_bet, "
    "CASE WHEN ground_truth < 0.34 THEN 1 WHEN ground_truth < 0.67 THEN 2 ELSE 3 END AS optimal_bet FROM trials", "trials"))
def b20(spark, sf):
    """Answers on a 0-1000 bet scale (answer x 10) binned into low / mid / high bets."""
    t = T(spark, sf)
    return t.select("event_id", B.ordinal_bet(F.col("p_superiority") * 10).alias("ordinal_bet"),
                    B.optimal_bin("ground_truth").alias("optimal_bet"))


@query("B21_bin_duration", with_ctes(
    "SELECT event_id, round_even(round_even(trial_dur, 0), 6) AS trial_dur_binned FROM trials", "trials"))
def b21(spark, sf):
    return T(spark, sf).select("event_id", B.bin_duration("trial_dur").alias("trial_dur_binned"))


@query("B22_errors", with_ctes(
    "SELECT event_id, round_even(ground_truth*100 - p_superiority, 6) AS err_p_sup, "
    "round_even(abs(ground_truth*100 - p_superiority), 6) AS abs_err_p_sup FROM trials", "trials"))
def b22(spark, sf):
    return B.errors(T(spark, sf)).select("event_id", "err_p_sup", "abs_err_p_sup")


@query("B23_should_intervene", with_ctes(
    "SELECT event_id, (p_award_with - p_award_without) > 1.0/award_value AS should_intervene FROM trials", "trials"))
def b23(spark, sf):
    return T(spark, sf).select("event_id", B.should_intervene().alias("should_intervene"))


@query("B24_should_intervene_framed", with_ctes(
    "SELECT event_id, CASE WHEN ground_truth > 0.5 THEN (p_award_without + 1.0/award_value) < p_award_with "
    "ELSE ((1.0 - p_award_without) - 1.0/award_value) > (1.0 - p_award_with) END AS should_intervene FROM framed", "framed"))
def b24(spark, sf):
    return B.framed(T(spark, sf)).select("event_id", B.should_intervene_framed().alias("should_intervene"))


@query("B25_correct", with_ctes(
    "SELECT event_id, intervene = CAST((p_award_with - p_award_without) > 1.0/award_value AS INT) AS correct FROM trials", "trials"))
def b25(spark, sf):
    t = T(spark, sf).withColumn("should_intervene", B.should_intervene())
    return t.select("event_id", B.correct().alias("correct"))


@query("B26_check_flags", with_ctes(
    "SELECT event_id, (ground_truth = 0.5 AND intervene <> 0) OR (ground_truth = 0.999 AND intervene <> 1) AS failed_check, "
    "(ground_truth = 0.5 AND intervene = 0) OR (ground_truth = 0.999 AND intervene = 1) AS passed_check FROM trials", "trials"))
def b26(spark, sf):
    return T(spark, sf).select("event_id", B.failed_check().alias("failed_check"), B.passed_check().alias("passed_check"))


@query("B27_drop_checks", with_ctes(
    f"SELECT event_id, {rnd('ground_truth')} FROM trials WHERE ground_truth > 0.5 AND ground_truth < 0.999", "trials"))
def b27(spark, sf):
    return B.drop_checks(T(spark, sf)).select("event_id", "ground_truth")


@query("B28_drop_ids", with_ctes(
    "SELECT event_id, worker_id FROM op_excl WHERE worker_id NOT IN (SELECT worker_id FROM op_excl WHERE exclude)", "op_excl"))
def b28(spark, sf):
    """Drop every trial of the excluded workers: a data-sized id list becomes an anti join."""
    t = B.op_trials(R(spark, sf))
    bad = D.exclusions(t).filter("exclude").select("worker_id")
    return B.drop_ids(t, bad).select("event_id", "worker_id")


@query("B29_normalise_codes", with_ctes(
    "SELECT doc_id, lower(lang) AS lang_code, lower(source) AS source_code FROM documents"))
def b29(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return B.normalise_codes(d, {"lang": "lang_code", "source": "source_code"}).select("doc_id", "lang_code", "source_code")


@query("B30_has_code", with_ctes(
    "SELECT doc_id, contains(lower(text), 'thing') AS mentioned_mean, "
    "contains(lower(text), 'thing') AND NOT contains(lower(text), 'nothing') AS mean_not_nothing, "
    "contains(lower(text), 'attion') AS mentioned_variance FROM documents"))
def b30(spark, sf):
    """Code flags in whole free texts; the 'and not' form is per row, as in the reference."""
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", B.has_code("text", "thing").alias("mentioned_mean"),
                    (B.has_code("text", "thing") & ~B.has_code("text", "nothing")).alias("mean_not_nothing"),
                    B.has_code("text", "attion").alias("mentioned_variance"))


@query("B31_transmute", with_ctes(
    "SELECT worker_id, round_even(ground_truth*100 - p_superiority, 6) AS err FROM trials", "trials"))
def b31(spark, sf):
    t = T(spark, sf)
    return B.transmute(t, worker_id=F.col("worker_id"), err=F.col("ground_truth") * 100 - F.col("p_superiority"))


@query("B32_bonus", with_ctes(
    "SELECT worker_id, round_even(sum(payoff), 6) AS account_value, round_even((sum(payoff) - 55) * 0.5, 6) AS bonus "
    "FROM trials GROUP BY worker_id", "trials"))
def b32(spark, sf):
    acc = T(spark, sf).groupBy("worker_id").agg(F.sum("payoff").alias("account_value"))
    return acc.withColumn("bonus", B.bonus("account_value", 55.0, 0.5))


@query("B33_condition_name", with_ctes(
    "SELECT DISTINCT sd_diff, round_even(ground_truth, 6) AS ground_truth, CAST(sd_diff AS VARCHAR) || '_sd_diff_' || "
    "CASE WHEN round_even(ground_truth, 3) = floor(round_even(ground_truth, 3)) THEN CAST(CAST(floor(round_even(ground_truth, 3)) AS BIGINT) AS VARCHAR) "
    "ELSE CAST(round_even(ground_truth, 3) AS VARCHAR) END || '_p_sup' AS condition_name FROM trials", "trials"))
def b33(spark, sf):
    cells = T(spark, sf).select("sd_diff", "ground_truth").distinct()
    return cells.withColumn("condition_name", B.condition_name("sd_diff", "ground_truth"))


@query("B34_slice_rows", with_ctes(
    "SELECT event_id, worker_id, trial FROM (SELECT event_id, worker_id, trial, "
    "row_number() OVER (PARTITION BY worker_id ORDER BY trial) AS rn, count(*) OVER (PARTITION BY worker_id) AS n FROM trials) "
    "WHERE rn >= 3 AND rn <= n - 2", "trials"))
def b34(spark, sf):
    t = T(spark, sf).select("event_id", "worker_id", "trial")
    return B.slice_rows(t, ["trial"], 3, 2, part=["worker_id"])


@query("B35_fill_defaults", with_ctes(
    "SELECT event_id, round_even(coalesce(lag(p_superiority) OVER (PARTITION BY worker_id ORDER BY trial), 50.0), 6) "
    "AS prev_p_sup FROM trials", "trials"))
def b35(spark, sf):
    w = Window.partitionBy("worker_id").orderBy("trial")
    t = T(spark, sf).withColumn("prev_p_sup", F.lag("p_superiority").over(w))
    return B.fill_defaults(t, {"prev_p_sup": 50.0}).select("event_id", "prev_p_sup")


@query("B36_add_global_max_abs", with_ctes(
    "SELECT event_id, round_even(ground_truth*100 - p_superiority, 6) AS err_p_sup, "
    "round_even(max(abs(ground_truth*100 - p_superiority)) OVER (), 6) AS max_abs_err_p_sup FROM trials", "trials"))
def b36(spark, sf):
    t = B.errors(T(spark, sf)).select("event_id", "err_p_sup")
    return B.add_global_max_abs(t, "err_p_sup")
