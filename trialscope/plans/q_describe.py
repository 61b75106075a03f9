"""Queries for joins (C), aggregates (D) and windows / reshaping (E)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialscope.functions.normal import plogis, qnorm_sql
from trialscope.operators import aggregates as D
from trialscope.operators import clean as B
from trialscope.operators import joins as C
from trialscope.operators import ranks
from trialscope.operators import reshape as E
from trialscope.plans.registry import query
from trialscope.plans.sqltext import with_ctes
from trialscope.sources import fixtures as X

SI = "((p_award_with - p_award_without) > 1.0/award_value)"
CORR = f"(intervene = CAST({SI} AS INT))"
ERR = "(ground_truth*100 - p_superiority)"


def rnd(cols: str) -> str:
    return ", ".join(f"round_even({c}, 6) AS {c}" for c in cols.split())


def r6(expr: str, name: str) -> str:
    return f"round_even({expr}, 6) AS {name}"


def T(spark, sf):
    t = B.clean_trials(X.responses(spark, sf))
    t = B.errors(t).withColumn("should_intervene", B.should_intervene())
    return t.withColumn("correct", B.correct())


def OP(spark, sf):
    """OP chain with exclusion flags (window over each worker's trials), checks still in."""
    return D.with_exclusions(B.op_trials(X.responses(spark, sf)))


def M(spark, sf):
    return B.model_table(X.responses(spark, sf))


def S(spark, sf):
    return X.strategies(spark, sf)


# D -------------------------------------------------------------------------
@query("D1_decision_rates", with_ctes(
    f"SELECT means, condition, {rnd('ground_truth')}, {r6('sum(CAST(intervene = 1 AS INT))/count(*)', 'proportion_intervene')}, "
    f"{r6(f'avg(CAST({SI} AS DOUBLE))', 'optimal_decision')} FROM trials GROUP BY ALL", "trials"))
def d1(spark, sf):
    return D.decision_rates(T(spark, sf), ["means", "condition", "ground_truth"])


@query("D2_decision_by_answer", with_ctes(
    f"SELECT means, condition, {rnd('p_superiority')}, {r6('sum(CAST(intervene = 1 AS INT))/count(*)', 'proportion_intervene')} "
    "FROM trials GROUP BY ALL", "trials"))
def d2(spark, sf):
    return D.decision_by_answer(T(spark, sf))


@query("D3_correct_by_duration", with_ctes(
    f"SELECT condition, {rnd('baseline')}, {r6('round_even(trial_dur, 0)', 'trial_dur_binned')}, "
    f"{r6(f'sum(CAST({CORR} AS INT))/count(*)', 'proportion_correct')} FROM trials "
    "GROUP BY condition, baseline, round_even(trial_dur, 0)", "trials"))
def d3(spark, sf):
    return D.correct_by_duration(T(spark, sf))


@query("D4_mean_abs_error", with_ctes(
    f"SELECT means, condition, {r6(f'avg(abs({ERR}))', 'avg_abs_err_p_sup')} FROM trials GROUP BY ALL", "trials"))
def d4(spark, sf):
    return D.mean_abs_error(T(spark, sf), ["means", "condition"])


@query("D5_mean_error", with_ctes(
    f"SELECT {rnd('ground_truth')}, means, condition, {r6(f'avg({ERR})', 'avg_err_p_sup')} FROM trials "
    "WHERE ground_truth > 0.5 AND ground_truth < 0.999 GROUP BY ALL", "trials"))
def d5(spark, sf):
    return D.mean_error(B.drop_checks(T(spark, sf)))


@query("D6_prop_correct", with_ctes(
    f"SELECT {rnd('ground_truth')}, exclude, {r6(f'sum(CAST({CORR} AS INT))/count(*)', 'proportion_correct')} FROM op_excl "
    "WHERE ground_truth > 0.5 AND ground_truth < 0.999 GROUP BY ALL", "op_excl"))
def d6(spark, sf):
    t = B.drop_checks(OP(spark, sf)).withColumn("should_intervene", B.should_intervene())
    return D.prop_correct(t.withColumn("correct", B.correct()), ["ground_truth", "exclude"])


@query("D7_mean_answer", with_ctes(
    f"SELECT {rnd('ground_truth')}, exclude, {r6('avg(p_superiority)', 'avg_p_sup')} FROM op_excl "
    "WHERE ground_truth > 0.5 AND ground_truth < 0.999 GROUP BY ALL", "op_excl"))
def d7(spark, sf):
    return D.mean_answer(B.drop_checks(OP(spark, sf)))


@query("D8_mean_error_reflected", with_ctes(
    f"SELECT {r6('CASE WHEN ground_truth < 0.5 THEN 1.0 - ground_truth ELSE ground_truth END', 'ground_truth_50_100')}, "
    f"condition, CASE WHEN ground_truth > 0.5 THEN 'gain' ELSE 'loss' END AS framing, {r6(f'avg({ERR})', 'avg_err_p_sup')} "
    "FROM framed GROUP BY 1, 2, 3", "framed"))
def d8(spark, sf):
    return D.mean_error_reflected(B.errors(B.framed(B.clean_trials(X.responses(spark, sf)))))


@query("D9_worker_quality", with_ctes(
    "SELECT worker_id, CAST(sum(CAST((ground_truth = 0.5 AND intervene <> 0) OR (ground_truth = 0.999 AND intervene <> 1) AS INT)) AS BIGINT) "
    "AS failed_attention_checks, count(DISTINCT p_superiority) + max(CAST(p_superiority IS NULL AS INT)) AS unique_p_sup, "
    "(count(DISTINCT intervene) + max(CAST(intervene IS NULL AS INT))) = 1 AS speeding_intervene, "
    f"{r6('sum(CAST(p_superiority < 50 AS INT))/count(*)', 'p_sup_less_than_50')} FROM trials GROUP BY worker_id", "trials"))
def d9(spark, sf):
    return D.worker_quality(B.clean_trials(X.responses(spark, sf)))


@query("D10_exclusions", with_ctes(
    "SELECT worker_id, failed_attention_checks > 0 OR unique_p_sup < 3 AS exclude FROM op_flags", "op_flags"))
def d10(spark, sf):
    return D.exclusions(B.op_trials(X.responses(spark, sf)))


@query("D11_exclusion_rates", with_ctes(
    "SELECT condition, count(*) AS total_participants, CAST(sum(CAST(passed AS INT)) AS BIGINT) AS final_sample, "
    f"{r6('(count(*) - sum(CAST(passed AS INT)))/count(*)', 'exclusion_rate')} FROM ("
    "SELECT worker_id, condition, sum(CAST((ground_truth = 0.5 AND intervene = 0) OR (ground_truth = 0.999 AND intervene = 1) AS INT)) = 2 "
    "AS passed FROM trials GROUP BY worker_id, condition) GROUP BY condition", "trials"))
def d11(spark, sf):
    return D.exclusion_rates(B.clean_trials(X.responses(spark, sf)))


@query("D12_workers_per_cell", with_ctes(
    "SELECT condition, start_means, count(DISTINCT worker_id) AS n_workers FROM model GROUP BY ALL", "model"))
def d12(spark, sf):
    return D.workers_per_cell(M(spark, sf))


@query("D13_missing_trials", with_ctes(
    "SELECT condition, start_means, worker_id, count(*) AS n_trials, 70 - count(*) AS dropped_trials FROM model "
    "GROUP BY ALL HAVING 70 - count(*) > 0", "model"))
def d13(spark, sf):
    return D.missing_trials(M(spark, sf), 70)


@query("D14_duplicate_trials", with_ctes(
    "SELECT n_duplicated, count(*) AS n_workers FROM (SELECT worker_id, CAST(sum(CAST(copies > 1 AS INT)) AS BIGINT) AS n_duplicated "
    "FROM (SELECT worker_id, ground_truth, sd_diff, count(*) AS copies FROM trials GROUP BY ALL) GROUP BY worker_id) "
    "GROUP BY n_duplicated", "trials"))
def d14(spark, sf):
    return D.duplicate_trials(B.clean_trials(X.responses(spark, sf)), ("worker_id", "ground_truth", "sd_diff"))


@query("D15_worker_profile", with_ctes(
    "SELECT worker_id, min(condition) AS condition, min(start_means) AS start_means, "
    "(min(condition) = max(condition)) AND (min(start_means) = max(start_means)) AS constant FROM trials GROUP BY worker_id",
    "trials"))
def d15(spark, sf):
    return D.worker_profile(B.clean_trials(X.responses(spark, sf)), ["condition", "start_means"])


@query("D16_distinct_keys", with_ctes(
    "SELECT DISTINCT condition, start_means, sd_diff, means FROM model", "model"))
def d16(spark, sf):
    return D.distinct_keys(M(spark, sf), ["condition", "start_means", "sd_diff", "means"])


@query("D17_code_share", with_ctes(
    "SELECT condition, CAST(sum(CAST(mentioned_mean = 'yes' AND answered AS INT)) AS BIGINT) AS count, "
    "CAST(sum(CAST(answered AS INT)) AS BIGINT) AS base, "
    + r6("CASE WHEN sum(CAST(answered AS INT)) = 0 THEN NULL ELSE sum(CAST(mentioned_mean = 'yes' AND answered AS INT)) "
         "/ sum(CAST(answered AS INT)) END", "share") + " "
    "FROM strategies GROUP BY condition", "strategies"))
def d17(spark, sf):
    s = S(spark, sf)
    return D.code_share(s, F.col("mentioned_mean") == "yes", F.col("answered"))


FLAGS = list(X.STRATEGY_CODES)


@query("D18_strategy_table", with_ctes(
    "SELECT CASE WHEN GROUPING(condition) = 1 THEN 'Overall' ELSE condition END AS condition, count(*) AS n, "
    + ", ".join(f"CAST(sum(CAST({f} = 'yes' AS INT)) AS BIGINT) AS {f}" for f in FLAGS)
    + " FROM strategies GROUP BY ROLLUP (condition)", "strategies"))
def d18(spark, sf):
    return D.strategy_table(S(spark, sf), FLAGS)


@query("D19_answer_rate", with_ctes(
    "SELECT b.condition, coalesce(a.n_answered, 0) AS n_answered, b.n_total, "
    f"{r6('coalesce(a.n_answered, 0) / b.n_total', 'answer_rate')} FROM "
    "(SELECT condition, count(*) AS n_answered FROM strategies WHERE answered GROUP BY condition) a "
    "FULL JOIN (SELECT condition, count(*) AS n_total FROM strategies GROUP BY condition) b USING (condition)", "strategies"))
def d19(spark, sf):
    return D.answer_rate(S(spark, sf))


BET = "CASE WHEN p_superiority*10 < 334 THEN 1 WHEN p_superiority*10 < 667 THEN 2 ELSE 3 END"


@query("D20_tally", with_ctes(
    f"SELECT condition, {BET} AS ordinal_bet, count(*) AS n FROM trials GROUP BY 1, 2", "trials"))
def d20(spark, sf):
    t = B.clean_trials(X.responses(spark, sf)).withColumn("ordinal_bet", B.ordinal_bet(F.col("p_superiority") * 10))
    return D.tally(t, ["condition", "ordinal_bet"])


@query("D21_collect_first", with_ctes(
    "SELECT worker_id, list(p_superiority ORDER BY trial) AS p_superiority FROM (SELECT worker_id, trial, p_superiority, "
    "row_number() OVER (PARTITION BY worker_id ORDER BY trial) AS rn FROM trials) WHERE rn <= 50 GROUP BY worker_id", "trials"))
def d21(spark, sf):
    return D.collect_first(B.clean_trials(X.responses(spark, sf)), ["worker_id"], ["trial"], "p_superiority", 50)


QS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("D22_quantiles", with_ctes(
    "SELECT condition, " + ", ".join(r6(f"quantile_cont(p_superiority, {p})", f"q{int(round(p * 1000)):03d}") for p in QS)
    + " FROM trials GROUP BY condition", "trials"))
def d22(spark, sf):
    return D.quantiles(B.clean_trials(X.responses(spark, sf)), "p_superiority", QS, ["condition"])


def _bands_sql():
    parts = []
    for w in (0.5, 0.8, 0.95):
        lo, hi = (1 - w) / 2, (1 + w) / 2
        parts.append(f"SELECT condition, {rnd('ground_truth')}, {r6('quantile_cont(p_superiority, 0.5)', 'p_superiority')}, "
                     f"{r6(f'quantile_cont(p_superiority, {lo!r})', 'lower')}, {r6(f'quantile_cont(p_superiority, {hi!r})', 'upper')}, "
                     f"{w}::DOUBLE AS width FROM trials GROUP BY condition, ground_truth")
    return " UNION ALL ".join(parts)


@query("D23_interval_bands", with_ctes(_bands_sql(), "trials"))
def d23(spark, sf):
    return D.interval_bands(B.clean_trials(X.responses(spark, sf)), "p_superiority", ["condition", "ground_truth"])


@query("D24_histogram", with_ctes(
    f"SELECT condition, {r6('floor(p_superiority / 5 + 0.5) * 5', 'bin')}, count(*) AS n, "
    f"{r6('count(*) / (sum(count(*)) OVER (PARTITION BY condition) * 5)', 'density')} FROM trials "
    "WHERE p_superiority IS NOT NULL GROUP BY condition, floor(p_superiority / 5 + 0.5) * 5", "trials"))
def d24(spark, sf):
    return D.histogram(B.clean_trials(X.responses(spark, sf)), "p_superiority", 5.0, ["condition"])


@query("D26_qq_table", with_ctes(
    f"SELECT condition, {r6('lo_p_sup', 'sample')}, "
    f"{r6(qnorm_sql('(i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / (n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END)'), 'theoretical')} "
    "FROM (SELECT condition, lo_p_sup, row_number() OVER (PARTITION BY condition ORDER BY lo_p_sup) AS i, "
    "count(*) OVER (PARTITION BY condition) AS n FROM model WHERE lo_p_sup IS NOT NULL)", "model"))
def d26(spark, sf):
    return D.qq_table(M(spark, sf), "lo_p_sup", ["condition"], "event_id")


EVID = ("(ln(p_award_with/(1.0-p_award_with)) - ln((p_award_without + 1.0/award_value)/"
        "(1.0-(p_award_without + 1.0/award_value))))")


@query("D27_above_threshold", with_ctes(
    f"SELECT condition, {r6(f'avg(CAST({EVID} > 0 AS DOUBLE))', 'share_above')} FROM trials GROUP BY condition", "trials"))
def d27(spark, sf):
    return D.above_threshold(B.evidence(B.clean_trials(X.responses(spark, sf))))


@query("D28_expected_category", with_ctes(
    f"SELECT condition, {r6('sum(ordinal_bet * p)', 'expected_category')} FROM (SELECT condition, ordinal_bet, "
    "count(*) / sum(count(*)) OVER (PARTITION BY condition) AS p FROM "
    f"(SELECT condition, {BET} AS ordinal_bet FROM trials) GROUP BY condition, ordinal_bet) GROUP BY condition", "trials"))
def d28(spark, sf):
    t = B.clean_trials(X.responses(spark, sf)).withColumn("category", B.ordinal_bet(F.col("p_superiority") * 10))
    shares = D.tally(t, ["condition", "category"]).withColumn(
        "p", F.col("n") / F.sum("n").over(Window.partitionBy("condition")))
    return D.expected_category(shares, ["condition"])


@query("D30_optimal_counts", with_ctes(
    f"SELECT condition, {rnd('ground_truth')}, sd_diff, CAST(sum(CAST({SI} AS INT)) AS BIGINT) AS n_optimal, count(*) AS n "
    "FROM trials GROUP BY ALL", "trials"))
def d30(spark, sf):
    return D.optimal_counts(T(spark, sf), ["condition", "ground_truth", "sd_diff"])


@query("D31_mean_of", with_ctes(f"SELECT {r6('avg(lo_p_sup)', 'mean_lo_p_sup')} FROM model", "model"))
def d31(spark, sf):
    return D.mean_of(M(spark, sf), "lo_p_sup")


@query("D32_wmean", with_ctes(
    f"SELECT condition, {r6('sum(n_trials * p_superiority) / sum(n_trials)', 'wmean_p_superiority')} FROM trials GROUP BY condition",
    "trials"))
def d32(spark, sf):
    return D.wmean(B.clean_trials(X.responses(spark, sf)), "p_superiority", ["condition"], weight="n_trials")


@query("D33_first_per_key", with_ctes(
    f"SELECT event_id, worker_id, {rnd('ground_truth')}, trial FROM (SELECT *, row_number() OVER "
    "(PARTITION BY worker_id, ground_truth ORDER BY trial) AS rn FROM trials) WHERE rn = 1", "trials"))
def d33(spark, sf):
    t = B.clean_trials(X.responses(spark, sf)).select("event_id", "worker_id", "ground_truth", "trial")
    return D.first_per_key(t, ["worker_id", "ground_truth"], ["trial"])


# C -------------------------------------------------------------------------
@query("C1_apply_exclusions", with_ctes("SELECT event_id, exclude FROM op_excl", "op_excl"))
def c1(spark, sf):
    """Per-worker flag table left-joined to the trials (the reference's two-step form)."""
    t = B.op_trials(X.responses(spark, sf))
    return D.apply_exclusions(t, D.exclusions(t)).select("event_id", "exclude")


@query("C3_rate_table", with_ctes(
    f"SELECT condition, {rnd('ground_truth')}, coalesce(a.n_over, 0) AS n_over, b.n FROM "
    "(SELECT condition, ground_truth, count(*) AS n_over FROM trials WHERE p_superiority > 50 AND intervene = 1 GROUP BY ALL) a "
    "FULL JOIN (SELECT condition, ground_truth, count(*) AS n FROM trials GROUP BY ALL) b USING (condition, ground_truth)", "trials"))
def c3(spark, sf):
    """A count and its base, which share their keys and rows: one conditional aggregate (``rate_table`` joins unlike tables)."""
    over = (F.col("p_superiority") > 50) & (F.col("intervene") == 1)
    return B.clean_trials(X.responses(spark, sf)).groupBy("condition", "ground_truth").agg(
        F.count_if(over).alias("n_over"), F.count(F.lit(1)).alias("n"))


@query("C4_drop_combinations", with_ctes(
    "SELECT event_id FROM trials t WHERE NOT EXISTS (SELECT 1 FROM trials r WHERE r.sd_diff = 15 AND r.ground_truth > 0.8 "
    "AND round_even(r.ground_truth * 1000, 0) = round_even(t.ground_truth * 1000, 0) AND r.sd_diff = t.sd_diff)", "trials"))
def c4(spark, sf):
    t = B.clean_trials(X.responses(spark, sf))
    remove = t.filter((F.col("sd_diff") == 15) & (F.col("ground_truth") > 0.8)).select("ground_truth", "sd_diff")
    return C.drop_combinations(t, remove, ["ground_truth", "sd_diff"]).select("event_id")


@query("C5_duplicate_counts", with_ctes(
    "SELECT g.worker_id, g.sd_diff, coalesce(p.n, 0) AS n_matches FROM "
    "(SELECT DISTINCT worker_id, unnest([5, 15]) AS sd_diff FROM trials) g LEFT JOIN "
    "(SELECT worker_id, sd_diff, count(*) AS n FROM trials GROUP BY ALL) p USING (worker_id, sd_diff)", "trials"))
def c5(spark, sf):
    t = B.clean_trials(X.responses(spark, sf))
    grid = C.group_grid(t, ["worker_id"], {"sd_diff": [5, 15]})
    return C.duplicate_counts(t, grid, ["worker_id", "sd_diff"]).select("worker_id", "sd_diff", "n_matches")


@query("C6_join_rounded", with_ctes(
    f"SELECT t.event_id, {r6('s.avg_p', 'avg_p_at_truth')} FROM trials t JOIN (SELECT "
    "round_even((1.0/(1.0+exp(-ln(ground_truth/(1.0-ground_truth))))) * 1000, 0) AS k, avg(p_superiority) AS avg_p FROM trials "
    "GROUP BY 1) s ON s.k = round_even(t.ground_truth * 1000, 0)", "trials"))
def c6(spark, sf):
    """Per-truth summaries keyed by a recomputed (inexact) truth, joined back on truth rounded to 3 digits."""
    t = B.clean_trials(X.responses(spark, sf))
    s = (B.log_odds(t).withColumn("truth_back", plogis("lo_ground_truth"))
         .groupBy(C.scaled_key("truth_back").alias("_k")).agg(F.avg("p_superiority").alias("avg_p_at_truth"))
         .withColumn("truth_back", F.col("_k") / 1000.0).drop("_k"))
    return C.join_rounded(t.select("event_id", "ground_truth"), s, "ground_truth", "truth_back", how="inner") \
        .select("event_id", "avg_p_at_truth")


@query("C8_join_checked", with_ctes(
    "SELECT t.condition, count(*) AS n, CAST(sum(CAST(t.ground_truth <> m.ground_truth OR t.sd_diff <> m.sd_diff AS INT)) AS BIGINT) "
    "AS mismatches FROM trials t JOIN model m USING (event_id) GROUP BY t.condition", "trials", "model"))
def c8(spark, sf):
    t = B.clean_trials(X.responses(spark, sf)).select("event_id", "condition", "ground_truth", "sd_diff")
    m = M(spark, sf).select("event_id", "ground_truth", "sd_diff")
    j = C.join_checked(t, m, ["event_id"], [("ground_truth", "ground_truth"), ("sd_diff", "sd_diff")])
    return j.groupBy("condition").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(F.col("_mismatch").cast("int")).cast("long").alias("mismatches"))


@query("C9_keep_workers", with_ctes(
    "SELECT event_id FROM trials WHERE worker_id IN (SELECT worker_id FROM op_excl WHERE NOT exclude)", "trials", "op_excl"))
def c9(spark, sf):
    t = B.clean_trials(X.responses(spark, sf))
    good = OP(spark, sf).filter(~F.col("exclude")).select("worker_id")
    return C.keep_workers(t, good).select("event_id")


@query("C10_replicate_rows", with_ctes(
    f"SELECT DISTINCT {rnd('ground_truth')}, sd_diff, unnest(range(1, 3)) AS copy FROM trials", "trials"))
def c10(spark, sf):
    cells = B.clean_trials(X.responses(spark, sf)).select("ground_truth", "sd_diff").distinct()
    return C.replicate_rows(cells, 2).withColumn("copy", F.col("copy").cast("long"))


@query("C11_full_grid", with_ctes(
    "SELECT c.condition, s.sd_diff, m.means FROM (SELECT DISTINCT condition FROM model) c, (SELECT DISTINCT sd_diff FROM model) s, "
    "(SELECT DISTINCT means FROM model) m", "model"))
def c11(spark, sf):
    return C.full_grid(M(spark, sf), ["condition", "sd_diff", "means"])


@query("C12_group_grid", with_ctes(
    "SELECT DISTINCT condition, sd_diff, unnest([0.0, 1.0]) AS lo_ground_truth FROM model", "model"))
def c12(spark, sf):
    return C.group_grid(M(spark, sf), ["condition", "sd_diff"], {"lo_ground_truth": [0.0, 1.0]})


@query("C13_range_grid", with_ctes(
    f"SELECT condition, {r6('CASE WHEN i = 19 THEN hi ELSE lo + i * (hi - lo) / 19 END', 'lo_ground_truth')} FROM "
    "(SELECT condition, min(lo_ground_truth) AS lo, max(lo_ground_truth) AS hi FROM model GROUP BY condition), "
    "(SELECT unnest(range(0, 20)) AS i)", "model"))
def c13(spark, sf):
    return C.range_grid(M(spark, sf), ["condition"], "lo_ground_truth", 20)


# E -------------------------------------------------------------------------
@query("E1_lag_by", with_ctes(
    f"SELECT event_id, {r6('coalesce(lag(p_superiority) OVER w, 50.0)', 'prev_p_superiority')}, "
    "coalesce(lag(intervene) OVER w, 0) AS prev_intervene FROM trials WINDOW w AS (PARTITION BY worker_id ORDER BY trial)", "trials"))
def e1(spark, sf):
    t = B.clean_trials(X.responses(spark, sf))
    t = t.select("event_id", "worker_id", "trial", "p_superiority", "intervene")
    t = ranks.lagged(t, ["worker_id"], ["trial"], ["p_superiority", "intervene"])
    return t.select("event_id", F.coalesce("prev_p_superiority", F.lit(50.0)).alias("prev_p_superiority"),
                    F.coalesce("prev_intervene", F.lit(0)).alias("prev_intervene"))


WORKER_ERR = f"SELECT condition, start_means, worker_id, avg(abs({ERR})) AS mae FROM model GROUP BY ALL"


@query("E2_top_n_per_group", with_ctes(
    f"SELECT condition, start_means, worker_id, {r6('mae', 'mae')} FROM (SELECT *, rank() OVER (PARTITION BY condition, start_means "
    f"ORDER BY mae DESC) AS r FROM ({WORKER_ERR})) WHERE r <= 2", "model"))
def e2(spark, sf):
    w = B.errors(M(spark, sf)).groupBy("condition", "start_means", "worker_id").agg(F.avg("abs_err_p_sup").alias("mae"))
    return E.top_n_per_group(w, ["condition", "start_means"], "mae", 2)


@query("E3_ranked", with_ctes(
    f"SELECT worker_id, condition, CAST(rank() OVER (PARTITION BY condition ORDER BY round_even(mae, 9)) AS INT) AS rank FROM ({WORKER_ERR})",
    "model"))
def e3(spark, sf):
    w = B.errors(M(spark, sf)).groupBy("condition", "start_means", "worker_id").agg(F.bround(F.avg("abs_err_p_sup"), 9).alias("mae"))
    return E.ranked(w, ["condition"], ["mae"]).select("worker_id", "condition", "rank")


@query("E4_arrange", with_ctes("SELECT worker_id, trial, event_id FROM trials ORDER BY worker_id, trial", "trials"))
def e4(spark, sf):
    return E.arrange(B.clean_trials(X.responses(spark, sf)).select("worker_id", "trial", "event_id"), "worker_id", "trial")


@query("E5_union_rows", with_ctes(
    f"SELECT condition, {r6(f'avg(abs({ERR}))', 'mae')} FROM trials GROUP BY condition UNION ALL "
    f"SELECT 'Overall' AS condition, {r6(f'avg(abs({ERR}))', 'mae')} FROM trials", "trials"))
def e5(spark, sf):
    t = B.errors(B.clean_trials(X.responses(spark, sf)))
    """Rows per condition and one over all: a rollup reads the trials once."""
    both = t.rollup("condition").agg(F.avg("abs_err_p_sup").alias("mae"), F.grouping("condition").alias("_all"))
    return both.select(F.when(F.col("_all") == 1, "Overall").otherwise(F.col("condition")).alias("condition"), "mae")


@query("E6_distinct", with_ctes(f"SELECT DISTINCT condition, {rnd('ground_truth')}, sd_diff FROM trials", "trials"))
def e6(spark, sf):
    return E.distinct_rows(B.clean_trials(X.responses(spark, sf)), ["condition", "ground_truth", "sd_diff"])


@query("E7_to_long", with_ctes(
    "SELECT worker_id, key, round_even(value, 6) AS value FROM (SELECT worker_id, "
    "CAST(sum(CAST((ground_truth = 0.5 AND intervene <> 0) OR (ground_truth = 0.999 AND intervene <> 1) AS INT)) AS DOUBLE) AS failed_attention_checks, "
    "CAST(count(DISTINCT p_superiority) AS DOUBLE) AS unique_p_sup, avg(p_superiority) AS mean_p_sup FROM trials GROUP BY worker_id) "
    "UNPIVOT (value FOR key IN (failed_attention_checks, unique_p_sup, mean_p_sup))", "trials"))
def e7(spark, sf):
    w = B.clean_trials(X.responses(spark, sf)).groupBy("worker_id").agg(
        F.sum(B.failed_check().cast("int")).cast("double").alias("failed_attention_checks"),
        F.countDistinct("p_superiority").cast("double").alias("unique_p_sup"),
        F.avg("p_superiority").alias("mean_p_sup"))
    return E.to_long(w, ["worker_id"])


@query("E8_to_wide", with_ctes(
    f"SELECT worker_id, {r6('avg(p_superiority) FILTER (WHERE sd_diff = 5)', 'sd_5')}, "
    f"{r6('avg(p_superiority) FILTER (WHERE sd_diff = 15)', 'sd_15')} FROM trials GROUP BY worker_id", "trials"))
def e8(spark, sf):
    m = B.clean_trials(X.responses(spark, sf)).groupBy("worker_id", "sd_diff").agg(F.avg("p_superiority").alias("avg_p"))
    return E.to_wide(m, ["worker_id"], "sd_diff", "avg_p", [5, 15]).withColumnsRenamed({"5": "sd_5", "15": "sd_15"})


@query("E9_unite", with_ctes(
    "SELECT event_id, condition || '_' || CASE WHEN means THEN 'true' ELSE 'false' END AS cell FROM trials", "trials"))
def e9(spark, sf):
    return E.unite(B.clean_trials(X.responses(spark, sf)), "cell", ["condition", "means"]).select("event_id", "cell")


@query("E10_unnest", with_ctes(
    f"SELECT worker_id, CAST(rn AS INT) AS pos, trial, {rnd('p_superiority')} FROM (SELECT worker_id, trial, p_superiority, "
    "row_number() OVER (PARTITION BY worker_id ORDER BY trial) AS rn FROM trials)", "trials"))
def e10(spark, sf):
    t = B.clean_trials(X.responses(spark, sf))
    lists = D.collect_chunks(t, ["worker_id"], ["trial"], ["trial", "p_superiority"])
    rows = E.unnest(lists, ["trial", "p_superiority"], pos="pos")
    return rows.select("worker_id", (F.col("offset") + F.col("pos")).alias("pos"), "trial", "p_superiority")


@query("E11_spread_draws", with_ctes(
    "SELECT vec_id AS draw, CAST(t.i AS INT) AS term, round_even(CAST(embedding[t.i] AS DOUBLE), 6) AS beta "
    "FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) t"))
def e11(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("draw"),
                                                F.col("embedding").cast("array<double>").alias("embedding"))
    return E.spread_draws(e, ["draw"], "embedding", "term", "beta")


@query("E12_for_each_level", with_ctes(
    f"SELECT condition, count(*) AS n, {r6('avg(p_superiority)', 'mean_p')}, {r6('stddev_samp(p_superiority)', 'sd_p')} "
    "FROM trials GROUP BY condition", "trials"))
def e12(spark, sf):
    return E.for_each_level(B.clean_trials(X.responses(spark, sf)), "condition", lambda: [
        F.count(F.lit(1)).alias("n"), F.avg("p_superiority").alias("mean_p"), F.stddev_samp("p_superiority").alias("sd_p")])
