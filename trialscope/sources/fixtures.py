"""Stand-in tables built from the driver tables (see FIXTURES.md part 2).

The reference's trial logs are not public, so the trial table is derived from
``events`` with deterministic rules: one worker per ``user_id``, one trial per
event in time order.  Every column is a pure expression of the input row plus
per-worker windows, so the work grows with ``events``.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialscope.functions.normal import with_pnorm, with_qnorm

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The four display conditions of the experiment, in display order.
CONDITIONS = ["densities", "intervals", "HOPs", "QDPs"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial log: one row per worker x trial (FIXTURES.md 2.1 plus derived columns)."""
    return responses_from_events(table(spark, sf_dir, "events"))


def responses_from_events(events: DataFrame) -> DataFrame:
    """One shuffle by worker (the trial-order window); everything else is row-local."""
    ev = events.select("event_id", "user_id", "event_type", "value", "ts")
    by_worker = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lv = (F.col("event_id") % 10).cast("int")
    e = (ev.withColumn("trial", F.row_number().over(by_worker))
         .withColumn("n_trials", F.count(F.lit(1)).over(Window.partitionBy("user_id")).cast("int"))
         .withColumn("prev_ts", F.lag("ts").over(by_worker))
         .withColumn("lv", lv))
    gt = (F.when(F.col("lv") == 0, 0.5).when(F.col("lv") == 9, 0.999)
          .otherwise(F.lit(0.55) + F.lit(0.05) * F.col("lv")))
    cond = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), (F.col("user_id") % 4 + 1).cast("int"))
    b = e.select(
        "event_id", "user_id", "event_type", "value", "ts", "trial", "n_trials", "prev_ts", "lv",
        gt.cast("double").alias("ground_truth"),
        cond.alias("condition"),
        ((F.floor(F.col("user_id") / 4) % 2) == 0).alias("start_means"),
        F.when(F.floor(F.col("event_id") / 10) % 2 == 0, 5).otherwise(15).alias("sd_diff"),
    )
    p_sup = (F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("double"))
             .when(F.col("event_id") % 31 == 0, 0.0)
             .when(F.col("event_id") % 37 == 0, 100.0)
             .otherwise(F.least(F.lit(100.0), F.greatest(
                 F.lit(0.0), F.floor(F.lit(0.6) * 100 * F.col("ground_truth") + F.col("value") / 10.0).cast("double")))))
    intervene = (F.when((F.col("lv") == 0) & (F.col("user_id") % 3 != 0), 0)
                 .when((F.col("lv") == 9) & (F.col("user_id") % 3 != 0), 1)
                 .when(F.col("event_type") == "error", -1)
                 .when(F.col("event_type").isin("purchase", "signup"), 1)
                 .otherwise(F.when(F.col("lv") >= 5, 1).otherwise(0)))
    # qnorm and pnorm are staged (shared subexpressions as columns): computed once per row.
    b = with_qnorm(b, "ground_truth", "_z").withColumn("_x", F.lit(math.sqrt(2.0)) * F.col("_z"))
    b = with_pnorm(b, "_x", "_p_with")
    return b.select(
        "event_id",
        F.col("user_id").alias("worker_id"),
        F.col("trial").cast("int").alias("trial"),
        "n_trials",
        F.when(F.col("trial") == 1, "practice").when(F.col("trial") == 2, "mock")
         .otherwise(F.col("trial").cast("string")).alias("trial_idx"),
        "condition", "start_means", "sd_diff", "ground_truth",
        p_sup.alias("p_superiority"),
        intervene.alias("intervene"),
        F.when(F.col("value") < 100, -1.0).otherwise(2.25).alias("payoff"),
        F.lit(2.25).alias("award_value"),
        F.lit(0.5).alias("baseline"),
        F.col("_p_with").alias("p_award_with"),
        F.lit(0.5).alias("p_award_without"),
        (F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts")) / 1e6).alias("trial_dur"),
    )


# The coded strategy flags and the corpus token that stands in for each
# (the stand-in corpus is invented prose; tokens were picked to hit 5-45 % of documents).
STRATEGY_CODES = {
    "mentioned_distance": "thble",
    "mentioned_mean": "thing",
    "mentioned_variance": "attion",
    "mentioned_threshold": "whst",
    "mentioned_area": "ndble",
    "mentioned_frequency": "shat",
    "mentioned_confusion": "eauou",
}


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded free-text answers, one row per document (FIXTURES.md 2.2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    cond = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), (F.col("doc_id") % 4 + 1).cast("int"))
    low = F.lower(F.col("text"))
    cols = [F.col("doc_id").alias("worker_id"), cond.alias("condition"),
            ((F.col("doc_id") % 2) == 0).alias("start_means"),
            low.alias("open_codes"), (F.col("n_chars") > 200).alias("answered")]
    cols += [F.when(low.contains(tok), "yes").otherwise("no").alias(name) for name, tok in STRATEGY_CODES.items()]
    return d.select(*cols)


def draws_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficient draws in long form (draw, chain, term, beta) from ``embeddings`` (FIXTURES.md 2.3)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("draw"), F.col("label").alias("chain"),
                    F.posexplode("embedding").alias("term", "beta")) \
            .select("draw", "chain", F.col("term").cast("int").alias("term"), F.col("beta").cast("double").alias("beta"))


def draws_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws as stored: one vector a draw (draw, chain, beta)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("draw"), F.col("label").alias("chain"), F.col("embedding").cast("array<double>").alias("beta"))
