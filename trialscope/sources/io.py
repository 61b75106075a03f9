"""Sources and sinks.

Reads always take an explicit schema and FAILFAST, so a drifting file fails loudly
instead of inferring a different type (the reference's notebooks disagree on
``start_means``).  Scratch output goes under the session's shared
``spark.checkpoint.dir``, never a machine-local folder.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trialscope.session import ensure_checkpoint_dir

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

# Trial CSV as the experiment writes it (camelCase header), FIXTURES.md 1.1.
TRIAL_CSV_SCHEMA = T.StructType([
    T.StructField("workerId", T.StringType()), T.StructField("batch", T.StringType()),
    T.StructField("condition", T.StringType()), T.StructField("start_means", T.BooleanType()),
    T.StructField("n_trials", T.IntegerType()), T.StructField("trial", T.StringType()),
    T.StructField("trialIdx", T.StringType()), T.StructField("groundTruth", T.DoubleType()),
    T.StructField("sdDiff", T.IntegerType()), T.StructField("baseline", T.DoubleType()),
    T.StructField("award_value", T.DoubleType()), T.StructField("accountValue", T.DoubleType()),
    T.StructField("pAwardWith", T.DoubleType()), T.StructField("pAwardWithout", T.DoubleType()),
    T.StructField("pSup", T.DoubleType()), T.StructField("intervene", T.IntegerType()),
    T.StructField("payoff", T.DoubleType()), T.StructField("startTime", T.DoubleType()),
    T.StructField("respTime", T.DoubleType()), T.StructField("trialDur", T.DoubleType()),
])


def read_trials(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A1: trial table with a fixed schema; CSV needs a header, parquet is read as is."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("mode", "FAILFAST").csv(path)
    return r.format(fmt).load(path)


def write_trials(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """A2: write (overwrite) as CSV with a header or parquet; returns the path."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (cluster-visible)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/trialscope-io/{name}-{uuid.uuid4().hex[:12]}"


def save_conds(df: DataFrame, path: str) -> str:
    """A3: nested stimulus table (array columns) to parquet."""
    return write_trials(df, path, "parquet")


def load_conds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literal_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A4: a small inline table (level lists, reference lines)."""
    return spark.createDataFrame(rows, schema)


def persist_fit(df: DataFrame, path: str, reuse: bool = True) -> DataFrame:
    """A5: keep fitted coefficients / draws as parquet and read them back when present.

    Only an absent path leads to a write; a stored fit that cannot be read raises and is left as it is.
    """
    spark = df.sparkSession
    if reuse:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    df.write.mode("errorifexists" if reuse else "overwrite").parquet(path)
    return spark.read.parquet(path)


def head(df: DataFrame, order: list, n: int = 6) -> DataFrame:
    """First rows in an explicit order (the limit is the feature)."""
    return df.orderBy(*order).limit(n)
