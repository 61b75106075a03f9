"""The corpus pipeline: five stages from raw documents to tokens, each read from the last one's Parquet.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all rows it is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.llm import line_dedup, mixing, pieces, quality_crf, simhash
from trialscope.llm.parameters import MIX, MIX_SEED, piece_model

#: the mixture's budget: a share of the tokens that reach the stage
SHARE = (3, 5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose CRF content share is enough, unchanged."""
    crf = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.keep_good(docs, crf)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat across documents; ``n_chars`` follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash, the one of the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mixture of ``SHARE`` of the tokens takes, one epoch at most."""
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, MIX, SHARE, max_epochs=1, seed=MIX_SEED, levels=levels)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the decoded text of every document."""
    return pieces.encode_decode(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: the CRF's verdicts and the pieces can't be said in SQL; the tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written to the shared folder and reread."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{folder}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
