"""The registered queries of the dealt operators: each applies one to its whole table and derives the digest."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (interpolation, line_dedup, merkle, mixing, nn_descent, phrase_automata, pieces, quality_crf, secret_scan, simhash,
               spelling, substring_array, token_counts)
from .oracles import LINES_SQL, LOWER, MERKLE_SQL, MIX_SQL, SECRETS_SQL, UPPER
from .parameters import MIX, MIX_SEED, byte_vocabulary, piece_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_array.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_start").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crf = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.quality(docs, crf).drop("labels")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(documents(spark, sf_dir))
    count = [F.size(F.filter(F.col("spans.kind"), partial(eq, k))).cast("long").alias(f"n_{r.kind}")
             for k, r in enumerate(secret_scan.BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    return out.select("doc_id", *count, F.sha2(F.encode(secret_scan.written(base), "UTF-8"), 256).alias("base_sha256"),
                      secret_scan.written(F.col("spans")).alias("spans"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("domain", mixing.domain_of(F.col("source")))
    out = mixing.plan(docs, MIX, (1, 2), max_epochs=2, seed=MIX_SEED)
    every = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).where("copies > 0")
    return every.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_decode(documents(spark, sf_dir), piece_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_automata.remove_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 10, F.col("vec_id") % 100 == 0)


@query
def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(documents(spark, sf_dir))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), token_counts.prove(byte_vocabulary()))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"]
    plain = F.octet_length("text") == F.char_length("text")
    lowered = F.when(plain, F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    tampered = merkle.digest(*(lowered if f == "text" else F.col(f) for f in fields))
    docs = docs.withColumn("presented", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered))
    out = merkle.proofs(merkle.manifest(docs, fields, "source", "doc_id", F.col("presented")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", "verified")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


ORACLE |= {"op3_line_dedup": LINES_SQL, "op4_secret_scan": SECRETS_SQL, "op5_mixing": MIX_SQL, "op13_merkle_manifest": MERKLE_SQL}
