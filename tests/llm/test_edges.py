"""Empty tables, clashing column names, and tables without a fold, for every dealt operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialscope.llm import (interpolation, line_dedup, merkle, mixing, nn_descent, phrase_automata, pieces, secret_scan, simhash,
                            substring_array)
from trialscope.llm.parameters import piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for columns of their own
NAMES = ["fp", "root", "component_id", "row", "id", "of", "hash", "t", "_t", "_t2", "_id", "_gone", "_lines", "_text", "_n_lines", "_n_dropped",
         "_salt", "k1", "k2", "keeper", "copies", "copy", "_copy", "_domain", "l0", "key", "words", "least", "a", "b", "n", "line", "i"]


@pytest.mark.parametrize("name,operator", [
    ("op1", substring_array.remove_repeats), ("op3", line_dedup.drop_repeated_lines), ("op4", secret_scan.scan),
    ("op6", lambda d: pieces.encode_decode(d, piece_model())), ("op7", phrase_automata.remove_passages), ("op9", interpolation.score),
    ("op10", simhash.near_duplicates), ("keep_one", simhash.keep_one)])
def test_empty_tables(spark, name, operator):
    assert operator(spark.createDataFrame([], DOCS)).collect() == []


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nn_descent.nearest(none, 10, F.col("vec_id") % 100 == 0).collect() == []


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("ids", [[1], [1, 2], [3, 3, 3], [None]])
def test_no_document_in_a_fold(spark, ids):
    docs = spark.createDataFrame([(i, "a b a c") for i in ids], "doc_id long, text string")
    got = interpolation.score(docs).collect()
    assert len(got) == len(ids) and all(r.score < 0 and r.n_tokens == 5 for r in got)


def clashing(spark):
    texts = ["one line that is long enough to count\nown " + str(k) for k in range(6)] + ["the same words here and there again"] * 2 + [None]
    rows = [(k, t, "en", f"s{k % 2}", 1, *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + "".join(f", {n} string" for n in NAMES)), rows


def same_values(got, rows, changed=()):
    by_id = {r[0]: r for r in rows}
    for r in got:
        for c, v in zip(["doc_id", "text", "lang", "source", "n_chars", *NAMES], by_id[r["doc_id"]]):
            assert c in changed or r[c] == v, c


def test_clashing_names_come_back(spark):
    docs, rows = clashing(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    same_values(kept, rows)
    assert {6, 7} & {r["doc_id"] for r in kept} == {6}
    lines = line_dedup.drop_repeated_lines(docs)
    assert lines.columns == [*docs.columns, "__n_lines", "__n_dropped"]
    lines = lines.collect()
    same_values(lines, rows, ("text",))
    assert {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], r["text"]) for r in lines if r["doc_id"] in (0, 5, 8)} == {
        0: (2, 1, "own 0"), 5: (2, 0, rows[5][1]), 8: (1, 0, "")}
    mixed = mixing.mix(docs, {"lang": {"en": 2}}, (1, 1), levels={"domain": F.lit("d"), "lang": F.col("lang"), "source": F.col("source")})
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    same_values(mixed, rows)
    assert {r["doc_id"] for r in mixed} >= set(range(8))


def test_manifest_of_clashing_names(spark):
    docs, rows = clashing(spark)
    out = merkle.proofs(merkle.manifest(docs, ["doc_id", "text"], "source", "doc_id")).collect()
    assert len(out) == len(rows) and all(r.verified for r in out)


def test_the_planners_estimate_does_not_grow_with_the_rounds(spark):
    """A checkpoint hands its plan's estimate on and a join multiplies: the digits doubled every round of the graph, in the driver."""
    rows = spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    said = set()
    for _ in range(6):
        rows = nn_descent.cut(rows.join(rows.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", "b").distinct())
        said.add(rows._jdf.queryExecution().optimizedPlan().stats().simpleString())
    assert len(said) == 1 and "E+" not in said.pop()
    assert rows.count() == 20 and rows.schema.names == ["a", "b"] and {(r.a, r.b) for r in rows.collect()} == {(i, i + 1) for i in range(20)}
