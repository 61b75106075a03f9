"""Connected components of a large edge table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``: beside it an operator's own columns can't clash with the input's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def free_name(name: str, docs: DataFrame) -> str:
    """``name``, with underscores in front as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang greater neighbours on the least; small star: hang the lesser ones and the node itself."""
    pairs = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges always run from the greater node a to the lesser b
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.where("m < a").select("a", F.col("m").alias("b")))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with b the least node of a's component, for every node a of ``edges`` (long a, b) but the least itself."""
    one_way = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(one_way)
    before = None
    while True:
        edges = cut(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now
