"""Line dedup with levelled sorted runs of line hashes. DataFrame functions only.

Documents come in batches, the greatest ids first. A *run* is a table of line keys (128 bits of hash, bucketed
and sorted): how many documents of its batches hold the key, and the greatest id holding it, the
*keeper*. A batch's keys are merge-joined with each run: those in none (the anti-join) are new and get a keeper from this
batch; those found only add to the count. The batch adds one run of its own; after every ``fanout`` runs of a
level these are compacted into one run of the next level. At the end all runs are merged; keys held by at least
``min_docs`` documents lose their lines everywhere but in the keeper.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import cut, free_name, whole_row

BLANK = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
#: a key with more than one in HEAVY of all repeated lines is dealt over SALTS tasks; there are fewer than HEAVY of them
HEAVY = 4096
SALTS = 64
KEYS = ["k1", "k2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (``lower`` does just that to ASCII, and faster)."""
    stripped = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


class Runs:
    """Levelled runs: tables bucketed and sorted by key, in the session's shared checkpoint folder.

    A bucket is one sorted file, so runs are merged with one another and with a batch in the order they are stored in: only
    a batch is shuffled, once.
    """

    def __init__(self, spark: SparkSession, fanout: int):
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.count = f"line_runs_{uuid.uuid4().hex}", 0
        self.path = f"{folder}/{self.name}"
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"{self.name}_{self.count}"
        dealt = rows.repartition(self.buckets, *KEYS).sortWithinPartitions(*KEYS)
        (dealt.write.format("parquet").option("path", f"{self.path}/{self.count}").bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
         .saveAsTable(name))
        self.count += 1
        return self.spark.table(name)

    def drop(self) -> None:
        """Forgets the tables' names."""
        for k in range(self.count):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several, by full merge joins: counts add up, the keeper is the greatest."""
        out = runs[0]
        for run in runs[1:]:
            other = run.withColumnsRenamed({c: f"other_{c}" for c in run.columns})
            pairs = out.join(other.hint("merge"), [F.col(k) == F.col(f"other_{k}") for k in KEYS], "full")
            out = pairs.select(*(F.coalesce(k, f"other_{k}").alias(k) for k in KEYS),
                               (F.coalesce("n", F.lit(0)) + F.coalesce("other_n", F.lit(0))).alias("n"),
                               F.greatest("keeper", "other_keeper").alias("keeper"))
        return out

    def add(self, batch: DataFrame) -> None:
        """``batch``: k1, k2, n, keeper of one batch of documents, a row a key.

        Every run is merged with it once: keys without a partner in any are new (the anti-join) and keep their keeper, those
        with one only count.
        """
        old = self.all()
        for k, run in enumerate(old):
            batch = batch.join(run.select(*KEYS, F.lit(True).alias(f"in{k}")).hint("merge"), KEYS, "left")
        if old:
            new = F.coalesce(*(f"in{k}" for k in range(len(old)))).isNull()
            batch = batch.select(*KEYS, "n", F.when(new, F.col("keeper")).alias("keeper"))
        self.levels[0].append(self._write(batch))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.merged(self.levels[level])))
            self.levels[level] = []
            level += 1


def id_bounds(docs: DataFrame, id_col: str, batches: int) -> list[int]:
    """Lower bounds of the batches after the first, greatest first."""
    cuts = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / batches for i in range(1, batches)], 0.01)
    return sorted({int(c) for c in cuts}, reverse=True)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The rows and columns of ``docs`` with the lines left in ``text_col``, and ``_n_lines`` / ``_n_dropped`` (long).

    A text is split at newlines; null or empty is one empty line, and a null text comes back empty. Lines whose
    key (``line_key``) has ``min_chars`` code points or more and stands in ``min_docs`` or more documents go,
    but in the document of the greatest id holding it. Rows of equal id are one document; rows without an id are
    one document that comes before all others. A row whose lines all go has an empty text. An empty table gives
    an empty result. Other columns stay as they are, whatever their names; where the input has a column of a count's name,
    the count's gets underscores in front.
    """
    spark = docs.sparkSession
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"),
                       F.posexplode(lines).alias("i", "line"))
    key = line_key(F.col("line"))
    keyed = rows.where(F.char_length(F.btrim("line", F.lit(BLANK))) >= min_chars).select(
        "id", "t", "i", F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))
    # one row for each key and document; the null id counts as one document, and keeps a line only if alone
    held = cut(keyed.select("id", "k1", "k2").distinct())
    bounds = id_bounds(docs, id_col, batches)
    runs = Runs(spark, fanout)
    upper = None
    for lower in [*bounds, None]:
        part = held
        if upper is not None:
            part = part.where(F.col("id").isNull() | (F.col("id") < upper)) if lower is None else part.where(F.col("id") < upper)
        if lower is not None:
            part = part.where(F.col("id") >= lower)
        runs.add(part.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")))
        upper = lower
    repeated = cut(Runs.merged(runs.all()).where(F.col("n") >= min_docs))
    runs.drop()
    share = repeated.agg(F.sum("n") / HEAVY).scalar()
    hot = F.col("n") > share
    salted = keyed.join(F.broadcast(repeated.where(hot).select("k1", "k2", F.lit(SALTS).alias("_salts"))), ["k1", "k2"], "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("id", "t", "i"), F.coalesce("_salts", F.lit(1))))
    salts = F.sequence(F.lit(0).cast("long"), F.when(hot, SALTS - 1).otherwise(0).cast("long"))
    repeated = repeated.select("k1", "k2", "keeper", F.explode(salts).alias("_salt"))
    dropped = (salted.join(repeated, ["k1", "k2", "_salt"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
               .groupBy("id", "t").agg(F.sort_array(F.collect_set("i")).alias("_gone")))
    # the input's columns travel in one struct, whatever their names
    base = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("of"), F.xxhash64(text_col).alias("hash"))
    joined = base.join(dropped, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("t")), "left")
    old = F.col("row")[text_col]
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    parted = joined.select("row", gone.alias("_gone"), F.split(F.coalesce(old, F.lit("")), "\n").alias("_lines"))
    # the lines between two dropped ones, slice by slice: linear in the number of lines
    edges = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("_gone")), F.concat(F.col("_gone"), F.array(F.size("_lines"))),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.flatten(F.transform(edges, lambda e: F.slice(F.col("_lines"), e["a"] + 2, e["b"] - e["a"] - 1)))
    text = F.when(F.size("_gone") == 0, F.coalesce(old, F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return parted.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
                         F.size("_lines").cast("long").alias(free_name("_n_lines", docs)),
                         F.size("_gone").cast("long").alias(free_name("_n_dropped", docs)))
