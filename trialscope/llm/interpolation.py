"""Language-model scores by deleted interpolation of bigrams.

P(w | u) = l2 c(u,w)/c(u) + l1 c(w)/N + l0 / (V + 1), the weights l by the frequency bucket (a power of two) of the
context u. Training documents fall into a *kept* and a *held-out* part: counts of the kept part alone give the
relative frequencies of the held-out tokens, and expectation-maximisation on these learns the weights; scoring
then uses the counts of both parts.

Documents are dealt once into bounded groups. A group sends its distinct uni- and bigrams (64-bit hashes) with
their counts to key-range buckets; a bucket's task adds the counts of its keys and answers each group in the
order sent. A frequent word costs a bucket one entry a group. What is learned of the held-out tokens is a
histogram on a fixed grid of log relative frequencies, so that EM has a bounded input whatever the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Sizes, sorted_runs
from .textbytes import Words, hash_slices, mix, text_buffer

FOLDS = 7
TEST_FOLD = 2
#: the fold of the training documents whose tokens the weights are learned on
EM_FOLD = 3
#: EM goes on until no weight moves by more
EM_TOL = 1e-7
#: context buckets: never seen, then powers of two
BUCKETS = 42
#: the grid of the histogram: steps an octave of a relative frequency, and the octaves it spans
FINE, OCTAVES = 8, 40
END, BEGIN = np.uint64(0x5E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)

_ASK = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("kept", pa.binary()), ("held", pa.binary())])
_TELL = pa.schema([("g", pa.int64()), ("kind", pa.string()), ("b", pa.int64()), ("kept", pa.binary()), ("held", pa.binary())])
_BINS = pa.schema([("bin", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                  ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
TELL_SCHEMA = "g long, kind string, b long, kept binary, held binary"


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: of small numbers the upper ones are all zero, and compress away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


class Grams:
    """Distinct sorted keys of a group and how often its kept and held-out training tokens hold each."""

    def __init__(self, key: np.ndarray, kept: np.ndarray, held: np.ndarray, buckets: int, shift: int):
        order, fresh = sorted_runs(key, None)
        begin = np.flatnonzero(fresh)
        self.place = np.empty(len(key), dtype=np.int64)
        self.place[order] = np.cumsum(fresh) - 1
        self.key, self.shift = key[order][begin], shift
        self.counts = [np.add.reduceat(c[order], begin, dtype=np.uint32) if len(begin) else np.zeros(0, np.uint32) for c in (kept, held)]
        step = np.uint64((1 << 64) // buckets + 1)
        self.cuts = np.concatenate(([0], np.searchsorted(self.key, np.arange(1, buckets, dtype=np.uint64) * step), [len(self.key)]))

    def rows(self, g: int) -> pa.Table:
        used = np.flatnonzero(np.diff(self.cuts))
        spans = [(int(self.cuts[b]), int(self.cuts[b + 1])) for b in used]
        # sorted keys go out as steps from one to the next
        steps = [np.diff(self.key[i:j], prepend=np.uint64(0)) for i, j in spans]
        columns = [pa.array([pack(x) for x in steps], pa.binary()),
                   *[pa.array([pack(c[i:j]) for i, j in spans], pa.binary()) for c in self.counts]]
        return pa.table([pa.array(used + self.shift, pa.int64()), pa.array([g] * len(used), pa.int64()), *columns], schema=_ASK)

    def totals(self, answers: pa.Table) -> np.ndarray:
        """Rows kept, held: corpus counts of each distinct key."""
        out = np.zeros((2, len(self.key)), dtype=np.float64)
        for row in answers.to_pylist():
            b = row["b"] - self.shift
            if row["kind"] == "counts" and 0 <= b < len(self.cuts) - 1:
                i, j = int(self.cuts[b]), int(self.cuts[b + 1])
                out[0, i:j], out[1, i:j] = unpack(row["kept"], np.uint64), unpack(row["held"], np.uint64)
        return out


def fold_of(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo ``FOLDS``; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids], dtype=np.int64)


class Tokens:
    """The tokens of one group: each text's words, A-Z lower-cased, and one end."""

    def __init__(self, rows: pa.Table, buckets: tuple[int, int]):
        self.ids = rows["id"].combine_chunks()
        words = Words(*text_buffer(rows["text"]))
        n = len(self.ids)
        self.off = words.off + np.arange(n + 1)
        self.token = np.full(len(words) + n, END, dtype=np.uint64)
        self.token[np.arange(len(words)) + words.doc] = words.hashes(lower=True)
        self.before = np.concatenate(([BEGIN], self.token[:-1])) if n else self.token
        self.before[self.off[:-1]] = BEGIN
        fold = fold_of(self.ids.to_pylist())
        self.test = fold == TEST_FOLD
        self.em = np.repeat(fold == EM_FOLD, np.diff(self.off))
        kept = np.repeat((fold != EM_FOLD) & ~self.test, np.diff(self.off))
        self.one = Grams(self.token, kept, self.em, buckets[0], 0)
        pair = mix(self.before * np.uint64(0x9FB21C651E98DF25) ^ self.token)
        self.two = Grams(pair, kept, self.em, buckets[1], buckets[0])

    def ask(self, g: int) -> pa.Table:
        return pa.concat_tables([self.one.rows(g), self.two.rows(g)])

    def frequencies(self, answers: pa.Table, both: bool) -> tuple[np.ndarray, ...]:
        """Of each token: count, of its context, of both together; from the kept part, or from both parts."""
        one, two = self.one.totals(answers), self.two.totals(answers)
        one, two = (one.sum(axis=0), two.sum(axis=0)) if both else (one[0], two[0])
        word = one[self.one.place]
        context = np.concatenate(([0.0], word[:-1])) if len(word) else word
        ends = word[self.off[1:] - 1]
        context[self.off[:-1]] = ends  # texts begin as often as they end
        return word, context, two[self.two.place]

    def histogram(self, answers: pa.Table) -> pa.Table:
        """Held-out tokens by bucket of the context and grid places of both relative frequencies."""
        n, _ = totals(answers, False)
        word, context, pair = (x[self.em] for x in self.frequencies(answers, False))
        at = (bucket(context) * GRID + grid(pair, context)) * GRID + grid(word, np.full(len(word), n))
        value, count = np.unique(at, return_counts=True)
        return pa.table([pa.array(value, pa.int64()), pa.array(count, pa.int64())], schema=_BINS)

    def score(self, answers: pa.Table) -> pa.Table:
        n, v = totals(answers, True)
        row = next(r for r in answers.to_pylist() if r["kind"] == "weights")
        weights = np.frombuffer(row["kept"], np.float64).reshape(BUCKETS, 3)
        word, context, pair = self.frequencies(answers, True)
        l = weights[bucket(context)]
        p = l[:, 2] * pair / np.maximum(context, 1) + l[:, 1] * word / max(n, 1) + l[:, 0] / (v + 1)
        starts = self.off[:-1]
        base = np.log10((word + 1) / (n + v + 1))
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        return pa.table([self.ids, pa.array(self.test), pa.array(np.diff(self.off), pa.int64()),
                         pa.array(add((word > 0).astype(np.int64)), pa.int64()), pa.array([int(n)] * len(starts), pa.int64()),
                         pa.array(add(base), pa.float64()), pa.array(add(np.log10(p)), pa.float64())], schema=_OUT)


GRID = FINE * OCTAVES + 2


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then 1 + the power of two of its count."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def grid(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for no frequency, else 1 + its distance from 1 in steps of an octave / FINE."""
    ratio = np.where(part > 0, part, 1) / np.maximum(np.where(part > 0, whole, 1), 1)
    return np.where(part > 0, 1 + np.minimum(np.rint(-FINE * np.log2(ratio)), GRID - 2), 0).astype(np.int64)


def ungrid(at: np.ndarray) -> np.ndarray:
    return np.where(at > 0, 2.0 ** (-(at - 1) / FINE), 0.0)


def totals(answers: pa.Table, both: bool) -> tuple[int, int]:
    """Tokens and distinct tokens, of the kept part or of both parts."""
    row = next(r for r in answers.to_pylist() if r["kind"] == "totals")
    n_kept, n_held, v_kept, v_both = np.frombuffer(row["kept"], np.uint64).tolist()
    return (n_kept + n_held, v_both) if both else (n_kept, v_kept)


def maximise(bins: np.ndarray, n: np.ndarray, vocabulary: int, tol: float = EM_TOL) -> np.ndarray:
    """Weights (bucket x uniform, unigram, bigram) by EM from even ones, with one token's worth of prior on each.

    Steps go on until no weight moves by more than ``tol``; without held-out tokens the prior's even weights stay.
    """
    b, p2, p1 = bins // (GRID * GRID), ungrid(bins // GRID % GRID), ungrid(bins % GRID)
    parts = np.stack([np.full(len(bins), 1.0 / (vocabulary + 1)), p1, p2], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    while True:
        share = weights[b] * parts
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1).astype(float) + 1
        new[0, 2] = 0  # a context never seen has no bigrams
        new /= new.sum(axis=1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved <= tol:
            return weights


def _count(rows: pa.Table, unigrams: int) -> pa.Table:
    """One bucket: adds the counts of its keys over the groups; row g = -1 holds its sums, for the totals."""
    rows = rows.sort_by("g")
    key = np.concatenate([np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()])
    counts = [np.concatenate([unpack(c, np.uint32) for c in rows[name].to_pylist()]) for name in ("kept", "held")]
    order, fresh = sorted_runs(key, None)
    begin, run = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    sums = [np.add.reduceat(c[order].astype(np.uint64), begin) for c in counts]
    cuts = np.concatenate(([0], np.cumsum([len(k) // 8 for k in rows["keys"].to_pylist()])))
    told = []
    for s in sums:
        each = np.empty(len(key), dtype=np.uint64)
        each[order] = s[run]
        told.append([pack(each[i:j]) for i, j in zip(cuts, cuts[1:])])
    b = rows["b"][0].as_py()
    out = pa.table([rows["g"], pa.array(["counts"] * len(rows)), rows["b"], pa.array(told[0], pa.binary()),
                    pa.array(told[1], pa.binary())], schema=_TELL)
    if b >= unigrams:
        return out
    stats = np.array([sums[0].sum(), sums[1].sum(), (sums[0] > 0).sum(), (sums[0] + sums[1] > 0).sum()], dtype=np.uint64)
    return pa.concat_tables([out, pa.table([[-1], ["totals"], [b], [stats.tobytes()], [b""]], schema=_TELL)])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram log10 probability and ``score`` the interpolated model's. Held out of
    training are documents whose crc32 of the id as text is 2 modulo 7 (a null id counts as empty text). Null and
    empty texts have the end token only; repeated rows are counted and scored one by one; without training
    documents every token has the uniform probability; other columns are not read; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = Sizes(rows, "text")
    buckets = (size.buckets(0.3), size.buckets(1.2))
    groups = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(size.groups))).repartition(size.partitions, "g")

    def ask(table: pa.Table) -> pa.Table:
        return Tokens(table, buckets).ask(table["g"][0].as_py())

    def count(table: pa.Table) -> pa.Table:
        return _count(table, buckets[0])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(4, dtype=np.uint64)
        for blob in table["kept"].to_pylist():
            sums += np.frombuffer(blob, np.uint64)
        return pa.table([[-1], ["totals"], [0], [sums.tobytes()], [b""]], schema=_TELL)

    def histogram(table: pa.Table, answers: pa.Table) -> pa.Table:
        return Tokens(table, buckets).histogram(answers) if table.num_rows else _BINS.empty_table()

    def learn(bins: pa.Table, known: pa.Table) -> pa.Table:
        vocabulary = totals(known, False)[1] if known.num_rows else 0
        weights = maximise(bins["bin"].to_numpy(), bins["n"].to_numpy(), vocabulary)
        return pa.table([[-1], ["weights"], [0], [weights.tobytes()], [b""]], schema=_TELL)

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        return Tokens(table, buckets).score(answers) if table.num_rows else _OUT.empty_table()

    counted = groups.groupBy("g").applyInArrow(ask, "b long, g long, keys binary, kept binary, held binary").groupBy("b").applyInArrow(count, TELL_SCHEMA)
    one = F.lit(0).alias("one")
    # a row a bucket of unigrams, then one row for all; every group gets a copy of the one row
    known = counted.where("g = -1").groupBy("kind").applyInArrow(add, TELL_SCHEMA)
    every = spark.range(size.groups).select(F.col("id").alias("g"))

    def to_all(row: DataFrame) -> DataFrame:
        return every.crossJoin(F.broadcast(row.drop("g"))).select("g", "kind", "b", "kept", "held").repartition(size.partitions, "g")

    answers = counted.where("g >= 0").repartition(size.partitions, "g").unionByName(to_all(known))
    bins = (groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(histogram, "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")))  # at most BUCKETS x GRID x GRID rows
    weights = bins.select("*", one).groupBy("one").cogroup(known.select("*", one).groupBy("one")).applyInArrow(learn, TELL_SCHEMA)
    answers = answers.unionByName(to_all(weights))
    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(
        result, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("id", id_col)
