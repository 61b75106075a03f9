"""Suffix-array dedup: remove every byte covered by a long string that starts anywhere else.

Method: blockwise suffix sorting with a difference cover. A cover C modulo v holds, for any two offsets a and b,
a shift d < v that moves both into C. So two equal ``length``-byte strings always meet at a pair of *cover
samples* within their first v bytes.

1. *Cover-sample ranks, short*: samples are ranked by their next ``length - v + 1`` bytes, one bucket of ranks
   at a time. A suffix none of whose samples ties cannot repeat and is not looked at again.
2. *Cover-sample ranks, long*: tied samples are ranked by ``length + v`` bytes. A tie proves all suffixes
   between the sample and the next one on the same shift repeated. This resolves long ties (whole copies, long
   passages) by rank, without sorting the suffixes inside them again for each copy.
3. *Open classes*: a short class is open if a suffix near one of its samples is not yet proven.
4. *Suffix buckets*: the unproven suffixes (edges of matches, short passages), and for each open long tie the
   suffixes of its first copy, are sorted by ``length`` bytes one bucket at a time; equal neighbours repeat.

Strings are compared by hashes in place of bytes, so a bucket holds 6 bytes (step 1, a filter: a false tie costs
time only; step 3) or 12 bytes (steps 2 and 4: 96 bits of two independent polynomial hashes) a suffix and memory is
bounded by the bucket size, whatever the texts hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Keys, Sizes, answer, finish, first_round, next_round
from .textbytes import between, covered, hash_slices, runs, text_buffer

LENGTH = 400

#: fixed values: difference covers (modulus, residues); every residue is a difference of two members
COVERS = {
    7: (0, 1, 3),
    21: (0, 1, 4, 14, 16),
    183: (0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175),
}

_OUT = pa.schema([("id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("span_start", pa.list_(pa.int64())), ("span_end", pa.list_(pa.int64()))])


class Suffixes:
    """The texts of one group and their suffixes, by byte position in the group's buffer.

    The rows are put in one order, whichever way a shuffle brought them: which copy of a string is the group's first
    decides the keys of step 4, and the next round reads its bits against the same keys.
    """

    def __init__(self, rows: pa.Table, length: int, modulus: int, buckets: dict[int, int]):
        self.length, self.modulus, self.buckets = length, modulus, buckets
        rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = rows["id"]
        self.buf, self.off = text_buffer(rows["text"])
        self.n = len(self.buf)

    def samples(self) -> np.ndarray:
        """Cover positions (by offset within their text) with ``length - v + 1`` bytes after them."""
        sizes = np.diff(self.off)
        longest = int(sizes.max(initial=0))
        turns = np.arange(0, longest + self.modulus, self.modulus)
        cover = (turns[:, None] + np.array(COVERS[self.modulus])).ravel()
        last = np.searchsorted(cover, sizes - self.short, "right")
        return np.concatenate([cover[:k] + a for k, a in zip(last, self.off)] or [np.zeros(0, np.int64)]).astype(np.int64)

    @property
    def short(self) -> int:
        return self.length - self.modulus + 1

    @property
    def long(self) -> int:
        return self.length + self.modulus

    def room(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which positions have ``size`` bytes left in their text?"""
        return at + size <= self.off[np.searchsorted(self.off, at, "right")]

    def keys(self, at: np.ndarray, size: int, number: int, marks: np.ndarray | None = None) -> Keys:
        hi = hash_slices(self.buf, at, at + size, 0)
        lo = hash_slices(self.buf, at, at + size, 1) if number in (2, 4) else None
        return Keys(hi, lo, self.buckets[number], marks)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The first suffix of the same text whose v first bytes hold the sample."""
        return np.maximum(at - self.modulus + 1, self.off[np.searchsorted(self.off, at, "right") - 1])

    def step1(self) -> tuple[np.ndarray, Keys]:
        at = self.samples()
        return at, self.keys(at, self.short, 1)

    def step2(self, flags: pa.Table) -> tuple[np.ndarray, np.ndarray, Keys]:
        """Tied samples, those with room for a long rank, and their keys."""
        at, keys = self.step1()
        tied = at[keys.answers(flags, 1)[0][keys.place]]
        long = tied[self.room(tied, self.long)]
        return tied, long, self.keys(long, self.long, 2)

    def step3(self, flags: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Keys]:
        """Masks of proven and of unproven suffixes, first copies of long ties, tied samples and their keys."""
        tied, long, keys = self.step2(flags)
        recurs, first, _ = keys.answers(flags, 2)
        proven = covered(long[recurs[keys.place]], self.modulus + 1, self.n)
        leads = np.sort(long[keys.earliest[recurs & first]])
        left = np.flatnonzero(between(self.before(tied), tied + 1, self.n) & ~proven)
        left = left[self.room(left, self.length)]
        unproven = np.zeros(self.n, dtype=bool)
        unproven[left] = True
        count = np.concatenate(([0], np.cumsum(unproven, dtype=np.int32)))
        near = count[tied + 1] > count[self.before(tied)]
        return proven, unproven, leads, tied, self.keys(tied, self.short, 3, near)

    def step4(self, flags: pa.Table) -> tuple[np.ndarray, np.ndarray, Keys]:
        """Mask of proven suffixes, the suffixes to sort and their keys."""
        proven, unproven, leads, tied, keys = self.step3(flags)
        opened = tied[keys.answers(flags, 3)[2][keys.place]]
        unproven |= covered(leads, self.modulus + 1, self.n) & between(self.before(opened), opened + 1, self.n)
        at = np.flatnonzero(unproven)
        return proven, at, self.keys(at, self.length, 4)

    def repeated(self, flags: pa.Table) -> np.ndarray:
        proven, at, keys = self.step4(flags)
        proven[at[keys.answers(flags, 4)[0][keys.place]]] = True
        return np.flatnonzero(proven)


def _cut(suffixes: Suffixes, flags: pa.Table) -> pa.Table:
    gone = covered(suffixes.repeated(flags), suffixes.length, suffixes.n)
    kept, spans_from, spans_to = [], [], []
    for a, b in zip(suffixes.off, suffixes.off[1:]):
        mask = gone[a:b]
        start, end = runs(mask)
        kept.append(suffixes.buf[a:b][~mask].tobytes())
        spans_from.append(start)
        spans_to.append(end)
    removed = [int((e - s).sum()) for s, e in zip(spans_from, spans_to)]
    return pa.table([suffixes.ids.combine_chunks(), pa.array(kept, pa.binary()), pa.array(np.diff(suffixes.off), pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(spans_from, pa.list_(pa.int64())),
                     pa.array(spans_to, pa.list_(pa.int64()))], schema=_OUT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   modulus: int = 183) -> DataFrame:
    """One row per row of ``docs``: id, ``kept`` bytes, n_bytes, n_removed, span_start / span_end (removed runs).

    Every byte covered by a ``length``-byte string that also starts at another place (of the same or another
    row) is removed, the first occurrence included; matches never cross texts. A null text is empty; texts
    shorter than ``length`` stay whole; repeated rows are each other's copies; a null id stays null; other
    columns are not read. An empty table gives an empty result. ``modulus`` is a key of ``COVERS`` below
    ``length``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = Sizes(rows, "text")
    density = len(COVERS[modulus]) / modulus
    buckets = {1: size.buckets(6 * density), 2: size.buckets(4 * density), 3: size.buckets(2 * density), 4: size.buckets(1)}
    groups = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(size.groups))).repartition(size.partitions, "g")

    def of(table: pa.Table) -> Suffixes:
        return Suffixes(table, length, modulus, buckets)

    flags = answer(first_round(groups, lambda t: of(t).step1()[-1]), 1, 6, size.partitions)
    more = answer(next_round(groups, flags, lambda t, bits: of(t).step2(bits)[-1]), 2, 12, size.partitions)
    flags = flags.unionByName(more)
    more = answer(next_round(groups, flags, lambda t, bits: of(t).step3(bits)[-1]), 3, 6, size.partitions)
    flags = flags.unionByName(more)
    more = answer(next_round(groups, flags, lambda t, bits: of(t).step4(bits)[-1]), 4, 12, size.partitions)
    flags = flags.unionByName(more)
    return finish(groups, flags, lambda t, bits: _cut(of(t), bits),
                  "id long, kept binary, n_bytes long, n_removed long, span_start array<long>, span_end array<long>",
                  _OUT).withColumnRenamed("id", id_col)
