"""Substring dedup by repeated-phrase automata: remove words of passages that already stood earlier.

1. *Find*: each window of ``size`` words is reduced to its rarest-looking 5-word phrase (smallest hash), so equal
   windows share it. Phrases that occur once rule their windows out.
2. *Confirm*: the windows left are counted by 96-bit keys over all groups; documents are grouped by ranges of the
   id, so the first group that holds a window also holds its earliest occurrence.
3. *Automata*: each group compiles one pyahocorasick automaton (a shard of the corpus-wide set) of phrases that
   were confirmed and stand in it: windows at every ``size``-th place, and the last, of each recurring passage,
   which together cover the passage. A word is a few digits. All texts of the group are streamed through it, and
   every occurrence but a window's earliest removes its words. Shards of a group are bounded by ``SHARD``.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Keys, Sizes, answer, finish, first_round, next_round
from .textbytes import Words, covered, hash_slices, runs, text_buffer

SIZE = 20
PHRASE = 5
SHARD = 5_000
DIGITS = 64  # a word is written in this base, so that no node of an automaton has more edges

_OUT = pa.schema([("id", pa.int64()), ("kept", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


class Passages:
    """The words of one group's texts, in the order of (id, text); nulls last."""

    def __init__(self, rows: pa.Table, size: int, buckets: dict[int, int]):
        rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids, self.size, self.buckets = rows["id"], size, buckets
        self.buf, self.off = text_buffer(rows["text"])
        self.words = Words(self.buf, self.off)
        self.hash = self.words.hashes()
        self.windows = self.words.windows(size)

    def phrases(self) -> np.ndarray:
        """For each window, the place of its smallest phrase."""
        k = min(PHRASE, self.size)
        at = np.arange(max(0, len(self.words) - k + 1))
        value = hash_slices(self.hash, at, at + k)
        best = self.windows.copy()
        for step in range(1, self.size - k + 1):
            other = self.windows + step
            best = np.where(value[other] < value[best], other, best)
        return best

    def step1(self) -> tuple[np.ndarray, np.ndarray, Keys]:
        best = self.phrases()
        at, place = np.unique(best, return_inverse=True)
        return place, at, Keys(hash_slices(self.hash, at, at + min(PHRASE, self.size)), None, self.buckets[1])

    def step2(self, flags: pa.Table) -> tuple[np.ndarray, Keys]:
        """Windows whose phrase recurs, and their keys."""
        place, _, keys = self.step1()
        at = self.windows[keys.answers(flags, 1)[0][keys.place][place]]
        return at, Keys(hash_slices(self.hash, at, at + self.size, 0), hash_slices(self.hash, at, at + self.size, 1),
                        self.buckets[2])

    def removed(self, flags: pa.Table) -> np.ndarray:
        """Mask of the words that a window seen earlier covers."""
        at, keys = self.step2(flags)
        _, first, _ = keys.answers(flags, 2)
        later = ~first[keys.place]  # the first group keeps its earliest occurrence only
        lead = keys.earliest[first]
        later |= first[keys.place] & (np.arange(len(at)) != _spread(keys, lead, first))
        gone = np.zeros(len(self.words), dtype=bool)
        gone[at[later]] = True
        earliest = np.zeros(len(self.words), dtype=bool)
        earliest[at[~later]] = True
        return covered(self.locate(gone, earliest), self.size, len(self.words))

    def locate(self, gone: np.ndarray, earliest: np.ndarray) -> np.ndarray:
        """Starts of all occurrences of the passages in ``gone`` other than the earliest, by automata."""
        start, end = runs(gone)
        heads = [np.append(np.arange(s, e, self.size), e - 1) for s, e in zip(start, end)]
        heads = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
        if not len(heads):
            return heads
        known = np.unique(self.hash[covered(heads, self.size, len(self.hash))])
        number = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
        number = np.where(known[number] == self.hash, number + 1, 0)  # 0: a word of no phrase
        width = max(1, int(np.ceil(np.log(len(known) + 1) / np.log(DIGITS) + 1e-9)))
        seat = np.arange(len(number)) + self.words.doc  # texts parted by an empty seat
        coded = np.zeros((len(number) + len(self.off) - 2, width), dtype="<u4")
        for k in range(width):
            coded[seat, k] = 1 + k * DIGITS + number // DIGITS ** k % DIGITS
        stream = coded.tobytes().decode("utf-32-le")
        word_at = np.full(len(coded), -1, dtype=np.int64)
        word_at[seat] = np.arange(len(number))
        found = []
        for k in range(0, len(heads), SHARD):
            shard = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for i in seat[heads[k:k + SHARD]] * width:
                shard.add_word(stream[i:i + self.size * width])
            shard.make_automaton()
            found.append(np.fromiter((e for e, _ in shard.iter(stream)), dtype=np.int64))
        at = np.unique(word_at[(np.concatenate(found) + 1) // width - self.size])
        return at[~earliest[at]]

    def cut(self, flags: pa.Table) -> pa.Table:
        gone = self.removed(flags)
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[self.words.off[1:]] - total[self.words.off[:-1]]
        return pa.table([self.ids.combine_chunks(), self.words.joined(~gone), pa.array(np.diff(self.words.off), pa.int64()),
                         pa.array(removed, pa.int64())], schema=_OUT)


def _spread(keys: Keys, lead: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each occurrence the earliest occurrence of its key, -1 where another group has it."""
    of = np.full(len(first), -1, dtype=np.int64)
    of[first] = lead
    return of[keys.place]


def id_ranges(rows: DataFrame, groups: int) -> list[int]:
    """Upper bounds of ``groups`` id ranges of about equal row counts."""
    if groups < 2:
        return []
    return sorted({int(x) for x in rows.approxQuantile("id", [i / groups for i in range(1, groups)], 0.2 / groups)})


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: id, ``kept`` text (words joined by one space), n_words, n_removed.

    A word is removed if a window of ``size`` words covers it whose words also start earlier: in a smaller id, or
    sooner in the same text. Rows with equal ids count as ordered by text (of repeated rows one stays whole);
    null ids come last, ordered by text. Null texts have no words; shorter texts lose nothing; an empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = Sizes(rows, "text", 4 << 20)
    bounds = np.array(id_ranges(rows, sizes.groups), dtype=np.int64)
    buckets = {1: sizes.buckets(0.15), 2: sizes.buckets(0.7)}

    def deal(batches):
        for batch in batches:
            ids = batch.column("id")
            g = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
            g[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
            yield pa.RecordBatch.from_arrays([ids, batch.column("text"), pa.array(g, pa.int64())], ["id", "text", "g"])

    groups = rows.mapInArrow(deal, "id long, text string, g long").repartition(sizes.partitions, "g")

    def of(table: pa.Table) -> Passages:
        return Passages(table, size, buckets)

    flags = answer(first_round(groups, lambda t: of(t).step1()[-1]), 1, 6, sizes.partitions)
    more = answer(next_round(groups, flags, lambda t, bits: of(t).step2(bits)[-1]), 2, 12, sizes.partitions)
    return finish(groups, flags.unionByName(more), lambda t, bits: of(t).cut(bits),
                  "id long, kept string, n_words long, n_removed long", _OUT).withColumnRenamed("id", id_col)
