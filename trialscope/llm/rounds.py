"""Which keys occur more than once in a corpus? Asked in rounds, without moving the keys' contexts.

Documents are dealt once into bounded *groups* ``g``. In each round a group's task turns its texts into
64/128-bit keys, keeps the distinct ones sorted and sends them, packed, to key-range *buckets* ``b``. A
bucket's task sorts the keys of one bucket and answers each group with three bits a key, in the order sent:
does the key recur, is this the first group that holds it, and has any group marked it? The group recomputes its keys (they are a
function of its rows) and reads the bits against them. A key held by every group costs a bucket one entry
a group, however often it occurs, so no key, passage or copy group can make a bucket hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_SCHEMA = "b long, g long, keys binary, multi binary"
FLAGS_SCHEMA = "g long, round int, b long, recurs binary, first binary, marked binary"
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20

_KEYS = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("keys", pa.binary()), ("multi", pa.binary())])
_FLAGS = pa.schema([("g", pa.int64()), ("round", pa.int32()), ("b", pa.int64()), ("recurs", pa.binary()),
                    ("first", pa.binary()), ("marked", pa.binary())])


class Sizes:
    """Numbers of groups, partitions and buckets that follow the corpus size (one pass over the lengths)."""

    def __init__(self, docs: DataFrame, text: str, group_bytes: int = GROUP_BYTES):
        spark = docs.sparkSession
        self.bytes = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
        self.groups = max(1, math.ceil(self.bytes / group_bytes))
        self.partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.bytes / (128 << 20)))

    def buckets(self, key_bytes_per_text_byte: float) -> int:
        return max(8, math.ceil(self.bytes * key_bytes_per_text_byte / BUCKET_BYTES))


def sorted_runs(hi: np.ndarray, lo: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts (hi, lo), and where in it a new key begins."""
    order = np.argsort(hi)
    a, b = hi[order], None if lo is None else lo[order]
    fresh = np.ones(len(hi), dtype=bool)
    fresh[1:] = a[1:] != a[:-1]
    if lo is not None and (~fresh[1:] & (b[1:] != b[:-1])).any():  # equal hi, other lo: sort by both
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, fresh


class Keys:
    """Distinct sorted keys of one group. ``place[i]`` is where occurrence i's key stands among them.

    Each key goes out with a mark: whether the group holds it several times, or, given ``marks`` of the
    occurrences, whether any of them is marked.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray | None, buckets: int, marks: np.ndarray | None = None):
        self.width = 6 if lo is None else 12
        if lo is None:
            hi = hi >> np.uint64(16) << np.uint64(16)
        else:
            lo = lo >> np.uint64(32)
        order, fresh = sorted_runs(hi, lo)
        self.place = np.empty(len(hi), dtype=np.int64)
        self.place[order] = np.cumsum(fresh) - 1
        self.hi, self.lo = hi[order][fresh], None if lo is None else lo[order][fresh]
        begin = np.flatnonzero(fresh)
        self.earliest = np.minimum.reduceat(order, begin) if len(begin) else begin  # first occurrence of each key
        if marks is None:
            self.multi = np.diff(np.append(begin, len(hi))) > 1
        else:
            self.multi = np.logical_or.reduceat(marks[order], begin) if len(begin) else np.zeros(0, bool)
        step = np.uint64((1 << 64) // buckets + 1)
        self.cuts = np.searchsorted(self.hi, np.arange(1, buckets, dtype=np.uint64) * step)
        self.cuts = np.concatenate(([0], self.cuts, [len(self.hi)]))

    def table(self, g: int) -> pa.Table:
        raw = np.empty((len(self.hi), self.width), dtype=np.uint8)
        top = self.hi.astype(">u8").view(np.uint8).reshape(-1, 8)
        raw[:, :min(8, self.width)] = top[:, :self.width]
        if self.lo is not None:
            raw[:, 8:] = self.lo.astype(">u4").view(np.uint8).reshape(-1, 4)
        used = np.flatnonzero(np.diff(self.cuts))
        spans = [(int(self.cuts[b]), int(self.cuts[b + 1])) for b in used]
        return pa.table([pa.array(used, pa.int64()), pa.array([g] * len(used), pa.int64()),
                         pa.array([raw[i:j].tobytes() for i, j in spans], pa.binary()),
                         pa.array([np.packbits(self.multi[i:j]).tobytes() for i, j in spans], pa.binary())], schema=_KEYS)

    def answers(self, flags: pa.Table, number: int) -> np.ndarray:
        """Rows recurs, first, marked of each distinct key from the bits of one round."""
        out = np.zeros((3, len(self.hi)), dtype=bool)
        for row in flags.to_pylist():
            if row["round"] == number:
                i, j = int(self.cuts[row["b"]]), int(self.cuts[row["b"] + 1])
                for k, name in enumerate(("recurs", "first", "marked")):
                    out[k, i:j] = np.unpackbits(np.frombuffer(row[name], np.uint8), count=j - i)
        return out


def _answer(number: int, width: int, rows: pa.Table) -> pa.Table:
    """One bucket: sort its keys, mark those that several groups or one group several times hold."""
    rows = rows.sort_by("g")
    n = np.array([len(k) // width for k in rows["keys"].to_pylist()], dtype=np.int64)
    raw = np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype=np.uint8).reshape(-1, width)
    padded = np.zeros((len(raw), 8), dtype=np.uint8)
    padded[:, :min(width, 8)] = raw[:, :8]
    hi = padded.view(">u8").ravel().astype(np.uint64)
    if width > 8:
        lo = np.ascontiguousarray(raw[:, 8:]).view(">u4").ravel().astype(np.uint32)
        order, fresh = sorted_runs(hi, lo)
    else:
        order, fresh = sorted_runs(hi, None)
    multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=c) for m, c in zip(rows["multi"].to_pylist(), n)])
    run, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    lead = np.minimum.reduceat(order, begin)  # rows are ordered by group, so this one is in the first group
    marks = np.bincount(run, weights=multi[order])
    recurs, first, marked = (np.empty(len(raw), dtype=bool) for _ in range(3))
    recurs[order], marked[order] = (np.bincount(run) + marks > 1)[run], (marks > 0)[run]
    first[:] = False
    first[lead] = True
    cuts = np.concatenate(([0], np.cumsum(n)))
    bits = [[np.packbits(x[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])] for x in (recurs, first, marked)]
    return pa.table([rows["g"], pa.array([number] * len(n), pa.int32()), rows["b"], pa.array(bits[0], pa.binary()),
                     pa.array(bits[1], pa.binary()), pa.array(bits[2], pa.binary())], schema=_FLAGS)


def answer(keys: DataFrame, number: int, width: int, partitions: int) -> DataFrame:
    """The flags of round ``number`` for rows of ``Keys.table``, dealt back to their groups."""
    def sort_bucket(rows: pa.Table) -> pa.Table:
        return _answer(number, width, rows)
    return keys.groupBy("b").applyInArrow(sort_bucket, FLAGS_SCHEMA).repartition(partitions, "g")


def first_round(groups: DataFrame, make: Callable[[pa.Table], Keys]) -> DataFrame:
    def ask(rows: pa.Table) -> pa.Table:
        return make(rows).table(rows["g"][0].as_py())
    return groups.groupBy("g").applyInArrow(ask, KEYS_SCHEMA)


def next_round(groups: DataFrame, flags: DataFrame, make: Callable[[pa.Table, pa.Table], Keys]) -> DataFrame:
    def ask(rows: pa.Table, bits: pa.Table) -> pa.Table:
        return make(rows, bits).table(rows["g"][0].as_py()) if rows.num_rows else _KEYS.empty_table()
    return groups.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(ask, KEYS_SCHEMA)


def finish(groups: DataFrame, flags: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
           empty: pa.Schema) -> DataFrame:
    def run(rows: pa.Table, bits: pa.Table) -> pa.Table:
        return make(rows, bits) if rows.num_rows else empty.empty_table()
    return groups.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(run, schema)
