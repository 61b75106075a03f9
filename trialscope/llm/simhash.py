"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius by bit-sliced comparison.

Documents are reduced to distinct fingerprints first, so any number of copies is one row. Fingerprints within
``radius`` bits agree on at least one of ``radius + 1`` bands, so each band's value is a bucket and no link is
lost. A bucket's fingerprints are stored as vertical bit planes, 64 fingerprints to a machine word: a query
XORs plane after plane, updates all its distances at once with a carry-save bitwise counter, and leaves a
word of lanes when all of them are beyond the radius (its own lane counts as beyond). A bucket emits at most one edge a fingerprint (its local
component), and alternating stars join the edges into components. Buckets of more than ``BLOCK`` fingerprints
are compared block by block in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, cut, whole_row
from .textbytes import LOWER, Words, slices, text_buffer

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 1 << 15
QUERIES = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: planes read by all blocks, and planes after which finished blocks are dropped
DENSE, STEP = 16, 4

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprints(text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints of texts; one without words has fingerprint 0."""
    buf, off = text_buffer(text)
    out = np.zeros(len(off) - 1, dtype=np.uint64)
    for a, b in slices(off):
        words = Words(LOWER[buf[off[a]:off[b]]], off[a:b + 1] - off[a])
        raw, start, end = words.flat(np.ones(len(words), dtype=bool))
        count = np.diff(words.off)
        n = np.where(count, np.maximum(count - shingle + 1, 1), 0)  # shingles of each text
        first = np.repeat(words.off[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(first + shingle, np.repeat(words.off[1:], n)) - 1
        view, digest = memoryview(raw.tobytes()), xxhash.xxh64_intdigest
        h = np.fromiter((digest(view[s:e], SEED) for s, e in zip(start[first].tolist(), end[last].tolist())),
                        dtype="<u8", count=len(first))
        has = np.flatnonzero(n)
        ends = np.cumsum(n)[has]
        for i in range(0, len(has), 256):  # a few texts' bits at a time
            j = min(i + 256, len(has))
            lo = ends[i] - n[has[i]]
            bits = np.unpackbits(h[lo:ends[j - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, ends[i:j] - n[has[i:j]] - lo, axis=0, dtype=np.int32)
            out[a + has[i:j]] = np.packbits(2 * ones > n[has[i:j], None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed words: bit i of row j is bit j of value i."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(values) // 64) * 64), dtype=np.uint8)
    padded[:, :len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def unfinished(beyond: np.ndarray) -> np.ndarray:
    """Blocks (words of 64 lanes) with a lane that is still within the radius; the others are abandoned."""
    return np.flatnonzero(beyond != FULL)


def within(queries: np.ndarray, lanes: np.ndarray, n: int, radius: int, skip: int = 0, own: np.ndarray | None = None) -> np.ndarray:
    """Which of the n lanes (bit planes) are within the radius of each query? ``skip``: bits known to be equal.

    A block is one query against one word of 64 lanes. After ``DENSE`` planes over all blocks, and again every ``STEP``, the
    blocks whose lanes are all beyond the radius are dropped, and only the others read the next planes. ``own`` is each
    query's own lane, if it has one: it counts as beyond, as it would never let its block go.
    """
    bits = np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    masks = bits.T.astype(np.uint64) * FULL
    depth = (radius + 1).bit_length()
    start = (1 << depth) - (radius + 1)  # the counter starts here, so that it overflows beyond the radius
    shape = (len(queries), lanes.shape[1])
    counter = [np.full(shape, FULL if start >> k & 1 else np.uint64(0)) for k in range(depth)]
    beyond = np.zeros(shape, dtype=np.uint64)
    if n % 64:
        beyond[:, -1] = FULL << np.uint64(n % 64)  # lanes that pad the last word
    if own is not None:
        beyond[np.arange(len(own)), own // 64] |= np.uint64(1) << (own % 64).astype(np.uint64)

    def add(carry: np.ndarray) -> None:
        for k in range(depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        beyond[...] |= carry

    order = [j for j in range(64) if not skip >> j & 1]
    for j in order[:DENSE]:
        add(lanes[j] ^ masks[j][:, None])
    out = beyond.ravel()
    at = unfinished(out)
    for step, j in enumerate(order[DENSE:]):
        if step % STEP == 0:
            if step:
                out[at] = beyond
                at = at[unfinished(beyond)]
            if not len(at):
                break
            if step:
                keep = unfinished(beyond)
                counter = [c[keep] for c in counter]
            else:
                counter = [c.ravel()[at] for c in counter]
            query, word = np.divmod(at, shape[1])
            beyond = out[at]
        add(lanes[j][word] ^ masks[j][query])
    else:
        out[at] = beyond if len(order) > DENSE else out[at]
    return ~np.unpackbits(out.reshape(shape).view(np.uint8), axis=1, count=n, bitorder="little").astype(bool)


def _local_edges(values: np.ndarray, part: np.ndarray, radius: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) edges of the components among values of both parts."""
    parent = np.arange(len(values))
    lanes_at = np.flatnonzero(part == part.max())
    query_at = np.flatnonzero(part == part.min())
    lanes = planes(values[lanes_at])
    for k in range(0, len(query_at), QUERIES):
        ask = query_at[k:k + QUERIES]
        own = np.arange(k, k + len(ask)) if len(lanes_at) == len(query_at) and part.max() == part.min() else None
        hit = within(values[ask], lanes, len(lanes_at), radius, skip, own)
        for q, row in zip(ask, hit):
            near = np.append(lanes_at[row], q)
            if len(near) > 1:
                root = parent[near]
                while (up := parent[root]).tolist() != root.tolist():
                    root = up
                parent[root] = root.min()
                parent[near] = root.min()
    while (parent[parent] != parent).any():
        parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(values)))
    return values[moved], values[parent[moved]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` (long) that span the links within the radius."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = prints.select("fp", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("band", "key"))
    # at most 2 ** (64 / (radius + 1)) keys a band: small enough to broadcast
    large = rows.groupBy("band", "key").count().where(F.col("count") > BLOCK)
    rows = rows.join(F.broadcast(large), ["band", "key"], "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK))
    own = F.pmod(F.xxhash64("fp"), F.col("n"))
    rows = (rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
            .select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp"))

    def compare(table: pa.Table) -> pa.Table:
        values = table["fp"].to_numpy().view(np.uint64)
        if len(values) < 2:
            return _EDGES.empty_table()
        a, b = _local_edges(values, table["own"].to_numpy(), radius, masks[table["band"][0].as_py()])
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_EDGES)

    return rows.groupBy("band", "key", "lo", "hi").applyInArrow(compare, "a long, b long")


def with_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` and a column ``fp``: the fingerprint's 64 bits as a long."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def fp(text: pa.Array) -> pa.Array:
        return pa.array(fingerprints(text, shingle).view(np.int64))

    # not to be computed again for a filter on it
    return docs.withColumn("fp", fp.asNondeterministic()(F.col(text_col)))


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) from (id, fp): component_id is the smallest id of all fingerprints linked to fp."""
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(least, radius))
    rooted = least.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    A-Z are lower-cased; each shingle of ``shingle`` words (repeats count) votes with its XXH64; fewer words are
    one shingle; a null, empty or wordless text has fingerprint zero. Fingerprints link at ``radius`` or fewer
    differing bits, and ``component_id`` is the smallest id reachable (null ids are not smaller than others; a
    component of null ids alone has null). Repeated rows come back as often; other columns are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = cut(with_fingerprint(rows, "text", shingle).select("id", "fp"))
    return prints.join(classes(prints, radius), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps one: a row of the smallest id.

    Of several rows with that id (repeated rows, or ids that are null), any one is kept.
    """
    # the input's columns travel in one struct, whatever their names
    rows = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    printed = with_fingerprint(rows, "text", shingle)
    prints = cut(printed.select("id", "fp"))
    groups = classes(prints, radius)
    kept = printed.join(groups, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return kept.dropDuplicates(["root"]).select("row.*")
