"""Merkle dataset manifest with octopus multiproofs.

Rows are leaves. A group's leaves in their order form a tree of runs of 16; the groups' roots, in the groups' order, form
one more tree above. ``manifest`` hashes every row once (only digests move afterwards), numbers the leaves by ranges, and
builds a level by one small aggregation. ``proofs`` deals contiguous blocks of leaves to tasks: a block works out the
minimal union of node coordinates it can't derive itself, all blocks fetch theirs in one join, and each block derives
the interiors its leaves share and expands every leaf's own proof from them.

Digests are lowercase hex sha256. Nulls: a null value hashes as ``-``; null groups and ids come first. Equal rows are leaves
of their own, side by side. An empty table has no nodes. Only the named columns are read, so other names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.operators.ranks import ordered
from trialscope.session import cut_lineage

#: nodes of a run
WIDTH = 16
#: leaves of a block: some 6 kB of proof each
BLOCK = 1 << 13
#: leaves of a range of the order
RANGE = 1 << 17
GROUPS, TOP = 0, 1


class Manifest(NamedTuple):
    """``leaves``: the ids, ``leaf``, ``presented``, ``at`` (place in all), ``g`` (group's number), ``pos`` and ``n`` in it,
    ``n_groups``. ``nodes``: tree, g, level, idx, digest; the root is the top tree's one node with ``last``."""

    leaves: DataFrame
    nodes: DataFrame


def written(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(written, values)), "UTF-8"), 256)


def _sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // WIDTH))
    return out


def _levels(nodes: DataFrame, tree: int, most: int) -> DataFrame:
    """All nodes of the trees whose lowest level is ``nodes`` (g, idx, n, digest); n is a level's size, root where 1.

    ``most`` is the greatest n.
    """
    now, every = nodes.select("g", "idx", "n", "digest"), []
    for level in range(len(_sizes(most))):
        if level:
            run = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # at most WIDTH nodes
            up = now.where("n > 1").groupBy("g", F.expr(f"idx div {WIDTH}").alias("up"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"))
            now = cut_lineage(up.agg(F.sha2(F.array_join(run["digest"], "").cast("binary"), 256).alias("digest")).withColumnRenamed("up", "idx"))
        every.append(now.withColumns({"level": F.lit(level), "tree": F.lit(tree)}))
    out = every[0]
    for level in every[1:]:
        out = out.unionByName(level)
    return out


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, presented: Column | None = None) -> Manifest:
    """The tree of ``docs``: leaves hash ``fields``; ``presented`` is a digest to be proven in a leaf's place (null: the leaf)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(group).alias("group"), F.col(order).alias("id"), digest(*map(F.col, fields)).alias("leaf"),
                       (F.lit(None).cast("string") if presented is None else presented).alias("presented"))
    # equal rows part by their place in the input, once that place is written down
    rows = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id()))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    placed = ordered(rows, ["group", "id", "leaf", "tie"], "at", ranges)
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = ordered(groups, ["group"], "g")
    most, n_groups = groups.agg(F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
    leaves = placed.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select(
        "id", "leaf", "presented", "at", "g", (F.col("at") - F.col("first")).alias("pos"), "n", F.lit(n_groups).cast("long").alias("n_groups"))
    leaves = cut_lineage(leaves)
    below = _levels(leaves.select("g", F.col("pos").alias("idx"), "n", F.col("leaf").alias("digest")), GROUPS, most)
    tops = below.where("n = 1").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(n_groups).cast("long").alias("n"), "digest")
    return Manifest(leaves, below.unionByName(_levels(tops, TOP, max(1, n_groups))))


def octopus(known: np.ndarray, n: int) -> Iterable[tuple[int, np.ndarray]]:
    """(level, indexes) of the fewest nodes from which, with the ``known`` leaves of n, every run above them can be hashed."""
    level, known = 0, np.unique(known)
    while n > 1:
        runs = np.unique(known // WIDTH)
        every = (runs[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        yield level, np.setdiff1d(every[every < n], known, assume_unique=True)
        level, known, n = level + 1, runs, -(-n // WIDTH)


def missing(block: pa.Table) -> pa.Table:
    """The coordinates that a block of leaves has to fetch, the root's among them."""
    g, pos, n = (block.column(c).to_numpy() for c in ("g", "pos", "n"))
    out = [[], [], [], []]

    def want(tree: int, of: int, level: int, idx: np.ndarray) -> None:
        for column, values in zip(out, (np.full(len(idx), tree), np.full(len(idx), of), np.full(len(idx), level), idx)):
            column.append(values.astype(np.int64))

    groups, first = np.unique(g, return_index=True)
    order = np.argsort(g, kind="stable")
    for of, size, places in zip(groups.tolist(), n[first].tolist(), np.split(pos[order], np.cumsum(np.unique(g, return_counts=True)[1])[:-1])):
        for level, idx in octopus(places, size):
            want(GROUPS, of, level, idx)
    n_groups = block.column("n_groups")[0].as_py()
    for level, idx in octopus(groups, n_groups):
        want(TOP, 0, level, idx)
    want(TOP, 0, len(_sizes(n_groups)) - 1, np.zeros(1, np.int64))
    tree, of, level, idx = map(np.concatenate, out)
    return pa.table({"block": np.full(len(idx), block.column("block")[0].as_py()), "tree": tree.astype(np.int32), "g": of,
                     "level": level.astype(np.int32), "idx": idx})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Tree:
    """The part of one tree that a block knows: its own nodes, the fetched ones, and the interiors derived from both."""

    def __init__(self, n: int, own: dict[int, str], fetched: dict[int, dict[int, str]]):
        self.sizes = _sizes(n)
        self.known = [own]
        for level, size in enumerate(self.sizes[:-1]):
            here = self.known[level]
            ups = {i // WIDTH for i in here}
            here.update(fetched.get(level, {}))
            self.known.append({u: sha("".join(here[i] for i in range(u * WIDTH, min(u * WIDTH + WIDTH, size)))) for u in ups})
        self.paths: dict[tuple[int, int], tuple] = {}

    def root(self) -> str:
        return self.known[-1][0]

    def step(self, level: int, i: int) -> tuple[str, str]:
        """The siblings left and right of a node, each joined."""
        here, first = self.known[level], i - i % WIDTH
        last = min(first + WIDTH, self.sizes[level])
        return "".join(here[k] for k in range(first, i)), "".join(here[k] for k in range(i + 1, last))

    def path(self, level: int, i: int) -> tuple:
        """Steps from a node to this tree's root; those of interiors are kept, as many leaves share them."""
        if level == len(self.sizes) - 1:
            return ()
        if (level, i) not in self.paths:
            self.paths[level, i] = (self.step(level, i), *self.path(level + 1, i // WIDTH))
        return self.paths[level, i]

    def leaf_path(self, i: int) -> tuple:
        return (self.step(0, i), *self.path(1, i // WIDTH)) if len(self.sizes) > 1 else ()


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    for left, right in path:
        node = sha(left + node + right)
    return node


def expand(block: pa.Table, fetched: pa.Table) -> pa.Table:
    """A block's leaves with subroot, root, their proof (siblings joined, leaf to root) and the root ``presented`` leads to."""
    got: dict[tuple[int, int], dict[int, dict[int, str]]] = {}
    for tree, of, level, idx, value in zip(*(fetched.column(c).to_pylist() for c in ("tree", "g", "level", "idx", "digest"))):
        got.setdefault((tree, of), {}).setdefault(level, {})[idx] = value
    g, pos, n, leaf = (block.column(c).to_pylist() for c in ("g", "pos", "n", "leaf"))
    shown = block.column("presented").to_pylist()
    own: dict[int, dict[int, str]] = {}
    size = dict(zip(g, n))
    for of, i, value in zip(g, pos, leaf):
        own.setdefault(of, {})[i] = value
    below = {of: _Tree(size[of], nodes, got.get((GROUPS, of), {})) for of, nodes in own.items()}
    n_groups = block.column("n_groups")[0].as_py()
    above = _Tree(n_groups, {of: t.root() for of, t in below.items()}, got.get((TOP, 0), {}))
    root = got[TOP, 0][len(above.sizes) - 1][0]  # as the manifest holds it
    proof, folded = [], []
    for of, i, value, other in zip(g, pos, leaf, shown):
        path = (*below[of].leaf_path(i), *above.path(0, of))
        proof.append("".join(s for step in path for s in step))
        folded.append(fold(value if other is None else other, path))
    out = {"id": block.column("id"), "leaf": block.column("leaf"), "subroot": [below[of].root() for of in g], "root": [root] * len(g),
           "proof": pa.array(proof, pa.large_string()).cast(pa.string()), "folded_root": folded, "verified": [f == root for f in folded]}
    return pa.table(out)


def proofs(m: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof, folded_root (from ``presented``, else the leaf), verified (folded to the root) of every leaf."""
    leaves = m.leaves.withColumn("block", F.expr(f"at div {BLOCK}"))
    wanted = leaves.select("block", "g", "pos", "n", "n_groups").groupBy("block").applyInArrow(
        missing, "block long, tree int, g long, level int, idx long")
    fetched = wanted.join(m.nodes.select("tree", "g", "level", "idx", "digest"), ["tree", "g", "level", "idx"])
    id_type = m.leaves.schema["id"].dataType.simpleString()
    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(
        expand, f"id {id_type}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
