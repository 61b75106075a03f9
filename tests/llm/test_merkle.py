"""The Merkle manifest against a brute-force tree, and its multiproofs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trialscope.llm import merkle, queries

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at long, g long, digest string, presented string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Levels of digests, bottom first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i:i + 16])) for i in range(0, len(now), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        a = i - i % 16
        yield "".join(level[a:i]), "".join(level[i + 1:a + 16])
        i //= 16


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def made(n, n_groups, seed):
    r = random.Random(seed)
    names = [None, "", "é", *(f"s{i}" for i in range(n_groups))]
    rows = [(r.choice([None, *range(n)]) if r.random() < 0.1 else i, names[0 if r.random() < 0.4 else r.randrange(len(names))],
             r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "Ab É", "plain", "X" * 5000])) for i in range(n)]
    return rows + [rows[0]] * 40 + [(None, None, None, None, None)] * 3 + [(10 ** 12, "s0", "", -1, "Z" * 300_000)]


def check(spark, monkeypatch, tmp_path, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("n,n_groups,block", [(700, 1, 1 << 13), (600, 40, 37), (30, 300, 5), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, tmp_path, n, n_groups, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    check(spark, monkeypatch, tmp_path, made(n, n_groups, n))


@pytest.mark.parametrize("rows", [[], [(7, "s", "en", 1, "Only")]])
def test_none_and_one(spark, monkeypatch, tmp_path, rows):
    check(spark, monkeypatch, tmp_path, rows)


def test_documents(spark):
    rows = [tuple(r[c] for c in FIELDS) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = queries.QUERIES["op13_merkle_manifest"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_octopus_is_minimal():
    """Everything is derivable from leaves and fetched nodes, and no fetched node is derivable from the others."""
    r = random.Random(3)
    for n in (1, 2, 16, 17, 300, 5000):
        own = np.array(sorted(r.sample(range(n), max(1, n // r.choice([1, 3, 50])))))
        need = dict(merkle.octopus(own, n))
        known = set(own.tolist())
        size = n
        for level in range(len(merkle._sizes(n)) - 1):
            fetched = set(need[level].tolist())
            runs = {i // 16 for i in known}
            assert not known & fetched
            assert known | fetched == {i for u in runs for i in range(16 * u, min(16 * u + 16, size))}
            known, size = runs, -(-size // 16)


def test_fetch_is_shared(spark):
    """A block of all leaves fetches the root alone."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    m = merkle.manifest(docs, ["doc_id"], "source", "doc_id")
    wanted = merkle.missing(m.leaves.withColumn("block", F.lit(0).cast("long")).toArrow())
    assert wanted.num_rows == 1 and wanted.column("tree")[0].as_py() == merkle.TOP
