"""Spelling variants against brute force: the vocabulary, every near pair, forms and roots."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trialscope.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def brute_words(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_near(words):
    """Pairs that meet under a deletion: equal strings after deleting at the same place (replace), or one deleted (insert)."""
    cut = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[i, w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for a in group:
            near[a] |= group - {a}
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in words and len(short) >= 7:
                near[w].add(short)
                near[short].add(w)
    return near


def brute(words, factor=10):
    near = brute_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def table(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long")


def invented(seed, letters, size, edits):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(7, 12))) for _ in range(size)]
    words = {}
    for w in base:
        words[w] = r.randint(2, 5000)
        for _ in range(edits):
            i, c = r.randrange(len(w)), r.choice(letters)
            v = r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            if len(v) >= 7:
                words.setdefault(v, r.choice([2, 2, 30, 300]))
    return words


@pytest.mark.parametrize("letters,size,edits,most", [("ab", 150, 6, 4096), ("ab", 150, 6, 9), ("abcdeéÿ", 200, 8, 20), ("a", 6, 3, 2)])
def test_variants(spark, monkeypatch, letters, size, edits, most):
    monkeypatch.setattr(spelling, "TASK", 500)
    words = invented(size, letters, size, edits)
    got = spelling.variants(table(spark, words), 10, most)
    assert sorted(map(tuple, got.collect()), key=str) == brute(words)


def test_hot_prefix_and_long_words(spark):
    """A third and more of the words share their beginning or end; some words are very long."""
    r = random.Random(8)
    words = {"prefixed" + "".join(r.choice("abc") for _ in range(5)): r.randint(2, 900) for _ in range(150)}
    words |= {"".join(r.choice("abc") for _ in range(5)) + "suffixed": r.randint(2, 900) for _ in range(150)}
    words |= {"x" * 5000: 100, "x" * 4999: 3, "x" * 2500 + "y" + "x" * 2499: 5, "z" + "x" * 4999: 1000}
    got = spelling.variants(table(spark, words), 10, 16)
    assert sorted(map(tuple, got.collect()), key=str) == brute(words)


def test_query_on_edge_rows(spark, tmp_path):
    r = random.Random(4)
    base = ["Grammar", "grammar", "élémentaire", "Élémentaire", "spelling", "vocabulary", "×÷multiply", "ÀÉÎÕÜàéîõü"]
    rows = [(k if k % 9 else None, r.choice([None, "", " ", "\n".join(r.choice(base) for _ in range(60))])) for k in range(300)]
    rows += [(5, "a" * 2_000)] * 3 + [(6, "word " * 50_000 + "Grammar-grammar9grammar")] + rows[:20]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3, 4) for d, t in rows], "doc_id long, text string, n long, word string, m int, id int, run int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(brute_words(rows))


def test_giant_words(spark):
    long = "ab" * 50_000
    docs = spark.createDataFrame([(1, f"{long} {long}"), (1, f"{long} {long}"), (2, f"{long}a {long}a")], "doc_id long, text string")
    got = {len(r.word): (r.n, r.n_near, r.form) for r in spelling.variants(spelling.vocabulary(docs)).collect()}
    assert got == {100_000: (4, 1, None), 100_001: (2, 1, None)}


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = queries.QUERIES["op11_spelling_variants"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == brute(brute_words(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(docs)).collect() == []


def test_chain_of_forms(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000}
    got = {r.word: r.root for r in spelling.variants(table(spark, words)).collect()}
    assert set(got.values()) == {"aaabbbb"}


def test_scan_reuses_rows():
    """Two candidates of one long prefix cost the second one only its own rows: a range beyond one edit is passed at once."""
    items = ["abcdefgh", *sorted("zzzz" + "".join(random.Random(k).choice("abcd") for _ in range(4)) for k in range(200))]
    starts = np.zeros(len(items), dtype=bool)
    starts[0] = True
    words = spelling.Sorted(pa.array(items), starts)
    steps = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            steps.append(np.size(key))
            return super().__getitem__(key)

    words.lcp = words.lcp.view(Counted)
    q, j = spelling.scan(words, np.array([0]), np.array([0]), np.array([0]))
    assert len(q) == 0 and len(steps) < 60
