"""The dealt operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty
tables and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from trialscope.llm import (interpolation, line_dedup, mixing, nn_descent, phrase_automata, pieces, quality_crf, rounds,
                            secret_scan, simhash, substring_array)
from trialscope.llm.parameters import piece_model

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "a b"), (9004, "a b"), (None, "a b c"), (9005, "ab " * 400)]


def documents() -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()] + EDGES


def frame(spark, rows):
    """Rows as a table whose other columns clash with names the operators use."""
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, g long, id string, n long")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture
def groups_of(monkeypatch):
    def set_bytes(n):
        monkeypatch.setattr(rounds.Sizes.__init__, "__defaults__", (n,))
    return set_bytes


def pasted(seed, alphabet, n=70, join=""):
    rnd = random.Random(seed)
    base = [[rnd.choice(alphabet) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(n):
        t = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, 250)
            t += rnd.choice(base)[a:a + rnd.randint(3, 90)] + [rnd.choice("xyz")]
        rows.append((3 * i, join.join(t)))
    return rows + [(400, None), (401, ""), (402, join.join("a" * 500)), (403, rows[3][1]), (404, rows[3][1]), (404, rows[3][1]), (None, rows[5][1])]


@pytest.mark.parametrize("length,modulus,size", [(40, 21, 1 << 20), (25, 21, 3000), (20, 7, 1000)])
def test_suffix_array(spark, groups_of, length, modulus, size):
    groups_of(size)
    rows = pasted(1, "abcé ")
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    want = []
    for (d, _), b in zip(rows, raw):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    out = substring_array.remove_repeats(frame(spark, rows), length=length, modulus=modulus)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.span_start), bytes(r.kept)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_array_whatever_order_a_round_brings_its_rows():
    rnd = random.Random(8)
    wrong = []
    for _ in range(40):
        p = "".join(rnd.choice("abc") for _ in range(200))
        texts = ["".join(rnd.choice("xyz") for _ in range(rnd.randrange(20))) + p[a:a + m] + "Z" * rnd.randrange(3) + p[b:b + m // 2]
                 for a, m, b in ((rnd.randrange(180), rnd.randrange(5, 90), rnd.randrange(180)) for _ in range(30))]
        length, modulus = 12, 7
        seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        want = {}
        for d, t in enumerate(texts):
            gone = [False] * len(t)
            for i in range(len(t) - length + 1):
                if seen[t[i:i + length]] > 1:
                    gone[i:i + length] = [True] * length
            want[d] = "".join(x for x, g in zip(t, gone) if not g).encode()

        def group():
            order = rnd.sample(range(len(texts)), len(texts))
            rows = pa.table({"id": pa.array(order, pa.int64()), "text": pa.array([texts[i] for i in order])})
            return substring_array.Suffixes(rows, length, modulus, dict.fromkeys(range(1, 5), 2))
        flags = rounds._FLAGS.empty_table()
        for number, width in ((1, 6), (2, 12), (3, 6), (4, 12)):
            made = getattr(group(), f"step{number}")(*([flags] if number > 1 else []))[-1]
            flags = pa.concat_tables([flags, *(rounds._answer(number, width, made.table(0).filter(pc.equal(made.table(0)["b"], b))) for b in (0, 1))])
        got = substring_array._cut(group(), flags)
        wrong += [d for d, kept in zip(got["id"].to_pylist(), got["kept"].to_pylist()) if kept != want[d]]
    assert not wrong


def test_suffix_array_query_cuts_at_400_bytes(spark, tmp_path):
    """A passage of 55 words that two documents share goes if it has 400 bytes (399 characters here) and stays if it has 399."""
    from trialscope.llm import queries
    rnd = random.Random(31)
    letters = lambda n: "".join(rnd.choices("abcdefgh", k=n))
    rows, want = [], set()
    for size, removed in ((399, 0), (400, 400)):
        p = "é" + " ".join(letters(6) for _ in range(55))
        p += "x" * (size - len(p.encode()))
        assert len(p.split()) == 55
        for around in ("AB", "CD"):
            head, tail = letters(rnd.randrange(900)) + around[0], around[1] + letters(rnd.randrange(900))
            raw = (head + tail if removed else head + p + tail).encode()
            want.add((len(rows), len((head + p + tail).encode()), removed, removed // 400, hashlib.sha256(raw).hexdigest()))
            rows.append((len(rows), head + p + tail))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)


def test_difference_covers():
    for v, cover in substring_array.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("size,group,digits", [(6, 1 << 20, 64), (8, 400, 3)])
def test_phrase_automata(spark, groups_of, monkeypatch, size, group, digits):
    groups_of(group)
    monkeypatch.setattr(phrase_automata, "SHARD", 7)
    monkeypatch.setattr(phrase_automata, "DIGITS", digits)
    rows = pasted(2, ["a", "b", "ç", "d e", "f"], join=" ")
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if tuple(w[a:a + size]) in seen:
                gone[a:a + size] = [True] * size
            seen.add(tuple(w[a:a + size]))
        want.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in phrase_automata.remove_passages(frame(spark, rows), size=size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_quality_counts():
    texts = [t for _, t in documents()] + ["x\nx\n y\nx", "é\n" * 30, "a b c d e f g h\n" * 3]
    got = quality_crf.score_texts(pa.array(texts), quality_crf.Crf())
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = WORD.findall(t), t.split("\n")
        worded = [x for x in lines if WORD.search(x)]
        count = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        twice = {j for k in range(len(w) - 7) if count[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(worded) - len(set(worded)), len(twice))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert len(got["labels"][i]) == len(lines)
        assert bool(got["base_failed"][i]) == (len(w) < 20 or 100 * len(twice) > 30 * len(w))


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7):
        scores, moves = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

        def total(path):
            return sum(scores[i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))

        best = max(([k >> i & 1 for i in range(n)] for k in range(2 ** n)), key=total)
        assert quality_crf.viterbi(scores, np.array([0, n]), moves).tolist() == best


def test_quality_verdict_on_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    crf = quality_crf.train(docs, labels)
    out = quality_crf.quality(docs, crf).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.99
    assert out[out.quality == 0].kept.mean() < 0.1
    assert quality_crf.quality(docs.limit(0), crf).count() == 0


def test_line_dedup_edges(spark):
    line = "this line is long enough to count"
    rows = [(1, f"{line}\nA"), (2, f"  {line.upper()}\t\nB\n"), (3, f"C\n{line}\n{line}"), (4, None), (5, ""), (6, line), (6, line),
            (None, line), (7, "short\nshort"), (8, "short"), (9, "short")]
    out = line_dedup.drop_repeated_lines(frame(spark, rows), batches=3)
    assert out.columns == ["doc_id", "text", "g", "id", "n", "_n_lines", "_n_dropped"]
    got = sorted([(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect()], key=str)
    want = [(1, "A", 2, 1), (2, "B\n", 3, 1), (3, "C", 3, 2), (4, "", 1, 0), (5, "", 1, 0), (6, line, 1, 0), (6, line, 1, 0),
            (None, "", 1, 1), (7, "short\nshort", 2, 0), (8, "short", 1, 0), (9, "short", 1, 0)]
    assert got == sorted(want, key=str)
    assert line_dedup.drop_repeated_lines(frame(spark, rows).limit(0)).count() == 0


def test_line_dedup_hot_line(spark, monkeypatch):
    """One line of 80 documents is dealt over tasks, ten lines of three documents each are not."""
    monkeypatch.setattr(line_dedup, "HEAVY", 4)
    hot, rare = "the same line stands in every one of them", "a line of {} that only three documents hold"
    rows = [(i, "\n".join([hot, f"own {i}"] + [rare.format(k) for k in range(10) if i // 3 == k])) for i in range(80)]
    got = {r.doc_id: (r.text, r._n_dropped) for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    for i, text in rows:
        keep = [x for x in text.split("\n") if x.startswith("own") or (x == hot and i == 79) or (x.startswith("a line") and i % 3 == 2)]
        assert got[i] == ("\n".join(keep), text.count("\n") + 1 - len(keep))


def test_secret_spans(spark):
    rows = [(1, "é password: 'abcdefghijkl' x"), (2, "token: secret: abcdefghijklmnop"), (3, "AKIA" + "A1" * 7 + " AKIAAAA"),
            (4, "api_key=0123456789abcdef01"), (5, "f" * 16 + " " + "f" * 15), (6, None), (7, ""), (8, "xoxb-1234567890abc"), (8, "xoxb-1234567890abc"),
            (None, "-----BEGIN RSA PRIVATE KEY-----")]
    got = {}
    for r in secret_scan.scan(frame(spark, rows)).select("doc_id", secret_scan.written(F.col("spans")).alias("s")).collect():
        got.setdefault(r.doc_id, []).append(r.s)
    want = {}
    for d, t in rows:
        spans = []
        for k, rule in enumerate(secret_scan.BASE + secret_scan.MORE):
            for m in re.finditer(rule.pattern, t or ""):
                if len(m[rule.group]) >= rule.least:
                    spans.append((m.start(), k, f"{rule.kind}:{m.start()}:{m.end()}"))
        want.setdefault(d, []).append(",".join(s[2] for s in sorted(spans)))
    assert got == want


def test_trigram_queries():
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secret_scan.trigram_query(r"[0-9a-f]+") == []
    assert ["api", "ike", "key", "pik"] in secret_scan.trigram_query(secret_scan.BASE[0].pattern)


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "fr", "c", 1000), ("d1", "en", "e", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    out = {r.source: r.budget for r in mixing.budgets(leaves, mixing.LEVELS, {}, F.lit(400), 1).collect()}
    assert out == {"a": 10, "b": 90, "c": 100, "e": 200}  # a's shortage stays in d0/en
    out = {r.source: r.budget for r in mixing.budgets(leaves, mixing.LEVELS, {"domain": {"d1": 0}}, F.lit(400), 1).collect()}
    assert out == {"a": 10, "b": 190, "c": 200, "e": 0}


def test_mixing_rows(spark):
    rows = [(i, "w " * (i % 7 + 1)) for i in range(60)] + EDGES
    docs = frame(spark, rows).withColumns({"domain": F.lit("d"), "lang": F.when(F.col("doc_id") % 3 == 0, "en"), "source": F.lit(None).cast("string")})
    out = mixing.mix(docs, {}, (1, 2), 1, 5)
    assert out.columns == docs.columns
    # equal rows are taken together, in the order of the seeded hash, as long as the leaf's budget lasts
    items = Counter((d, t, "en" if d is not None and d % 3 == 0 else "none") for d, t in rows)
    cost = {i: len(WORD.findall(i[1] or "")) * n for i, n in items.items()}
    tokens = {lang: sum(c for i, c in cost.items() if i[2] == lang) for lang in ("en", "none")}
    least = min(tokens, key=tokens.get)
    half = sum(tokens.values()) // 2
    budget = {least: min(tokens[least], half // 2)}
    budget[({"en", "none"} - {least}).pop()] = half - budget[least] if budget[least] == tokens[least] else half // 2
    want = Counter()
    for lang, rest in budget.items():
        mine = sorted((i for i in items if i[2] == lang), key=lambda i: hashlib.md5(f"5:0:{'none' if i[0] is None else i[0]}".encode()).hexdigest())
        for i in mine:
            rest -= cost[i]
            if rest < 0:
                break
            want[i[:2]] += items[i]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert mixing.mix(docs.limit(0), {}, (1, 2)).count() == 0


def test_pieces_match_the_library():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=piece_model()), pieces.pieces(open(piece_model(), "rb").read())
    rnd = random.Random(3)
    texts = [t or "" for _, t in documents()] + ["Hello  world", " lead", "ﬁ Å é", "x" * 3000, "</s><0x41>", "a▁▁b ▁c", "日本語🎉", "a\0b"]
    texts += ["".join(rnd.choice("abcdefghéß▁ 1.") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == sp.encode(t, add_eos=True)
        assert own.decode(ids, np.array([0, len(ids)])) == [sp.decode(ids.tolist())]


def test_pieces_frame(spark):
    out = pieces.encode_decode(frame(spark, EDGES), piece_model()).collect()
    assert sorted([(r.doc_id, r.decoded) for r in out], key=str) == sorted([(d, t or "") for d, t in EDGES], key=str)


def _reach(prints, ids, radius):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("radius,block", [(4, 1 << 15), (9, 3)])
def test_simhash(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows, prints = documents(), []
    for _, t in rows:
        w = WORD.findall(lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(max(len(w) - 3, 1))] if w else []
        prints.append(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, _reach(prints, [d for d, _ in rows], radius))]
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark, rows), radius=radius).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nearest_neighbours(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table]
    dim = len(rows[0][1])
    rows += [(10_000 + i, rows[1][1]) for i in range(15)] + [(20_000, None), (20_100, [0.0] * dim), (20_200, [float("nan")] * dim), (None, rows[2][1])]
    out = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10, F.col("vec_id") % 100 == 0).toPandas()
    good = [(i, np.array(v)) for i, v in rows[:len(table) + 15]]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], dtype=np.float32).astype(float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        mine = out[out.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, len(mine) + 1))
        hit, total = hit + len(set(mine.vec_id) & set(ids[np.lexsort((ids, d))[:10]])), total + 10
    assert hit / total >= 0.9 and not set(out.query_id) & {20_000, 20_100, 20_200}


def test_neighbours_beyond_the_sample_are_introduced_later(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "PART", 8, raising=False)
    x = np.random.default_rng(5).normal(size=(400, 8))
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    graph = nn_descent.build(nodes, 10, sample=1).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = {(a, b) for a, row in enumerate(np.argsort(d, axis=1)[:, :10].tolist()) for b in row}
    assert len(near & set(zip(graph.a, graph.b))) >= 0.98 * len(near)


def test_a_task_offers_each_pair_once_and_the_nearest_only(spark):
    x = [0.0, 1.0, 3.0, 7.0, 15.0]
    sets = [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 3), (3, 4)]
    rows = pa.table({"s": [s for s, _ in sets], "node": [n for _, n in sets], "v": [[x[n]] for _, n in sets],
                     "far": [float("inf")] * 7, "new": [True] * 7})
    got = nn_descent._meet(rows, "s", 2).to_pylist()
    assert [(r["a"], r["b"], r["d"]) for r in got] == [(0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 0, 3.0), (3, 1, 6.0), (3, 0, 7.0)]
    assert nn_descent._meet(rows.slice(6), "s", 2).num_rows == 0
    graph = spark.createDataFrame([(1, 2, 0.5, True, False), (2, 1, 0.5, False, False), (3, 2, 0.7, False, False)],
                                  "a long, b long, d double, at_a boolean, at_b boolean").repartition(3)
    ranked = nn_descent._ranked(graph)
    assert sorted((r.m, r.node, r.own, r.new, r.r, r.news, r.olds) for r in ranked.collect()) == [
        (1, 2, True, False, 1, 0, 1), (2, 1, True, False, 1, 0, 2), (2, 3, False, False, 2, 0, 2), (3, 2, True, False, 1, 0, 1)]


@pytest.mark.parametrize("size", [8 << 20, 60_000])
def test_deleted_interpolation(spark, groups_of, size):
    groups_of(size)
    rows = documents()
    folds = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 for d, _ in rows]
    tokens = [WORD.findall(lower(t)) + ["</s>"] for _, t in rows]

    def counts(keep):
        one, two, before = Counter(), Counter(), Counter()
        for t, f in zip(tokens, folds):
            if keep(f):
                one.update(t)
                two.update(zip(["<s>", *t], t))
                before.update(["<s>", *t[:-1]])
        return one, two, before, sum(one.values()), len(one)

    def bucket(c):
        return 1 + int(math.log2(c)) if c else 0

    one, two, before, n, v = counts(lambda f: f not in (2, 3))
    held = [(bucket(before[u]), 1 / (v + 1), one[w] / n, two[u, w] / max(before[u], 1))
            for t, f in zip(tokens, folds) if f == 3 for u, w in zip(["<s>", *t], t)]
    b, p = np.array([h[0] for h in held]), np.array([h[1:] for h in held])
    weights = np.full((42, 3), 1 / 3)
    for _ in range(5000):
        s = weights[b] * p
        s /= s.sum(axis=1, keepdims=True)
        weights = np.stack([np.bincount(b, weights=s[:, k], minlength=42) for k in range(3)], axis=1) + 1
        weights[0, 2] = 0
        weights /= weights.sum(axis=1, keepdims=True)
    one, two, before, n, v = counts(lambda f: f != 2)
    want = []
    for (d, _), t, f in zip(rows, tokens, folds):
        parts = [(weights[bucket(before[u])], (1 / (v + 1), one[w] / n, two[u, w] / max(before[u], 1))) for u, w in zip(["<s>", *t], t)]
        want.append((str(d), f == 2, len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t),
                     sum(math.log10(float(l @ np.array(q))) for l, q in parts)))
    got = [(str(r[0]), *r[1:]) for r in interpolation.score(frame(spark, rows)).collect()]
    for x, y in zip(sorted(got), sorted(want)):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-6 and abs(x[6] / y[6] - 1) < 0.01


def test_pipeline_stages(spark):
    """run() against the stages' own brute-force properties on the smallest tables."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = quality_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    verdict = quality_crf.score_texts(pa.array(list(text.values())), crf)["kept"]
    text = {d: t for (d, t), k in zip(text.items(), verdict) if k}
    keys = {}
    for d, t in text.items():
        for line in t.split("\n"):
            keys.setdefault(lower(line.strip(" \t\n\v\f\r")), set()).add(d)
    gone = {k: max(ds) for k, ds in keys.items() if len(k) >= 20 and len(ds) >= 3}
    text = {d: "\n".join(x for x in t.split("\n") if gone.get(lower(x.strip(" \t\n\v\f\r")), d) == d) for d, t in text.items()}
    prints = [int(x) for x in simhash.fingerprints(pa.array(list(text.values())))]
    text = {d: t for (d, t), c in zip(text.items(), _reach(prints, list(text), 4)) if d == c}
    import duckdb

    from trialscope.llm.oracles import mix_sql
    from trialscope.llm.parameters import MIX, MIX_SEED

    rows = docs.select("doc_id", "lang", "source").toPandas()
    left = rows[rows.doc_id.isin(list(text))].assign(text=lambda x: x.doc_id.map(text))
    con = duckdb.connect()
    con.register("left_docs", left)
    ids = {r[0] for r in con.execute(mix_sql("left_docs", MIX, corpus_pipeline.SHARE, 1, MIX_SEED)).fetchall()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.decoded for r in out} == {d: text[d] for d in ids} and len(out) == len(ids)


def test_digests_of_queries(spark):
    """The queries derive their digests from the operators' own columns."""
    from trialscope.llm import queries

    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, SF).collect()}
    own = pieces.pieces(open(piece_model(), "rb").read())
    for d, t in documents()[:50]:
        ids = own.encode(t or "")
        assert got[d].n_tokens == len(ids) and got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
