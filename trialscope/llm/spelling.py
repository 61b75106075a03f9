"""Spelling variants: words one edit apart, found by scanning sorted word lists with banded edit-matrix rows.

Two words one edit apart, the shorter of m code points, share a prefix of p and a suffix of s with p + s >= m - 1. So they
share the first half or the last half of m - 1: each word is dealt by both halves, for m its own length and one less, and
a pair is looked for where it must meet. A list of more than ``MOST`` words is dealt anew by halves of what is
left of it, down to lists that share all but one edit, which the alphabet bounds; so no list is cut and none grows with
the table. Of the lists in which a pair meets, one reports it: that of the longest prefix asked for, by the pair's own p.

In a task the lists are sorted, and every word of length m scans its list (``scan``): row i of the edit matrix needs only
its three cells around the diagonal, rows up to the LCP with the candidate before are used again, and once a row's cells
all exceed one edit, the scan goes on at the next candidate whose LCP is shorter than that row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.session import cut_lineage

#: fixed values: the letters of a run, the share of runs that lose a code point, least length and count of a word
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOISE, LEAST, TWICE, FACTOR = 31, 7, 2, 10
#: words of a list before it is dealt anew, and entries of a task
MOST, TASK = 4096, 40_000
KEY = ["m", "p", "s", "below", "stem"]
INF = 2


def vocabulary(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, n: runs of letters, a share of them misspelt by rule, of ``LEAST`` code points and ``TWICE`` uses at least.

    Null texts have no runs; a null id is written as nothing in front of the colon.
    """
    run = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    run = run.where(F.char_length("run") >= LEAST)  # a word is never longer than its run
    plain = F.char_length("run") == F.octet_length("run")
    run = run.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    run = run.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    cut = F.expr("concat(left(run, int(h % char_length(run))), substring(run, int(h % char_length(run)) + 2))")
    word = run.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST)
    return word.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def _dealt(lists: DataFrame) -> DataFrame:
    """Every entry once by the first and once by the last half of what its list leaves open (m, p, s, below, word, n)."""
    half = F.expr("(m - p - s) div 2")  # of m - 1 - p - s, rounded up
    def node(p: Column, s: Column, below: Column) -> Column:
        return F.struct(p.cast("int").alias("p"), s.cast("int").alias("s"), below.cast("int").alias("below"))

    p, s, below = F.col("p"), F.col("s"), F.col("below")
    halves = F.array(node(p + half, s, below), node(p, F.col("m") - p - half, F.least(below, p + half)))
    both = lists.select("m", "word", "n", F.explode(halves).alias("to"))
    out = both.select("m", "to.*", "word", "n")
    stem = F.expr("concat(left(word, p), ' ', right(word, s))")
    return out.withColumn("stem", stem)


def lists(words: DataFrame, most: int = MOST) -> DataFrame:
    """The lists (``KEY``) of all words; none but those that share all but one edit has more than ``most``."""
    size = F.char_length("word")
    each = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST)
    nodes = _dealt(each.select("m", F.lit(0).alias("p"), F.lit(0).alias("s"), (F.col("m") + 1).alias("below"), "word", "n"))
    out = None
    while True:
        hot = cut_lineage(nodes.groupBy(KEY).count().where((F.col("count") > most) & (F.expr("p + s < m - 1"))).select(KEY))
        if hot.isEmpty():
            return nodes if out is None else out.unionByName(nodes)
        cool = nodes.join(hot, KEY, "left_anti").select(nodes.columns)
        out = cool if out is None else out.unionByName(cool)
        nodes = _dealt(nodes.join(hot, KEY, "left_semi"))


class Sorted:
    """Words in list order: ``codes`` of all, ``at`` and ``size`` of each, ``lcp`` with the one before (-1 begins a list)."""

    def __init__(self, items: pa.Array, starts: np.ndarray):
        text = "".join(items.to_pylist())
        self.codes = np.append(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.uint32(0))
        self.size = pc.utf8_length(items).to_numpy().astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        n = len(items)
        self.lcp = np.full(n + 1, -1, dtype=np.int64)
        pairs = np.flatnonzero(~starts)
        self.lcp[pairs] = self.common(pairs - 1, pairs)
        # the next word whose lcp is less than that of this one
        self.shorter = np.full(n + 1, n, dtype=np.int64)
        lcp, stack = self.lcp.tolist(), []
        for j in range(n + 1):
            while stack and lcp[stack[-1]] > lcp[j]:
                self.shorter[stack.pop()] = j
            stack.append(j)

    def common(self, a: np.ndarray, b: np.ndarray, backward: bool = False, most: np.ndarray | None = None) -> np.ndarray:
        """Code points that words a and b have in common at their beginning (or end), counted up to ``most``."""
        least = np.minimum(self.size[a], self.size[b])
        least = least if most is None else np.minimum(least, most)
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(least > 0)
        while len(live):
            x, y, k = a[live], b[live], out[live]
            if backward:
                same = self.codes[self.at[x] + self.size[x] - 1 - k] == self.codes[self.at[y] + self.size[y] - 1 - k]
            else:
                same = self.codes[self.at[x] + k] == self.codes[self.at[y] + k]
            live = live[same]
            out[live] += 1
            live = live[out[live] < least[live]]
        return out


def scan(words: Sorted, lanes: np.ndarray, first: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) of all pairs exactly one edit apart: each lane's word scans its list from ``first`` on.

    All words of a list share ``shared`` code points, so the rows up to there are known. All lanes take a step at once:
    one row of the matrix, or the end of a candidate.
    """
    size, codes, at, lcp, shorter = words.size, words.codes, words.at, words.lcp, words.shorter
    m = size[lanes]
    base = np.concatenate(([0], np.cumsum(m + 3)))
    rows = np.full((base[-1], 3), INF, dtype=np.int8)  # cells (i, i - 1), (i, i), (i, i + 1) of row i
    rows[:, 0], rows[:, 1], rows[:, 2] = 1, 0, 1
    rows[base[:-1], 0] = INF
    q, j, i, m, base = lanes.copy(), first.copy(), shared.copy(), m, base[:-1]
    found_q, found_j = [], []
    while len(q):
        ended = i == size[j]
        # a candidate's end: the cell at the query's length is the distance
        e = np.flatnonzero(ended)
        off = m[e] - i[e] + 1
        near = (off >= 0) & (off <= 2)
        hit = e[near][rows[base[e][near] + i[e][near], off[near]] == 1]
        hit = hit[q[hit] != j[hit]]
        found_q.append(q[hit])
        found_j.append(j[hit])
        # one more row for the others
        r = np.flatnonzero(~ended)
        i_r, m_r, base_r = i[r], m[r], base[r]
        c = codes[at[j[r]] + i_r]
        above = rows[base_r + i_r]
        start = at[q[r]] + i_r
        cell = np.empty((len(r), 3), dtype=np.int8)
        cell[:, 0] = np.minimum(above[:, 0] + (codes[start - 1] != c), above[:, 1] + 1)
        cell[:, 1] = np.minimum(np.minimum(above[:, 1] + (codes[np.minimum(start, len(codes) - 1)] != c), above[:, 2] + 1), cell[:, 0] + 1)
        cell[:, 2] = np.minimum(above[:, 2] + (codes[np.minimum(start + 1, len(codes) - 1)] != c), cell[:, 1] + 1)
        cell[i_r + 1 > m_r, 1] = INF  # beyond the query's end
        cell[i_r + 2 > m_r, 2] = INF
        cell[i_r > m_r, 0] = INF
        np.minimum(cell, INF, out=cell)
        alive = cell.min(axis=1) < INF
        rows[base_r[alive] + i_r[alive] + 1] = cell[alive]
        i[r[alive]] += 1
        # candidates that ended, and ranges that share the row that exceeds one edit
        on = np.concatenate((e, r[~alive]))
        depth = np.concatenate((np.full(len(e), np.iinfo(np.int64).max), i_r[~alive] + 1))
        to = j[on] + 1
        while len(jump := np.flatnonzero(lcp[to] >= depth)):
            to[jump] = shorter[to[jump]]
        j[on] = to
        i[on] = np.minimum(i[on], lcp[to])
        if (lcp[to] < 0).any():
            stay = np.ones(len(q), dtype=bool)
            stay[on[lcp[to] < 0]] = False
            q, j, i, m, base = q[stay], j[stay], i[stay], m[stay], base[stay]
    return np.concatenate(found_q) if found_q else lanes[:0], np.concatenate(found_j) if found_j else lanes[:0]


def near_pairs(entries: pa.Table) -> pa.Table:
    """word, near, n (of near): the pairs that the lists of one task have to report, both ways."""
    entries = entries.sort_by([(k, "ascending") for k in (*KEY, "item")]).combine_chunks()
    key = [entries.column(k).combine_chunks() for k in KEY]
    n = entries.num_rows
    starts = np.zeros(n, dtype=bool)
    starts[0] = True
    for k in key:
        starts[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
    m, p, s, below = (k.to_numpy().astype(np.int64) for k in key[:4])
    words = Sorted(entries.column("item").combine_chunks(), starts)
    begin = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1
    alone = np.diff(np.append(begin, n)) == 1
    lanes = np.flatnonzero((words.size == m) & ~alone[number])
    q, j = scan(words, lanes, begin[number[lanes]], np.maximum(p, s)[lanes])
    back = s[q] > p[q]
    prefix = np.empty(len(q), dtype=np.int64)
    for flag in (False, True):
        w = np.flatnonzero(back == flag)
        prefix[w] = words.common(q[w], j[w], backward=flag, most=below[q[w]])
    own = prefix < below[q]
    q, j, back = q[own], j[own], back[own]
    longer = words.size[j] > words.size[q]  # a longer word does not scan its shorter ones
    a, b = np.concatenate((q, j[longer])), np.concatenate((j, q[longer]))
    back = np.concatenate((back, back[longer]))
    item, count = entries.column("item").combine_chunks(), entries.column("n").combine_chunks()
    left, right = item.take(pa.array(a)), item.take(pa.array(b))
    straight = pa.array(~back)
    return pa.table({"word": pc.if_else(straight, left, pc.utf8_reverse(left)), "near": pc.if_else(straight, right, pc.utf8_reverse(right)),
                     "n": count.take(pa.array(b))})


def near(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, n of near: every two words (word, n) exactly one inserted, deleted or replaced code point apart, both ways, once."""
    tasks = max(1, -(-4 * words.count() // TASK))
    entries = lists(words, most)
    entries = entries.withColumn("item", F.when(F.col("s") > F.col("p"), F.reverse("word")).otherwise(F.col("word"))).drop("word")
    entries = entries.withColumn("task", F.pmod(F.xxhash64(*KEY), F.lit(tasks)))
    return entries.groupBy("task").applyInArrow(_without_task, "word string, near string, n long")


def _without_task(entries: pa.Table) -> pa.Table:
    return near_pairs(entries.drop_columns("task"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: the last word that (word, form) links lead to, by doubling; the links have no circle."""
    at = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut_lineage(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, factor: int | Column = FACTOR, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts (word, n).

    A word's form is the near word of largest n (ties: the smallest in code-point order) if that is at least ``factor``
    times its own, else null; the root follows forms to the last, so it is the word itself where there is none.
    """
    words = cut_lineage(words)
    best = near(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))
    often = F.col("near_n") >= F.col("n") * factor
    out = cut_lineage(out.select("word", "n", "n_near", F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")))
    end = roots(out.where("form is not null"))
    return out.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
