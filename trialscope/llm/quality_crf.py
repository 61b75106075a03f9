"""Quality rules by line labelling: a linear-chain CRF marks lines as content or boilerplate.

Each line of a text is a vector of simple features. A linear-chain conditional random field with two states has a
weight a feature and state and one a transition; Viterbi decoding gives a text's best label sequence, and the
share of its words that stand in content lines decides whether it is kept. The weights are fitted by maximum
likelihood (forward-backward, gradient steps) on a bounded sample of labelled texts, in which the lines of a good
text count as content and those of a bad text as boilerplate where a line looks unlike the good texts' lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import SLICE_BYTES, SPACE, Words, hash_slices, slices, text_buffer

MIN_WORDS = 20
REPEAT_SHARE = 30
WINDOW = 8
#: the bound on labelled texts that fit the model
MAX_LABELLED = 2000
#: least share of words in content lines of a text that is kept
CONTENT_SHARE = 0.5

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FEATURES = ("bias", "symbols", "marks", "upper", "digits", "short", "long_words", "repeated", "stutter", "no_words")
TELLS = ("symbols", "marks", "upper", "digits", "repeated", "stutter")

_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                  ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                  ("content_words", pa.int64()), ("kept", pa.bool_()), ("labels", pa.binary())])


@dataclass(frozen=True)
class Crf:
    """Feature weights (features x 2 states: boilerplate 0, content 1) and transitions (from x to)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), 2)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


class Lines:
    """Lines, words and counts of consecutive texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.words = words = Words(buf, off)
        n = len(buf)
        breaks = np.flatnonzero(buf == 10)
        # a line begins at each text's start and after each newline; of equal places the earlier text's is first
        start = np.concatenate((off[:-1], breaks + 1))
        text = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1))
        order = np.lexsort((text, start))
        self.start, self.text = start[order], text[order]
        last_of_text = np.append(self.text[1:] != self.text[:-1], True)
        self.end = np.where(last_of_text, off[self.text + 1], np.append(self.start[1:] - 1, n))
        self.off = np.searchsorted(self.text, np.arange(len(off)))
        begin, end = np.searchsorted(words.start, self.start), np.searchsorted(words.start, self.end)
        self.n_words = np.where(self.end > self.start, end - begin, 0)

        def per_line(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return total[self.end] - total[self.start]

        def per_text(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return total[off[1:]] - total[off[:-1]]

        point = ~SPACE[buf] & ((buf & 0xC0) != 0x80)
        symbol = SYMBOLS[buf]
        self.word_chars, self.n_symbols = per_text(point), per_text(symbol)
        chars = np.maximum(per_line(point), 1)
        upper, digit = per_line((buf >= 65) & (buf <= 90)), per_line((buf >= 48) & (buf <= 57))
        marks = per_line((buf == 33) | (buf == 63) | (buf == 124) | (buf == 123) | (buf == 125))
        key = hash_slices(buf, self.start, self.end)
        key = key ^ (self.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a line of its own text
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = (key[order][1:] == key[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])
        self.again = again & (self.n_words > 0)
        self.n_dup_lines = np.bincount(self.text[self.again], minlength=len(off) - 1)
        has = self.n_words > 0
        per_word = chars / np.maximum(self.n_words, 1)
        # words equal to the word before them in their line
        self.hash = words.hashes()
        same = np.zeros(len(words) + 1, dtype=np.int64)
        same[1:len(words)] = np.cumsum(self.hash[1:] == self.hash[:-1])
        same[len(words):] = same[max(len(words) - 1, 0)]
        inner = np.where(has, np.maximum(end - 1, begin), begin)
        stutter = np.where(has, same[inner] - same[begin], 0)
        self.features = np.stack([
            np.ones(len(key)), np.minimum(8 * per_line(symbol) / chars, 4), np.minimum(8 * marks / chars, 4),
            np.minimum(2 * upper / chars, 2), np.minimum(4 * digit / chars, 2), (self.n_words < 4).astype(float),
            np.minimum(np.maximum(per_word - 9, 0) / 4, 4), self.again.astype(float),
            np.minimum(4 * stutter / np.maximum(self.n_words, 1), 4), (~has).astype(float)], axis=1)

    def repeat_words(self, size: int = WINDOW) -> np.ndarray:
        """Of each text, the words in windows of ``size`` words found twice or more in it."""
        words = self.words
        at = words.windows(size)
        count = np.zeros(len(words.off) - 1, dtype=np.int64)
        if not len(at):
            return count
        key = hash_slices(self.hash, at, at + size)
        key ^= words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(words) + 1, dtype=np.int32)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + size, -1)
        return np.bincount(words.doc, weights=np.cumsum(step[:-1]) > 0, minlength=len(count)).astype(np.int64)


def viterbi(scores: np.ndarray, off: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best label of each line (state 0 or 1) for sequences scores[off[i]:off[i + 1]] of two states."""
    n = len(scores)
    labels = np.zeros(n, dtype=np.int8)
    a, b = scores[:, 0].tolist(), scores[:, 1].tolist()
    (m00, m01), (m10, m11) = moves.tolist()
    from0, from1 = [0] * n, [0] * n
    for first, stop in zip(off[:-1].tolist(), off[1:].tolist()):
        if first == stop:
            continue
        x, y = a[first], b[first]
        for i in range(first + 1, stop):
            to0, to1 = y + m10 > x + m00, y + m11 > x + m01
            from0[i], from1[i] = to0, to1
            x, y = (y + m10 if to0 else x + m00) + a[i], (y + m11 if to1 else x + m01) + b[i]
        state = int(y >= x)
        for i in range(stop - 1, first, -1):
            labels[i] = state
            state = int(from1[i] if state else from0[i])
        labels[first] = state
    return labels


def fit(features: np.ndarray, labels: np.ndarray, off: np.ndarray, steps: int = 150, rate: float = 2.0, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood weights of line sequences with known labels, by forward-backward and gradient steps."""
    sizes = np.diff(off)
    pad = int(sizes.max(initial=1))
    seat = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(labels)) - np.repeat(off[:-1], sizes)
    weights, moves = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    truth = np.eye(2)[labels]
    follows = (seat[1][1:] > 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][follows], labels[1:][follows]), 1)
    total = max(len(labels), 1)
    live = np.zeros((len(sizes), pad), dtype=bool)
    live[seat] = True
    for step in range(steps):
        score = np.zeros((len(sizes), pad, 2))
        score[seat] = features @ weights
        forward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, pad):
            into = np.logaddexp(forward[:, t - 1, :1] + moves[0], forward[:, t - 1, 1:] + moves[1]) + score[:, t]
            forward[:, t] = np.where(live[:, t, None], into, forward[:, t - 1])
        backward = np.zeros_like(score)
        expected = np.zeros((2, 2))
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(pad - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            both = forward[:, t, :, None] + moves + ahead[:, None, :] - z[:, None, None]
            expected += np.where(live[:, t + 1, None, None], np.exp(both), 0).sum(axis=0)
            out = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            backward[:, t] = np.where(live[:, t + 1, None], out, 0)
        p = np.exp(forward + backward - z[:, None, None])[seat]
        down = rate / (1 + step / 50)
        weights += down * (features.T @ (truth - p) / total - ridge * weights)
        moves += down * ((seen - expected) / total - ridge * moves)
    return Crf(weights, moves)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED) -> Crf:
    """Fits the CRF on at most ``max_labelled`` labelled texts, the first by a hash of the id (half of each label).

    Whole texts teach the weights; of the rows of one id, the one of the smallest text hash does. Line
    labels start from the text's: lines of good texts are content; a bad text's line is boilerplate if it shows
    more symbols, marks, capitals, digits or repetition than 99 of 100 lines of good texts, else content. Without
    labelled texts the weights are zero and every line is content.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("good"))
    half = max_labelled // 2
    picked = known.where("good = 0").orderBy(F.xxhash64(id_col), id_col).limit(half).unionByName(
        known.where("good = 1").orderBy(F.xxhash64(id_col), id_col).limit(half))
    sample = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), "good").groupBy("id").agg(
        F.min_by(F.struct("text"), F.xxhash64("text")).alias("row"), F.first("good").alias("good")).select("row.text", "good").toPandas()
    sample = sample.assign(text=sample["text"].fillna("")).sort_values(["good", "text"])
    if sample["good"].nunique() < 2:
        return Crf()
    lines = Lines(*text_buffer(pa.array(sample["text"].tolist(), pa.string())))
    good = sample["good"].to_numpy()[lines.text] == 1
    signs = lines.features[:, 1:]
    usual = np.quantile(signs[good], 0.99, axis=0)
    tells = [FEATURES.index(f) - 1 for f in TELLS]
    odd = (signs[:, tells] > usual[tells] + 1e-9).any(axis=1)
    return fit(lines.features, (good | ~odd).astype(int), lines.off)


def score_texts(text: pa.Array, crf: Crf, share: float = CONTENT_SHARE) -> dict[str, np.ndarray | list]:
    """Counts, verdicts and line labels of whole texts."""
    buf, off = text_buffer(text)
    parts = []
    for a, b in slices(off, SLICE_BYTES):
        lines = Lines(buf[off[a]:off[b]], off[a:b + 1] - off[a])
        n_words = np.diff(lines.words.off)
        repeat = lines.repeat_words()
        labels = viterbi(lines.features @ crf.weights, lines.off, crf.moves)
        content = np.bincount(lines.text, weights=lines.n_words * labels, minlength=b - a).astype(np.int64)
        failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_SHARE * n_words)
        kept = ~failed & (content >= share * n_words)
        marks = [labels[i:j].astype(np.uint8).tobytes() for i, j in zip(lines.off, lines.off[1:])]
        parts.append((n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, repeat, failed, content, kept, marks))
    if not parts:
        parts = [tuple(np.zeros(0, np.int64) for _ in range(8)) + ([],)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "kept")
    out = {name: np.concatenate([p[k] for p in parts]) for k, name in enumerate(names)}
    return out | {"labels": [m for p in parts for m in p[8]]}


def quality(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_words, ``kept`` and ``labels`` (a byte a line: 1 content, 0 boilerplate).

    A null text has no words and one empty line, and fails the base rules. Repeated rows, null ids and texts of
    any length are scored one by one; other columns are not read; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = score_texts(batch.column("text"), crf, share)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[
                pa.array(got[f.name], f.type) for f in list(_OUT)[1:]]], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                "base_failed boolean, content_words long, kept boolean, labels binary").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, crf: Crf, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` whose text is kept, all columns."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        return pa.array(score_texts(text, crf, share)["kept"], pa.bool_())

    return docs.where(kept(F.col(text_col)))
