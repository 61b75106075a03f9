"""SentencePiece BPE encoding by backtracking, and decoding.

A text, its spaces written as U+2581, falls into *units* that no merge can join: no piece holds U+2581 after
another character, a newline, or one of the vocabulary's *closing* characters (as a comma) after a Latin letter.
Each distinct unit is encoded once a worker: at a position the longest piece (by an Aho-Corasick automaton over the pieces) is tried first, then
shorter ones; a piece may follow the last one only if merging both pieces' characters again gives just these
two; positions from which nothing fits are marked in a bitfield and not tried again. The one sequence whose
neighbours are all compatible is what merging by score gives. Characters of no piece become byte pieces.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices, text_buffer

SPACE = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: cached units (some 200 bytes each) and pairs a worker keeps before it starts anew
CACHE, PAIRS = 600_000, 200_000
NONE = float("-inf")
_NO_PAIRS: dict[str, bool] = {}
_OUT = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Pieces:
    """The vocabulary of one BPE model with byte fallback and no text normalisation but the leading space."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.vocab_size())
        self.end = sp.eos_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece goes on after a space; units of this model can merge")
        self.id = {sp.id_to_piece(i): i for i in plain}
        after = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        if "\n" in {c for pair in after for c in pair}:
            raise ValueError("a piece goes on over a newline; units of this model can merge")
        latin = set(filter(re.compile(f"[{LATIN}]").match, {a for a, _ in after}))
        closing = {b for _, b in after if not b.isalnum()} - {b for a, b in after if a in latin} - {SPACE}
        c = re.escape("".join(sorted(closing)) or "\n")
        self.cut = re.compile(f"{SPACE}*[{LATIN}]++(?=[{c}])|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        singles = {c for p in self.score for c in p}
        self.whole = {p for p in self.score if len(p) == 1 or self.merge(p) == [p]} | singles
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p in self.whole}
        self.pairs: dict[str, dict[str, bool]] = {p: {} for p in self.whole}
        self.n_pairs = 0
        self.units: dict[str, bytes] = {}
        written = [b""] * len(every)
        for p, i in self.id.items():
            written[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            written[i] = bytes([b])
        written[sp.unk_id()] = " ⁇ ".encode()
        self.written = np.frombuffer(b"".join(written), dtype=np.uint8)
        self.size = np.array([len(w) for w in written], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.spaced = np.array([w[:1] == b" " for w in written]) & (np.arange(len(written)) != sp.unk_id())

    def merge(self, text: str) -> list[str]:
        """Merging by score: the best neighbouring pair first, the leftmost of equals."""
        part, score = list(text), self.score
        pair = [score.get(a + b, NONE) for a, b in zip(part, part[1:])]
        while pair and (best := max(pair)) != NONE:
            i = pair.index(best)
            part[i:i + 2] = [part[i] + part[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = score.get(part[i - 1] + part[i], NONE)
            if i < len(pair):
                pair[i] = score.get(part[i] + part[i + 1], NONE)
        return part

    def follows(self, a: str, b: str) -> bool:
        if self.n_pairs >= PAIRS:
            self.pairs, self.n_pairs = {p: {} for p in self.whole}, 0
        self.n_pairs += 1
        ok = a + b not in self.whole and self.merge(a + b) == [a, b]
        self.pairs.setdefault(a, {})[b] = ok
        return ok

    def split(self, unit: str) -> list[str]:
        """The unit's pieces (and characters of no piece), by backtracking."""
        if unit in self.whole:
            return [unit]
        longest = list(unit)
        for last, size in self.automaton.iter(unit):
            if size > len(longest[last - size + 1]):
                longest[last - size + 1] = unit[last - size + 1:last + 1]
        n, failed, pairs, shorter = len(unit), 0, self.pairs, self.shorter
        out: list[str] = []
        at, piece, known = 0, longest[0], None
        while at < n:
            while piece is not None:
                if not (failed and failed >> at + len(piece) & 1):
                    if known is None or (ok := known.get(piece)) or ok is None and self.follows(out[-1], piece):
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                piece = shorter.get(last)
            else:
                out.append(piece)
                at += len(piece)
                if at == n:
                    break
                piece = longest[at]
            known = pairs.get(out[-1], _NO_PAIRS) if out else None
        return out

    def unit_ids(self, unit: str) -> bytes:
        ids: list[int] = []
        for piece in self.split(unit):
            if piece in self.id:
                ids.append(self.id[piece])
            else:
                ids.extend(self.bytes[b] for b in piece.encode())
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, and an end id."""
        units = self.cut(SPACE + text.replace(" ", SPACE)) if text else []
        known = self.units
        new = set(units).difference(known)
        if len(known) + len(new) > CACHE:
            known = {u: known[u] for u in set(units) - new}
            self.units = known if len(known) < CACHE else {}
        for unit in new:
            known[unit] = self.unit_ids(unit)
        return np.frombuffer(b"".join([known[u] for u in units]) + np.int32(self.end).tobytes(), dtype=np.int32)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of id sequences ids[off[i]:off[i + 1]]: pieces joined, one leading space taken off."""
        size = self.size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        step = np.arange(total[-1])
        raw = self.written[step + np.repeat(self.begin[ids] - total[:-1], size)].tobytes()
        cut, out = total[off], []
        for k, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
            a += bool(b > a and self.spaced[ids[off[k]]])
            out.append(raw[a:b].decode("utf-8", "each_byte"))
        return out


@functools.lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array of int, an end id last) and ``decoded`` text.

    ``model_path`` is read by the driver; tasks get its bytes (half a megabyte). A null or empty text has the end
    id only; the text may be of any length (its ids are held once); ids may be null or repeated; other columns
    are not read. Decoding gives back the text, but U+2581, which becomes a space.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            _, off = text_buffer(batch.column("text"))
            for a, b in slices(off):
                part = batch.slice(a, b - a)
                each = [vocabulary.encode(t or "") for t in part.column("text").to_pylist()]
                ids = np.concatenate(each)
                cut = np.concatenate(([0], np.cumsum([len(e) for e in each]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(cut, ids), pa.array(vocabulary.decode(ids, cut))], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
