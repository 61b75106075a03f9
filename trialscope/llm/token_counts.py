"""Token counts with a whole-token shortcut for byte-level BPE vocabularies.

Offline (``prove``, once, on the driver; its size is the vocabulary's): every vocabulary string is merged by the rules
and kept as *single* if it ends as one token. A pre-token is merged by itself, so one that equals a single string is
one token, whatever stands around it. The task then looks pre-tokens up, and merges only the rest.

Pre-tokens are cut by the vocabulary's pattern. The library's character classes can be of another Unicode version,
so blocks of 256 code points are proven too: a text with a character of an unproven block has its pre-tokens cut by the
library's own pre-tokenizer. Strings of added tokens are cut out of the text first and count as one token each.

Memory of a task: one Arrow batch, the vocabulary, and ``KEPT`` merged pre-tokens. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: the public pattern of byte-level BPE pre-tokens
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: merged pre-tokens kept by a task, and the longest kept
KEPT, KEPT_CHARS = 200_000, 64
#: a longer text is cut up before the pattern runs
PIECE = 1 << 18
BLOCK = 256
#: symbols of a pre-token up to which pairs are scanned; the rank of a pair that is not listed
SHORT, NONE = 48, 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


LETTERS = byte_letters()


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens left when the pair of lowest rank, leftmost first, is merged until none is listed.

    A heap of candidate pairs: n log n for a pre-token of n symbols; a short one scans its few pairs.
    """
    n = len(symbols)
    if n <= SHORT:
        parts, found = list(symbols), [ranks.get(pair, NONE) for pair in zip(symbols, symbols[1:])]
        while found and (rank := min(found)) < NONE:
            i = found.index(rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), NONE)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), NONE)
        return parts
    part: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= n or ranks.get((part[i], part[j])) != rank:
            continue  # one side has been merged since
        part[i], part[j] = part[i] + part[j], None
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (rank := ranks.get((part[i], part[j]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((part[h], part[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return [p for p in part if p is not None]


@dataclass
class Proof:
    """What tasks need of a vocabulary: strings that are one token, merge ranks, added tokens, unproven characters."""

    single: frozenset[str]
    ranks: dict[tuple[str, str], int]
    added: tuple[str, ...]
    unproven: str


def _library():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


def unproven_blocks() -> str:
    """A character class of all code points but the blocks of the BMP that pattern and library cut alike."""
    cut, own = _library(), regex.compile(PATTERN)
    agreed = []
    for first in range(0, 0x10000, BLOCK):
        block = [chr(c) for c in range(first, first + BLOCK) if not 0xD800 <= c < 0xE000]
        probe = "".join(f"a{c}1!{c}! {c}\n" for c in block)
        if block and [span for _, span in cut.pre_tokenize_str(probe)] == [m.span() for m in own.finditer(probe)]:
            agreed.append(f"\\U{first:08X}-\\U{first + BLOCK - 1:08X}")
    return f"[^{''.join(agreed)}]" if agreed else r"[\s\S]"


def prove(path: str) -> Proof:
    """Reads a byte-level BPE vocabulary and proves which of its strings encode alone as one token.

    A file with a normalizer, another pre-tokenizer or added tokens that eat blanks is refused (ValueError).
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    added = spec["added_tokens"]
    odd = (model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
           or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout")
           or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added))
    if odd:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {pair: k for k, pair in enumerate(pairs)}
    byte = {letter: b for b, letter in enumerate(LETTERS)}
    single = set()
    for word in model["vocab"]:
        if all(c in byte for c in word) and len(merged(list(word), ranks)) == 1:
            try:
                single.add(bytes(byte[c] for c in word).decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a whole pre-token
    return Proof(frozenset(single), ranks, tuple(a["content"] for a in added), unproven_blocks())


class Counter(dict):
    """Tokens of a pre-token: 1 for the proven ones, the others merged when first met."""

    def __init__(self, proof: Proof):
        super().__init__(dict.fromkeys(proof.single, 1))
        self.ranks, self.single, self.most = proof.ranks, proof.single, len(proof.single) + KEPT
        self.own, self.unproven = regex.compile(PATTERN), regex.compile(proof.unproven)
        # the earliest added token is cut out, the longest of those that start there
        self.added = regex.compile("|".join(map(regex.escape, sorted(proof.added, key=len, reverse=True)))) if proof.added else None
        self.cut = _library()

    def __missing__(self, pre_token: str) -> int:
        n = len(merged([LETTERS[b] for b in pre_token.encode()], self.ranks))
        if len(pre_token) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.single, 1))
            self[pre_token] = n
        return n

    def _pieces(self, text: str) -> Iterator[str]:
        """Cuts before a blank that follows a non-blank: a pre-token always begins there."""
        at = 0
        while len(text) - at > PIECE:
            cut = regex.search(r"(?<=\S) ", text, pos=at + PIECE)
            if cut is None:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def tokens(self, text: str) -> int:
        """Tokens of a whole text."""
        n = 0
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            n += k > 0
            for piece in self._pieces(part):
                if self.unproven.search(piece):
                    found = [piece[a:b] for _, (a, b) in self.cut.pre_tokenize_str(piece)]
                else:
                    found = self.own.findall(piece)
                n += sum(map(self.__getitem__, found))
        return n


def token_counts(docs: DataFrame, proof: Proof, text: str = "text", keys: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """``keys``, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null or repeated keys stay as they are, one row out for one row in;
    an empty table gives an empty one. Columns other than ``keys`` and ``text`` are not read, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(proof)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(shared.value)
            column = batch.column(batch.num_columns - 1)
            n = pa.array([counter.tokens(t) if (t := x.as_py()) else 0 for x in column], pa.int64())
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, n, pc.greater(n, limit)],
                                             names=[*(f"k{i}" for i in range(len(keys))), "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("text"))
    fields = ", ".join(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    out = narrow.mapInArrow(count, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})
