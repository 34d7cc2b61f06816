"""Edit-aware token counts.

A text is parted into pre-tokens, each with its length and its number of tokens.
A segment tree per document sums both over leaves of ``LEAF`` pre-tokens. An edit
finds its leaves by the sums of lengths, re-encodes from the pre-token whose
pattern could have seen the edit up to the first border after it that the old
parting shares (from a border on, the parting depends on what follows alone), and
updates the sums above the leaves that changed. Trees are kept as two arrays a
document, so later edits don't encode the rest of the text again.

Defined cases: null text counts as empty; edits (start, end, text) in code points
apply in order, bounds are clipped to the text, null fields are 0 or empty; a
document without edits keeps its count; repeated rows and null ids are counted
like any other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the driver's tokenizers lie; a parameter of every function.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points past a pre-token's end that its pattern may have looked at.
LOOK_AHEAD = 2
LEAF = 32
#: Pieces whose counts a worker remembers.
CACHE = 500_000
MAX_RANKS_BYTES = 32 << 20


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, raw: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class Tree:
    """A text with the lengths and counts of its pre-tokens under a segment tree of sums."""

    def __init__(self, counter: Counter, text: str, lengths: list[int], counts: list[int]):
        self.counter, self.text, self.reencoded = counter, text, 0
        self._plant(lengths, counts)

    def _plant(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, its start) of the code point ``at``, or the last leaf."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = lengths, counts
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] with ``new``."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if start == end and not new:
            return
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - size
        # the first pre-token whose end, with what it looked at, reaches the edit
        leaf, at = self._leaf_at(max(0, start - LOOK_AHEAD))
        k = 0
        lengths, counts = self.leaves[leaf]
        while k < len(lengths) and at + lengths[k] + LOOK_AHEAD <= start:
            at += lengths[k]
            k += 1
        if k == len(lengths) and leaf + 1 < len(self.leaves) and lengths:
            leaf, k = leaf + 1, 0
        head = leaf, k
        # old borders after the edit, walked only as far as the new parting needs them
        tail_leaf, tail_k, border = leaf, k, at

        def advance(to: int) -> None:
            nonlocal tail_leaf, tail_k, border
            while border < to:
                own = self.leaves[tail_leaf][0]
                if tail_k < len(own):
                    border += own[tail_k]
                    tail_k += 1
                elif tail_leaf + 1 < len(self.leaves):
                    tail_leaf, tail_k = tail_leaf + 1, 0
                else:
                    break

        new_lengths: list[int] = []
        new_counts: list[int] = []
        advance(end)
        if at < len(text) or at < size:
            for m in self.counter.pattern.finditer(text, at):
                new_lengths.append(m.end() - m.start())
                new_counts.append(self.counter.count(m[0]))
                self.reencoded += 1
                if m.end() >= start + len(new):
                    advance(m.end() - shift)
                    if border == m.end() - shift:
                        break
            else:
                advance(size)
        self.text = text
        first, k = head
        before = self.leaves[first]
        if first == tail_leaf:
            own = before
            self._set(first, own[0][:k] + new_lengths + own[0][tail_k:], own[1][:k] + new_counts + own[1][tail_k:])
        else:
            after = self.leaves[tail_leaf]
            self._set(first, before[0][:k] + new_lengths, before[1][:k] + new_counts)
            for i in range(first + 1, tail_leaf):
                self._set(i, [], [])
            self._set(tail_leaf, after[0][tail_k:], after[1][tail_k:])
        if len(self.leaves[first][0]) > 8 * LEAF:
            self._plant(*self.arrays())

    def arrays(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]


def plant(counter: Counter, text: str) -> Tree:
    pieces = counter.pieces(text)
    return Tree(counter, text, [len(p) for p in pieces], [counter.count(p) for p in pieces])


_BUILT: dict[int, Counter] = {}


def _counter(raw: bytes) -> Counter:
    key = hash(raw)
    if key not in _BUILT:
        _BUILT[key] = Counter(raw)
    return _BUILT[key]


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read(MAX_RANKS_BYTES + 1)
    if len(raw) > MAX_RANKS_BYTES:
        raise ValueError(f"the ranks are larger than {MAX_RANKS_BYTES} bytes, too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def build_trees(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, lengths, counts, n_tokens): every text with its pre-tokens; the tree's leaves."""
    raw = _ranks(docs, ranks)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = rows.select("*").schema.add("lengths", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType())).add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(raw.value)
        count = counter.count
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pieces = [counter.pieces(t) for t in part.column(1).to_pylist()]
                lengths = [list(map(len, p)) for p in pieces]
                counts = [list(map(count, p)) for p in pieces]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lengths, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(map(sum, counts), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def apply_edits(trees: DataFrame, edits_col: str = "edits", ranks: str = RANKS) -> DataFrame:
    """``trees`` of ``build_trees`` after the edits of a column array<struct<start, end, text>>: (doc_id, text, lengths, counts, n_tokens, n_reencoded)."""
    raw = _ranks(trees, ranks)
    rows = trees.select("doc_id", "text", "lengths", "counts", F.col(edits_col).cast("array<struct<start:long,end:long,text:string>>").alias("edits"))
    schema = rows.select("doc_id", "text", "lengths", "counts").schema.add("n_tokens", "long").add("n_reencoded", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, lengths, counts, edits in zip(*(part.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    tree = Tree(counter, text, lengths, counts)
                    for e in edits or []:
                        if e is not None:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                    out.append((tree.text, *tree.arrays(), tree.n_tokens, tree.reencoded))
                columns = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def edit_script(id_col: str = "doc_id", text_col: str = "text"):
    """Three edits a document, by hash of its id: a replaced stretch, a deleted one, and an inserted line."""
    size = F.length(text_col).cast("long")
    at = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), size + 1)
    edit = lambda start, end, text: F.struct(start.alias("start"), end.alias("end"), F.lit(text).alias("text"))
    return F.array(edit(at(1), at(1) + 12, "revised passage"), edit(at(2), at(2) + 40, ""), edit(at(3), at(3), "\nAn added line, with 3 numbers.\n"))
