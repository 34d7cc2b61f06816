"""LM scoring by Ziv-Merhav cross-parsing.

Reference texts of a language (in the query: all documents that ``labels`` calls
good and not toxic, so they grow with the input) are cut into lines, and every
line is dealt by a hash of its content into shards of about ``SHARD_CHARS`` code
points; every reference line is in exactly one. A document's lines are dealt by
the same hash, so a line meets its own copies wherever in the reference they
are, and equal texts get equal scores whatever their ids. Each line is factored
greedily into longest matches with its shard, by the suffix automaton of the
shard's lines (its states as intervals of a suffix array); a match must occur
outside the document itself, so states know the only document that holds them. c phrases against a shard of length m cost
c log2(m) bits; summed over lines and divided by the text's n code points they
give the cross entropy, and less the document's own LZ78 rate k log2(k) / n the
relative entropy, in bits a code point: low for text like the reference. With
``whole``, as in the query, a line is parsed against all reference lines of its
language instead (llm/phraseindex.py), m being the code points of them all, and
nothing depends on the shards. Shards that many lines meet are repeated, so neither a hot language nor a line that
repeats in a third of the documents makes a large task.

Defined cases: null or empty text has no phrases and null scores; a text whose
language is null or without reference has null counts (but ``n_chars``) and null
scores; a line whose shard holds no text but its own costs one phrase a code
point; repeated rows are scored alike; a reference document with a null id
can't be named; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.phraseindex import build, opened
from lexiloom.llm.shared import checkpointed

SHARD_CHARS = 1 << 16
#: Lines that one copy of a shard parses; shards with more are repeated.
LINES_PER_TASK = 20_000
#: Reference ids, and shards, that are broadcast (some 10 bytes each); beyond, a shuffled join.
MAX_BROADCAST_IDS = 1_000_000
#: Characters whose counts are held for every position; larger alphabets are searched.
MAX_DENSE = 256
#: Fewer lines than that are walked one by one.
FEW_LINES = 24
#: Tables of automata, and lines, that are parsed in one go (more than one shard's only if they fit).
JOINED_BYTES, MAX_LINES = 96 << 20, 10_000


def _suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions of ``codes`` (from 0 on) in the order of their suffixes, by prefix doubling of what is still tied."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length() + 1)
    span = 63 // bits
    padded = np.concatenate([codes.astype(np.int64) + 1, np.zeros(span, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(span):
        key = (key << bits) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    rank = np.zeros(n + 1, np.int64)  # a suffix has the first place of those it is tied with, from 1 on; 0: the end

    def ranked(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks for sorted ``keys`` at ``places``; returns which are still tied."""
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        rank[order[places]] = first + 1
        return ~(new & np.concatenate([new[1:], [True]]))

    places = np.arange(n)
    tied = ranked(places, key)
    while tied.any():
        places = places[tied]
        at = order[places]
        key = rank[at] * (n + 1) + rank[np.minimum(at + span, n)]
        sort = np.argsort(key)
        order[places] = at[sort]
        tied = ranked(places, key[sort])
        span *= 2
    return order


class SuffixAutomaton:
    """The automaton of all substrings of some lines, its states as intervals.

    A state is the set of places where its strings end: an interval of the suffix
    array of the reversed lines, and a transition is one step of backward search
    there, so nothing but the array's character counts is stored. States know
    whether all their places lie in one document.
    """

    def __init__(self, lines: list[str], owners: list[int] | None = None):
        once: dict[str, int | None] = {}
        for line, own in zip(lines, owners or [None] * len(lines), strict=True):
            once[line] = own if once.get(line, own) == own else None
        # between lines a code that no query has
        points = np.frombuffer("\0".join(once).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, once), np.int64, len(once))
        breaks = np.zeros(len(points), bool)
        breaks[np.cumsum(lengths[:-1] + 1) - 1] = True
        self.alphabet, codes = np.unique(points, return_inverse=True)
        codes = np.where(breaks, 0, codes + 1)[::-1]
        codes = np.append(codes, 0)
        self.n, self.letters = len(codes), len(self.alphabet) + 1
        order = _suffix_array(codes)
        last = codes[order - 1]  # of the first suffix the last code, a break
        self.size = int(lengths.sum())
        ends = np.cumsum(np.bincount(codes, minlength=self.letters + 1))
        self.low = np.concatenate([[0], ends[:-1]])
        self.low[self.letters] = 0  # the code of characters that the lines lack: no transition
        self.high = ends.copy()
        self.high[[0, self.letters]] = self.low[[0, self.letters]]
        self.names = {own: k for k, own in enumerate(dict.fromkeys(o for o in once.values() if o is not None))}
        owner = np.repeat([self.names.get(o, -1) for o in once.values()], lengths + 1)[::-1]
        self.owner = np.append(owner[np.minimum(order, len(owner) - 1)], -1)
        change = np.nonzero(np.append(self.owner[1:] != self.owner[:-1], True))[0] + 1
        self.run_end = np.repeat(change, np.diff(np.concatenate([[0], change])))
        if self.letters <= MAX_DENSE:
            counts = np.zeros((self.letters + 1, self.n + 1), np.int32)
            for c in range(1, self.letters):
                np.cumsum(last == c, out=counts[c, 1:])
                counts[c] += self.low[c]
            self.counts = counts.reshape(-1)
        else:
            self.counts = None
            places = np.argsort(last, kind="stable")
            self.keys = last[places] * (self.n + 1) + places
            self.first = np.searchsorted(self.keys, np.arange(self.letters + 1) * (self.n + 1))

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, self.letters)

    def searched(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` goes by the character of code ``c``, for an alphabet whose counts aren't held."""
        found = np.searchsorted(self.keys, c * (self.n + 1) + at) - self.first[c] + self.low[c]
        return np.where((c == self.letters) | (c == 0), 0, found)

    def phrases(self, lines: list[str], owners: list[int | None] | None = None) -> np.ndarray:
        return parse([(self, lines, owners or [None] * len(lines))])[0]


class _Joined:
    """Several automata side by side: their tables one after another, so that lines of all of them advance in one step."""

    def __init__(self, automata: list[SuffixAutomaton]):
        self.one = automata[0] if len(automata) == 1 else None
        pack = (lambda arrays: arrays[0]) if self.one else np.concatenate
        self.counts = pack([a.counts for a in automata]) if automata[0].counts is not None else None
        self.owner, self.run_end = pack([a.owner for a in automata]), pack([a.run_end for a in automata])
        self.low, self.high = pack([a.low for a in automata]), pack([a.high for a in automata])
        starts = lambda sizes: np.cumsum([0, *sizes[:-1]])
        self.n = np.array([a.n for a in automata])
        self.at_letter = starts([len(a.low) for a in automata])
        self.at_place = starts([len(a.owner) for a in automata])
        self.at_count = starts([0 if a.counts is None else len(a.counts) for a in automata])

    def to(self, c: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.counts[row + at] if self.counts is not None else self.one.searched(c, at)


def parse(jobs: list[tuple[SuffixAutomaton, list[str], list[int | None]]]) -> list[np.ndarray]:
    """Phrases of the greedy parse of the lines of each job: longest matches, or one code point that the automaton's lines lack.

    With a line's owner, what only that document holds is no match. All lines
    advance together; automata with a searched alphabet come alone.
    """
    joined = _Joined([a for a, _, _ in jobs])
    sizes = [len(lines) for _, lines, _ in jobs]
    of = np.repeat(np.arange(len(jobs)), sizes)
    lengths = np.fromiter((len(x) for _, lines, _ in jobs for x in lines), np.int64, sum(sizes))
    codes = np.concatenate([a.codes("".join(lines)) for a, lines, _ in jobs])
    order = np.argsort(-lengths, kind="stable")
    starts, ends, of = (np.cumsum(lengths) - lengths)[order], lengths[order], of[order]
    own = np.array([-2 if o is None else a.names.get(o, -2) for a, _, owners in jobs for o in owners], np.int64)[order]
    n, letter, place, table = joined.n[of], joined.at_letter[of], joined.at_place[of], joined.at_count[of]
    count, held = np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    low, high = np.zeros(len(of), np.int64), n.copy()
    owner, run_end = joined.owner, joined.run_end
    active = np.searchsorted(-ends, -np.arange(int(ends[0]) if len(ends) else 0), "left")  # lines longer than each step
    t = 0
    for t, m in enumerate(active.tolist()):
        if m < FEW_LINES:
            break
        c = codes[starts[:m] + t]
        row = table[:m] + c * (n[:m] + 1)
        to_low, to_high = joined.to(c, row, low[:m]), joined.to(c, row, high[:m])
        at = place[:m] + to_low
        # a state must have a place, and one outside the line's own document
        ok = (to_low < to_high) & ((owner[at] != own[:m]) | (run_end[at] < to_high))
        low[:m], high[:m] = to_low, to_high
        bad = np.nonzero(~ok)[0]
        if len(bad):
            count[bad] += held[bad]
            again = letter[bad] + c[bad]
            root_low, root_high = joined.low[again], joined.high[again]
            at = place[bad] + root_low
            good = (root_low < root_high) & ((owner[at] != own[bad]) | (run_end[at] < root_high))
            low[bad], high[bad] = np.where(good, root_low, 0), np.where(good, root_high, n[bad])
            count[bad] += ~good
            ok[bad] = good
        held[:m] = ok
    else:
        t = len(active)
    for k in range(int(active[t]) if t < len(active) else 0):
        a = jobs[of[k]][0]
        count[k], held[k] = _walk(a, codes[starts[k] + t : starts[k] + ends[k]], int(low[k]), int(high[k]), int(own[k]), int(count[k]), bool(held[k]))
    out = np.empty(len(of), np.int64)
    out[order] = count + held
    return np.split(out, np.cumsum(sizes)[:-1])


def _walk(a: SuffixAutomaton, codes: np.ndarray, low: int, high: int, own: int, count: int, held: bool) -> tuple[int, bool]:
    """One line from a state on, code by code."""
    n, owner, run_end, root_low, root_high = a.n, memoryview(a.owner), memoryview(a.run_end), a.low.tolist(), a.high.tolist()
    counts = memoryview(a.counts) if a.counts is not None else None
    for c in codes.tolist():
        if counts is not None:
            x, y = counts[c * (n + 1) + low], counts[c * (n + 1) + high]
        else:
            x, y = map(int, a.searched(np.array([c, c]), np.array([low, high])))
        if x < y and (owner[x] != own or run_end[x] < y):
            low, high, held = x, y, True
            continue
        count += held
        x, y = root_low[c], root_high[c]
        held = x < y and (owner[x] != own or run_end[x] < y)
        if held:
            low, high = x, y
        else:
            low, high, count = 0, n, count + 1
    return count, held


def own_phrases(text: str) -> int:
    """Phrases of the LZ78 parse of ``text`` by itself."""
    count, root = 0, {}
    here = root
    for c in text:
        below = here.get(c)
        if below is None:
            here[c] = {}
            count += 1
            here = root
        else:
            here = below
    return count + (here is not root)


MICRO = 1_000_000
LINES = "row_id long, doc_id long, lang string, is_reference boolean, n_chars long, n_own_phrases long, line string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, doc_id, text, lang, is_reference) as lines, each with the text's own counts."""
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for row_id, doc_id, text, lang, is_reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = own_phrases(text)
            rows += [(row_id, doc_id, lang, is_reference, len(text), own, line) for line in [x for x in text.split("\n") if x] or [""]]
            size += len(text)
            if size > MICRO:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str = LINES) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


PARSED = "row_id long, doc_id long, n_chars long, n_own_phrases long, phrases long, bits long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, is_doc, row_id, doc_id, is_reference, n_chars, n_own_phrases, line), sorted by key with the reference first.

    Memory: the automata of JOINED_BYTES, and a batch of lines. ``bits`` in millionths, whole numbers, so that their sum doesn't hang on its order.
    """
    key, lines, owners, automaton, size = None, [], [], None, 0
    waiting: list[tuple[SuffixAutomaton, list[tuple], int]] = []
    told = lambda rows, phrases, size: _batch([(*r[:4], p, round(p * math.log2(size) * MICRO)) for r, p in zip(rows, phrases, strict=True)], PARSED)

    def flush() -> Iterator[pa.RecordBatch]:
        dense = [w for w in waiting if w[0].counts is not None]
        for group in [dense] * bool(dense) + [[w] for w in waiting if w[0].counts is None]:
            found = parse([(a, [r[4] for r in rows], [r[5] for r in rows]) for a, rows, _ in group])
            for (_, rows, size), phrases in zip(group, found, strict=True):
                yield told(rows, phrases.tolist(), size)
        waiting.clear()

    for batch in batches:
        keys, is_doc, row_id, doc_id, is_reference, n_chars, own, line = (c.to_pylist() for c in batch.columns)
        n, at = len(keys), 0
        while at < n:
            if keys[at] != key:
                key, lines, owners, automaton = keys[at], [], [], None
            end = at
            while end < n and keys[end] == key and is_doc[end] == is_doc[at]:
                end += 1
            if not is_doc[at]:
                lines += line[at:end]
                owners += doc_id[at:end]
                at = end
                continue
            rows = [(row_id[k], doc_id[k], n_chars[k], own[k], line[k], doc_id[k] if is_reference[k] else None) for k in range(at, end)]
            at = end
            if key is None:
                yield _batch([(*r[:4], None, None) for r in rows], PARSED)
                continue
            if automaton is None and lines:
                automaton, size = SuffixAutomaton(lines, owners), max(2, sum(map(len, lines)))
                lines, owners = [], []
            if automaton is None:  # no line of the reference in this shard
                yield told(rows, [len(r[4]) for r in rows], 2)
                continue
            waiting.append((automaton, rows, size))
            if sum(a.n * 4 * a.letters for a, _, _ in waiting) > JOINED_BYTES or sum(len(r) for _, r, _ in waiting) > MAX_LINES:
                yield from flush()
    if waiting:
        yield from flush()


def good_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids that are called good and not toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null and quality = 1 and toxic = 0")
    return good.select("doc_id")


WHOLE = "doc_id long, n_chars long, own long, phrases long, bits long"
#: Code points of the texts that are parsed in one go.
WHOLE_CHARS = 16 << 20


def _whole(rows: DataFrame) -> DataFrame:
    """(doc_id, n_chars, own, phrases, bits) of rows (doc_id, text, lang, is_reference), parsed against all reference lines of their language."""
    reference = rows.where("is_reference and lang is not null")
    # a language of which the reference has nothing but line ends is known, and without index
    known = {r.lang: (None, 2) for r in reference.where(F.length("text") > 0).select("lang").distinct().collect()}
    known |= build(reference.select(F.col("lang").alias("grp"), F.explode(F.split("text", "\n")).alias("line"), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str | None, list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, docs in waiting.items():
                if lang not in known:
                    yield _batch([(i, len(text), None, None, None) for i, text, _ in docs], WHOLE)
                    continue
                place, chars = known[lang]
                lines = [[x for x in text.split("\n") if x] for _, text, _ in docs]
                if place is None:
                    phrases = [sum(map(len, own)) for own in lines]
                else:
                    told = opened(place).phrases([x.encode() for own in lines for x in own], [i if is_reference else None for (i, _, is_reference), own in zip(docs, lines, strict=True) for _ in own])
                    ends = np.cumsum([0, *map(len, lines)])
                    sums = np.append(0, np.cumsum(told))
                    phrases = (sums[ends[1:]] - sums[ends[:-1]]).tolist()
                bits = math.log2(max(2, chars)) * MICRO
                yield _batch([(i, len(text), own_phrases(text), p, round(p * bits)) for (i, text, _), p in zip(docs, phrases, strict=True)], WHOLE)
            waiting.clear()

        for batch in batches:
            for i, text, lang, is_reference in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.setdefault(lang, []).append((i, text, is_reference))
                size += len(text) + 64
                if size > WHOLE_CHARS:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    return rows.select("doc_id", "text", "lang", "is_reference").mapInArrow(run, WHOLE)


def score(docs: DataFrame, reference_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """(doc_id, n_chars, n_phrases, n_own_phrases, cross_entropy, relative_entropy) of every row of ``docs``.

    ``reference_ids`` (doc_id): the documents that serve as reference of their language.
    ``whole``: parse against all reference lines of the language, not the line's shard of them.
    """
    ids = checkpointed(reference_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("is_reference", F.lit(True)))
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    text, lang = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang")).join(ids, "doc_id", "left").withColumn("is_reference", F.coalesce("is_reference", F.lit(False)))
    if whole:
        return _told(_whole(rows))
    sizes = rows.where("is_reference and lang is not null").groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).where("chars > 0")
    sizes = F.broadcast(checkpointed(sizes.select("lang", F.ceil(F.col("chars") / SHARD_CHARS).alias("shards"))))  # one row a language
    hashed = lambda line: F.pmod(F.xxhash64(line), F.col("shards"))
    # how many lines meet each shard; lines without a language's reference meet none
    met = rows.join(sizes, "lang").select("lang", F.explode(F.transform(F.split("text", "\n"), hashed)).alias("shard")).groupBy("lang", "shard").agg(F.count("*").alias("n"))
    repeats = checkpointed(met.select("lang", "shard", F.ceil(F.col("n") / LINES_PER_TASK).alias("repeats")).where("repeats > 1"))
    repeats = F.broadcast(repeats) if repeats.count() <= MAX_BROADCAST_IDS else repeats
    lines = rows.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "text", "lang", "is_reference").mapInArrow(_lines, LINES)
    placed = lines.join(sizes, "lang", "left").withColumn("shard", F.when(F.col("line") != "", hashed(F.col("line"))))
    placed = placed.join(repeats, ["lang", "shard"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(1).cast("long")))
    key = lambda repeat: F.concat_ws("/", F.col("shard").cast("string"), repeat.cast("string"), "lang")
    meets = F.col("shard").isNotNull()
    spread = F.pmod(F.xxhash64("row_id", F.lit("repeat")), F.col("repeats"))
    as_doc = F.array(F.struct(F.when(meets, key(spread)).alias("key"), F.lit(True).alias("is_doc")))
    as_reference = F.when(meets & F.col("is_reference"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1), lambda r: F.struct(key(r).alias("key"), F.lit(False).alias("is_doc"))))
    seats = F.explode(F.concat(as_doc, F.coalesce(as_reference, F.expr("cast(array() as array<struct<key:string,is_doc:boolean>>)"))))
    seated = placed.select(seats.alias("x"), "row_id", "doc_id", "is_reference", "n_chars", "n_own_phrases", "line", F.col("shards").isNotNull().alias("known"))
    # lines that meet no shard spread by their row; those of a known language have no phrases, others no counts
    seated = seated.select("x.key", "x.is_doc", "row_id", "doc_id", "is_reference", "n_chars", F.when(F.col("known"), F.col("n_own_phrases")).alias("n_own_phrases"), "line", F.when(F.col("x.key").isNull(), F.col("row_id")).alias("spread"))
    parsed = seated.repartition("key", "spread").sortWithinPartitions("key", "is_doc").drop("spread").mapInArrow(_parse, PARSED)
    told = parsed.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("n_own_phrases").alias("own"), F.sum("phrases").alias("phrases"), F.sum("bits").alias("bits"))
    return _told(told)


def _told(told: DataFrame) -> DataFrame:
    """The scores of (doc_id, n_chars, own, phrases, bits)."""
    phrases = F.when(F.col("own").isNotNull(), F.coalesce("phrases", F.lit(0)))
    cross = F.when(F.col("own").isNotNull() & (F.col("n_chars") > 0), F.coalesce("bits", F.lit(0)) / float(MICRO) / F.col("n_chars"))
    rate = F.when(F.col("own") > 0, F.col("own") * F.log2(F.col("own").cast("double"))) / F.col("n_chars")
    return told.select("doc_id", "n_chars", phrases.alias("n_phrases"), F.col("own").alias("n_own_phrases"), F.round(cross, 6).alias("cross_entropy"), F.round(cross - rate, 6).alias("relative_entropy"))
