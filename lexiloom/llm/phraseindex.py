"""A suffix array of all reference text of a group, built by many tasks and mapped by all that parse against it.

The distinct lines of a group (UTF-8, each ended by the byte 0xFF, which no text
has) stand one after another in one file. Suffixes are dealt into buckets by
their first eight bytes, at splitters from a sample, in one pass over the text; a task
sorts a bucket and writes it at its place of the one array, so buckets in order are the
suffix array. Suffixes alike in more than ``DEPTH`` bytes stay unsorted in groups of up
to ``WINDOW``, whose members searches look at one by one. The first sixteen bytes of each
``STEP``-th suffix are kept apart to start a search from. Lines know the only document that holds them.

Files are mapped, so ``spark.checkpoint.dir`` must be a folder that is mounted on
all machines. Memory of a task: one bucket, some 50 bytes a suffix. A bucket is
never cut: it holds all suffixes with the first eight bytes of a splitter.
"""

from __future__ import annotations

import contextlib
import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import _WRITTEN, checkpointed, shared_dir

#: Bytes of lines that one task writes, and suffixes that one task sorts.
PIECE, BUCKET = 8 << 20, 4 << 20
#: Suffixes sampled for a bucket.
SAMPLE = 256
STEP, DEPTH, WINDOW = 32, 24, 8
#: Neighbours in the array of one document that are passed over one by one; longer runs are noted.
RUN = 64
#: Fewer lines than FEW, with phrases of fewer than SHORT bytes, look up STRETCH places at once.
FEW, SHORT, STRETCH = 64, 64, 16_384
#: Bytes between which a chunk's keys are counted.
CHUNK = 4 << 20
#: Of an asked line of which no copy in the text is known.
NOWHERE = np.iinfo(np.int64).min // 2

END, ASKED_END = b"\xff", b"\xfe"


def _keys(text: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Eight bytes from each place on, as numbers in the order of the bytes; ``text`` has eight bytes more."""
    return _little(text)[at].astype(np.uint64).byteswap()


def _little(text: np.ndarray) -> np.ndarray:
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))


def _common(x: np.ndarray) -> np.ndarray:
    """Bytes that two words (by ``_little``) have in common before they differ, from their ``x`` = one ^ other."""
    return (np.bitwise_count(~x & (x - np.uint64(1))) >> 3).astype(np.int64)


def _alike(asked: np.ndarray, text: np.ndarray, p: np.ndarray, t: np.ndarray, known: int = 0) -> np.ndarray:
    """Bytes that ``asked`` from each ``p`` on and ``text`` from each ``t`` on (both by ``_little``) have in common; ``known`` at least.

    Words are compared one first, then more at once, as matches of copies are long. There is a difference before the end of either.
    """
    x = asked[p + known] ^ text[t + known]
    out = known + _common(x)
    active, width = np.nonzero(x == 0)[0], 1
    while len(active):
        if width == 1:
            x = asked[p[active] + out[active]] ^ text[t[active] + out[active]]
            first = 0
        else:
            ahead = out[active, None] + 8 * np.arange(width)
            x = asked[np.minimum(p[active, None] + ahead, len(asked) - 1)] ^ text[np.minimum(t[active, None] + ahead, len(text) - 1)]
            first = (x != 0).argmax(axis=1)
            x = x[np.arange(len(x)), first]
        out[active] += np.where(x == 0, 8 * width, 8 * first + _common(x))
        active, width = active[x == 0], min(2 if width == 1 else 4 * width, 64)
    return out


def _is_start(text: np.ndarray) -> np.ndarray:
    """Where code points start; no line's end."""
    return ((text & 0xC0) != 0x80) & (text != 0xFF)


def _bound(values: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, before: Callable) -> np.ndarray:
    """Between each ``low`` and ``high``, where ``values`` are sorted: the first place whose value isn't ``before`` the key."""
    low, high = low.copy(), high.copy()
    active = np.nonzero(low < high)[0]
    while len(active):
        mid = (low[active] + high[active]) >> 1
        more = before(values[mid], key[active])
        low[active] = np.where(more, mid + 1, low[active])
        high[active] = np.where(more, high[active], mid)
        active = active[low[active] < high[active]]
    return low


def _lines_at(starts: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The line of each place, searched in order, as that meets what is cached."""
    order = np.argsort(t)
    line = np.empty(len(t), np.int64)
    line[order] = np.searchsorted(starts, t[order], "right") - 1
    return line


def _folder(spark) -> str:
    place = shared_dir(spark)
    if place.startswith("file:"):
        place = "/" + place[5:].lstrip("/")
    if not place.startswith("/"):
        raise RuntimeError("the index of the reference is mapped: spark.checkpoint.dir must be a mounted folder")
    folder = f"{place}/phrases-{uuid.uuid4().hex}"
    os.makedirs(folder)
    _WRITTEN.append("file://" + folder)
    return folder


def _sort_bucket(text: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places ``at`` (whose first eight bytes are ``key``) in the order of their suffixes, groups of up to WINDOW only to DEPTH bytes."""
    order = np.argsort(key)
    at, key = at[order], key[order]
    todo, group = np.arange(len(at)), np.cumsum(np.append(True, key[1:] != key[:-1]))
    little, end, depth = _little(text), len(text) - 8, 8
    while True:
        sizes = np.bincount(group)
        keep = sizes[group] > (1 if depth < DEPTH else WINDOW)
        todo, group = todo[keep], group[keep]
        if not len(todo):
            return at
        there = at[todo]
        key = little[np.minimum(there + depth, end)].astype(np.uint64).byteswap()
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        rank += group << 32  # groups follow each other, so their numbers stay where they are
        order = np.argsort(rank)
        at[todo] = there[order]
        rank = rank[order]
        group = np.cumsum(np.append(True, rank[1:] != rank[:-1]))
        depth += 8


class Index:
    """The mapped files of one group."""

    def __init__(self, place: str):
        mapped = lambda name, kind: np.memmap(f"{place}/{name}", kind, "r").view(np.ndarray)
        self.text = mapped("text", np.uint8)
        self.array = mapped("array", np.uint32 if len(self.text) < 1 << 32 else np.int64)
        self.next_sampled = mapped("next_sampled", np.uint64)
        self.sampled, self.single = mapped("sampled", np.uint64), mapped("single", np.uint8)
        self.starts, self.owner = mapped("starts", np.int64), mapped("owners", np.int64)
        runs = [np.load(f"{place}/{x}") for x in sorted(os.listdir(place)) if x.startswith("runs-")]
        runs = np.concatenate([*runs, np.empty((0, 2), np.int64)])
        self.runs = runs[np.argsort(runs[:, 0])]
        self.little, self.n = _little(self.text), len(self.array)

    def owned(self, t: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether each place of the text is of a line that only document ``own`` holds."""
        line = _lines_at(self.starts, t)
        return (self.owner[line] == own) & (self.single[line] == 1)

    def after(self, asked: np.ndarray, q: np.ndarray, key: np.ndarray, more_key: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """For each place ``q`` of the asked text: how many suffixes of the array come before what is there.

        ``key``, ``more_key``: the first eight bytes, in order, and the eight after them; ``copy``: as in ``longest``.
        """
        # between two sampled suffixes, by eight bytes and, among equals, by eight more
        lower = np.searchsorted(self.sampled, key, "left")
        upper = lower.copy()
        equal = np.nonzero(self.sampled[np.minimum(lower, len(self.sampled) - 1)] == key)[0]
        last = np.searchsorted(self.sampled, key[equal], "right")
        lower[equal] = _bound(self.next_sampled, lower[equal], last, more_key[equal], np.less)
        upper[equal] = _bound(self.next_sampled, lower[equal], last, more_key[equal], np.less_equal)
        place, high = np.where(lower > 0, (lower - 1) * STEP + 1, 0), np.minimum(upper * STEP, self.n)
        rest = np.nonzero(place < high)[0]
        low, high, key = place[rest], high[rest], key[rest]
        words, end = _little(asked), len(self.little) - 1
        while len(rest):
            mid = (low + high) >> 1
            t = self.array[mid].astype(np.int64)
            there = self.little[t].byteswap()
            more = there < key
            same = np.nonzero(there == key)[0]
            if len(same):
                t, k = t[same], more_key[rest[same]]
                there = self.little[np.minimum(t + 8, end)].byteswap()
                more[same] = there < k
                deep = np.nonzero(there == k)[0]
                if len(deep):
                    same, t = same[deep], t[deep]
                    p = q[rest[same]]
                    new = np.nonzero(t - p != copy[rest[same]])[0]  # what is asked for ends before its copy
                    same, t, p = same[new], t[new], p[new]
                    both = _alike(words, self.little, p, t, 16)
                    more[same] = self.text[t + both] < asked[p + both]
            low, high = np.where(more, mid + 1, low), np.where(more, high, mid)
            on = low < high
            if not on.all():
                place[rest] = low
                rest, low, high, key = rest[on], low[on], high[on], key[on]
        return place

    def longest(self, asked: np.ndarray, q: np.ndarray, room: np.ndarray, own: np.ndarray, has_own: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest match of what is at each ``q``, outside document ``own`` where it has one; ``room``: bytes up to the line's end.

        ``copy``: how far from an asked line the text has that line's rest in the same document, or NOWHERE; returned
        with those found here. Most places of a reference document meet themselves, which then needs no comparison.

        On either side the nearest suffix outside the document is taken. Those alike in DEPTH bytes may be
        unsorted: then up to WINDOW of them are looked at, until one is less alike or the match fills the line.
        """
        words, end = _little(asked), len(self.little) - 1
        key = words[q].byteswap()
        order = np.argsort(key)  # neighbours in the array are asked for one after another, as that meets what is cached
        key, q, room, own, has_own, copy = key[order], q[order], room[order], own[order], has_own[order], copy[order]
        first, then = key.byteswap(), words[q + 8]
        place = self.after(asked, q, key, then.byteswap(), copy)
        best = np.zeros(len(q), np.int64)
        for step in (-1, 1):
            rows, at, looked = np.arange(len(q)), place - 1 if step < 0 else place, 0
            free = np.zeros(len(q), bool)  # whether one outside the document was met on this side
            while len(rows):
                inside = (at >= 0) & (at < self.n) & (best[rows] < room[rows])
                if not inside.all():
                    rows, at = rows[inside], at[inside]
                t = self.array[at].astype(np.int64)
                x = first[rows] ^ self.little[t]
                found = _common(x)
                same = np.nonzero(x == 0)[0]
                x = then[rows[same]] ^ self.little[np.minimum(t[same] + 8, end)]
                found[same] += _common(x)
                same = same[x == 0]
                mine = np.zeros(len(rows), bool)
                known = t[same] - q[rows[same]] == copy[rows[same]]
                mine[same[known]], found[same[known]] = True, room[rows[same[known]]]
                same = same[~known]
                found[same] = _alike(words, self.little, q[rows[same]], t[same], 16)
                asks = np.nonzero(has_own[rows] & ~mine)[0]
                if len(asks):
                    mine[asks] = self.owned(t[asks], own[rows[asks]])
                    asks = asks[mine[asks] & (found[asks] == room[rows[asks]])]
                    asks = asks[self.text[t[asks] + found[asks]] == 0xFF]
                    copy[rows[asks]] = t[asks] - q[rows[asks]]
                looked += 1
                if len(rows) == len(q):
                    free = ~mine
                    best = np.maximum(best, found * free)
                else:
                    best[rows] = np.maximum(best[rows], found * ~mine)
                    free[rows] |= ~mine
                on = mine & ~free[rows]
                if looked < WINDOW:
                    on |= found >= DEPTH
                rows, at, mine = rows[on], at[on], mine[on]
                at = np.where(mine, self._passed(at, step), at + step)
        out, copies = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
        out[order], copies[order] = best, copy
        return out, copies

    def _passed(self, at: np.ndarray, step: int) -> np.ndarray:
        if not len(self.runs):
            return at + step
        run = np.searchsorted(self.runs[:, 0], at, "right") - 1
        within = (run >= 0) & (at < self.runs[run, 1])
        return np.where(within, self.runs[run, 1] if step > 0 else self.runs[run, 0] - 1, at + step)

    def phrases(self, lines: list[bytes], owners: list[int | None]) -> np.ndarray:
        """Phrases of the greedy parse of each line: longest matches, or one code point that no line of the index has.

        All lines advance together, one phrase in each step. Where few lines are left, those with
        short phrases look up all places of a stretch at once and then take their phrases from it.
        """
        asked = np.frombuffer(ASKED_END.join(lines) + ASKED_END * 16, np.uint8)
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(lengths + 1) - 1
        q = ends - lengths
        has_own = np.array([o is not None for o in owners], bool)
        own = np.array([o or 0 for o in owners], np.int64)
        copy = np.full(len(lines), NOWHERE, np.int64)
        count, active = np.zeros(len(lines), np.int64), np.nonzero(lengths)[0]
        while len(active):
            to, copy[active] = self._next(asked, q[active], ends[active] - q[active], own[active], has_own[active], copy[active])
            short = active[(to - q[active] < SHORT) & (to < ends[active])]
            q[active] = to
            count[active] += 1
            active = active[to < ends[active]]
            if len(active) >= FEW:
                continue
            stretch = STRETCH // max(1, len(short))
            if len(short):
                at = [np.arange(q[k], min(q[k] + stretch, ends[k])) for k in short.tolist()]
                rows = np.repeat(short, [len(x) for x in at])
                at = np.concatenate(at)
                starts = (asked[at] & 0xC0) != 0x80
                at, rows = at[starts], rows[starts]
                to = dict(zip(at.tolist(), self._next(asked, at, ends[rows] - at, own[rows], has_own[rows], copy[rows])[0].tolist(), strict=True))
                for k in short.tolist():
                    here, n = int(q[k]), 0
                    while here in to and here < ends[k]:
                        here, n = to[here], n + 1
                    q[k], count[k] = here, count[k] + n
            active = active[q[active] < ends[active]]
        return count

    def _next(self, asked: np.ndarray, q: np.ndarray, room: np.ndarray, own: np.ndarray, has_own: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the phrase that starts at each ``q`` ends, and ``copy`` as in ``longest``."""
        found, copy = self.longest(asked, q, room, own, has_own, copy) if self.n else (0, copy)
        to = q + found
        inner = np.nonzero((asked[to] & 0xC0) == 0x80)[0]
        while len(inner):  # not into a code point
            to[inner] -= 1
            inner = inner[(asked[to[inner]] & 0xC0) == 0x80]
        inner = np.nonzero(to <= q)[0]
        to[inner] = q[inner]
        while len(inner):  # one code point that no line has
            to[inner] += 1
            inner = inner[(asked[to[inner]] & 0xC0) == 0x80]
        return to, copy


@functools.lru_cache(maxsize=64)
def opened(place: str) -> Index:
    return Index(place)


def _pieces(text: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    for a in range(0, len(text) - 8, step):
        yield a, min(a + step, len(text) - 8)


def _grown(path: str, size: int) -> None:
    with open(path, "wb") as f:
        f.truncate(size)


def _put(path: str, data: np.ndarray, at: int) -> None:
    """Write ``data`` from its ``at``-th element on."""
    with open(path, "r+b") as f:
        f.seek(at * data.itemsize)
        f.write(memoryview(np.ascontiguousarray(data)).cast("B") if len(data) else b"")


def build(lines: DataFrame) -> dict[str, tuple[str, int]]:
    """By group: the folder of its index, and its code points with repeats; ``lines`` (grp, line, doc_id), with repeats."""
    spark = lines.sparkSession
    folder = _folder(spark)
    once = lines.where("grp is not null and line <> ''").groupBy("grp", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    dealt = checkpointed(once.select("grp", "line", "n", "owner", (F.col("owner") == F.col("last")).alias("single"), F.octet_length("line").alias("size")))
    groups = dealt.groupBy("grp").agg(F.sum(F.col("size") + 1).alias("bytes"), F.sum(F.col("n") * F.length("line")).alias("chars")).collect()
    if not groups:
        return {}
    names = {r.grp: f"{folder}/{k}" for k, r in enumerate(groups)}
    sizes = spark.createDataFrame([(r.grp, names[r.grp], -(-r.bytes // PIECE)) for r in groups], "grp string, place string, pieces long")
    placed = dealt.join(F.broadcast(sizes), "grp").withColumn("piece", F.pmod(F.xxhash64("line"), F.col("pieces")))
    at = {}
    totals: dict[str, tuple[int, int]] = {}
    for r in placed.groupBy("place", "piece").agg(F.sum(F.col("size") + 1).alias("bytes"), F.count("*").alias("lines")).orderBy("place", "piece").collect():
        a, b = totals.get(r.place, (0, 0))
        at[r.place, r.piece] = a, b
        totals[r.place] = a + r.bytes, b + r.lines
    for place, (n_bytes, n_lines) in totals.items():
        os.makedirs(place)
        _grown(f"{place}/text", n_bytes + 8)
        _put(f"{place}/text", np.full(8, 0xFF, np.uint8), n_bytes)
        for name in ("starts", "owners"):
            _grown(f"{place}/{name}", 8 * n_lines)
        _grown(f"{place}/single", n_lines)

    def write(table: pa.Table) -> pa.Table:
        place, piece = table["place"][0].as_py(), table["piece"][0].as_py()
        first, line = at[place, piece]
        blob = END.join(x.encode() for x in table["line"].to_pylist()) + END
        size = table["size"].to_numpy().astype(np.int64) + 1
        _put(f"{place}/text", np.frombuffer(blob, np.uint8), first)
        _put(f"{place}/starts", first + np.cumsum(size) - size, line)
        _put(f"{place}/owners", table["owner"].to_numpy().astype(np.int64), line)
        _put(f"{place}/single", table["single"].to_numpy(zero_copy_only=False).astype(np.uint8), line)
        return pa.table({"n": pa.array([len(blob)], pa.int64())})

    placed.select("place", "piece", "line", "size", "owner", "single").groupBy("place", "piece").applyInArrow(write, "n long").agg(F.sum("n")).collect()

    splits = {}
    r = np.random.default_rng(7)
    for place, (n_bytes, _) in totals.items():
        buckets = -(-n_bytes // BUCKET)
        text = np.memmap(f"{place}/text", np.uint8, "r")
        drawn = np.sort(_keys(text, r.integers(0, n_bytes, SAMPLE * buckets)))
        splits[place] = np.unique(drawn[np.arange(1, buckets) * SAMPLE])

    def run(job: Callable, jobs: list[tuple]) -> list:
        """``job`` for each of ``jobs``, one a task."""
        return spark.sparkContext.parallelize(jobs, max(1, len(jobs))).map(lambda x: job(*x)).collect()

    def count(place: str, a: int, b: int) -> tuple[str, int, np.ndarray]:
        text = np.memmap(f"{place}/text", np.uint8, "r")
        key = _keys(text, slice(a, b))[_is_start(np.asarray(text[a:b]))]
        key.sort()
        return place, a, np.diff(np.searchsorted(key, splits[place]), prepend=0, append=len(key))

    found: dict[str, np.ndarray] = {}
    counted = run(count, [(p, a, min(a + PIECE, b)) for p, (b, _) in totals.items() for a in range(0, b, PIECE)])
    for place, _, n in counted:
        found[place] = found.get(place, 0) + n
    kind = {place: np.dtype(np.uint32 if n_bytes + 8 < 1 << 32 else np.int64) for place, (n_bytes, _) in totals.items()}
    jobs = []
    for place, n in found.items():
        _grown(f"{place}/array", int(n.sum()) * kind[place].itemsize)
        for name in ("sampled", "next_sampled"):
            _grown(f"{place}/{name}", -(-int(n.sum()) // STEP) * 8)
        jobs += [(place, k, int(n[:k].sum()), int(n[k])) for k in range(len(n)) if n[k]]

    # places go to a file a bucket, in the order of the pieces that they are from
    shares: dict[tuple[str, int], np.ndarray] = {}
    so_far = {p: np.zeros(len(n), np.int64) for p, n in found.items()}
    for place, a, n in counted:
        shares[place, a] = so_far[place]
        so_far[place] = so_far[place] + n
    for place, k, _, n in jobs:
        _grown(f"{place}/dealt-{k}", n * kind[place].itemsize)

    def deal(place: str, a: int, b: int, share: np.ndarray) -> None:
        text = np.memmap(f"{place}/text", np.uint8, "r")
        at = np.nonzero(_is_start(np.asarray(text[a:b])))[0]
        key = _keys(text, slice(a, b))[at]
        order = np.argsort(key)
        cuts = np.concatenate([[0], np.searchsorted(key[order], splits[place]), [len(at)]])
        at = (at[order] + a).astype(kind[place])
        for k in np.nonzero(np.diff(cuts))[0].tolist():
            _put(f"{place}/dealt-{k}", at[cuts[k] : cuts[k + 1]], int(share[k]))

    run(deal, [(p, a, min(a + PIECE, totals[p][0]), share) for (p, a), share in shares.items()])

    def gathered(place: str, k: int, n: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a bucket, in order, and their keys: as dealt, or where a task runs again and finds them gone, from the whole text."""
        split = splits[place]
        if os.path.exists(f"{place}/dealt-{k}"):
            at = np.sort(np.fromfile(f"{place}/dealt-{k}", kind[place]).astype(np.int64))
            if len(at) == n and (at[1:] > at[:-1]).all() and at[-1] < len(text) - 8:
                keys = _keys(text, at)
                if (k == 0 or keys.min() >= split[k - 1]) and (k == len(split) or keys.max() < split[k]) and _is_start(text[at]).all():
                    return at, keys  # n places of the bucket, which has n
        at, keys, have = np.empty(n, np.int64), np.empty(n, np.uint64), 0
        for a, b in _pieces(text, CHUNK):
            key = _keys(text, slice(a, b))
            good = _is_start(np.asarray(text[a:b]))
            if k:
                good &= key >= split[k - 1]
            if k < len(split):
                good &= key < split[k]
            own = np.nonzero(good)[0]
            at[have : have + len(own)], keys[have : have + len(own)] = own + a, key[own]
            have += len(own)
        return at, keys

    def sort(place: str, k: int, first: int, n: int) -> None:
        text = np.memmap(f"{place}/text", np.uint8, "r")
        at, keys = gathered(place, k, n, text)
        at = _sort_bucket(text, at, keys)
        _put(f"{place}/array", at.astype(kind[place]), first)
        pick = at[-first % STEP :: STEP]
        _put(f"{place}/sampled", _keys(text, pick), -(-first // STEP))
        _put(f"{place}/next_sampled", _keys(text, np.minimum(pick + 8, len(text) - 8)), -(-first // STEP))
        starts, owner, single = (np.fromfile(f"{place}/{x}", t) for x, t in (("starts", np.int64), ("owners", np.int64), ("single", np.uint8)))
        line = _lines_at(starts, at)
        owner, several = owner[line], single[line] == 0
        change = np.append(True, (owner[1:] != owner[:-1]) | several[1:] | several[:-1])
        cuts = np.append(np.nonzero(change)[0], n)
        long = np.diff(cuts) > RUN
        np.save(f"{place}/runs-{k}.npy", np.stack([cuts[:-1][long], cuts[1:][long]], axis=1).astype(np.int64) + first)
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{place}/dealt-{k}")

    run(sort, jobs)
    return {r.grp: (names[r.grp], int(r.chars)) for r in groups}
