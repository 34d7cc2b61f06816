"""Lattices of many entries at once: sides of units are numbers, entries of one shape share the steps of numpy.

``multigram`` has the same sums and paths for one entry at a time, in plain Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexiloom.symbols import EPS, EPSILON, JOINER, UNIT

#: Cells of a table of left by right sides; beyond, units are found by binary search.
DENSE = 8_000_000
#: Rows that are taken at once, and cells of one step.
ROWS, STEP = 65_536, 16_384


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """The batches, put together to tables of about ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(table: pa.Table, name: str) -> pa.ListArray:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def side_ids(column: pa.ListArray, most: int, number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(lengths, starts, ids): ``ids[a - 1]`` has ``number`` of the side of ``a`` tokens from each token on, -1 where its list ends before."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    told = column.flatten().dictionary_encode()
    tokens, codes = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    last, at = np.repeat(ends, lengths), np.arange(len(codes))
    names, node, ids = tokens, codes, []
    for a in range(1, most + 1):
        if a > 1:
            fits = np.flatnonzero(at + a <= last)
            pairs, where = np.unique(node[fits] * len(tokens) + codes[fits + a - 1], return_inverse=True)
            names = [names[k // len(tokens)] + JOINER + tokens[k % len(tokens)] for k in pairs.tolist()]
            node = np.full(len(codes), -1)
            node[fits] = where
        known = np.array([number(x) for x in names] + [-1], np.int64)
        ids.append(known[node])
    return lengths, ends - lengths, ids


def shapes(table: pa.Table, span_l: int, span_p: int, left: Callable[[str], int], right: Callable[[str], int]) -> Iterator[tuple]:
    """(rows, n, m, lefts, rights): entries of n letters and m phones; ``lefts[a - 1]`` is (place, row), ``rights[b - 1]`` (row, place)."""
    n_l, at_l, ids_l = side_ids(_lists(table, "letters"), span_l, left)
    n_p, at_p, ids_p = side_ids(_lists(table, "phones"), span_p, right)
    key = n_l * (n_p.max(initial=0) + 1) + n_p
    order = np.argsort(key, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if not len(group) or not n_l[group[0]]:
            continue
        n, m = int(n_l[group[0]]), int(n_p[group[0]])
        size = max(1, STEP // (m + 1))
        for k in range(0, len(group), size):
            rows = group[k : k + size]
            lefts = [ids_l[a - 1][np.arange(n - a + 1)[:, None] + at_l[rows]] for a in range(1, min(span_l, n) + 1)]
            rights = [ids_p[b - 1][at_p[rows][:, None] + np.arange(m - b + 1)] for b in range(1, min(span_p, m) + 1)]
            yield rows, n, m, lefts, rights


def edges(n: int, m: int, span_l: int, span_p: int) -> list[tuple[int, int, int, int, int]]:
    """(i, k, b, low, high): steps from letter i to k over b phones, from the places low to high - 1 that lie on whole paths; by k, then i, then b downwards."""
    low = [max(0, m - span_p * (n - i)) for i in range(n + 1)]
    high = [min(m, span_p * i) for i in range(n + 1)]
    found = []
    for k in range(1, n + 1):
        for i in range(max(0, k - span_l), k):
            for b in range(min(span_p, m), -1, -1):
                first, last = max(low[i], low[k] - b), min(high[i], high[k] - b)
                if first <= last:
                    found.append((i, k, b, first, last + 1))
    return found


class Units:
    """Numbers of the sides of given units, and a slot for each unit; other pairs of sides have slots with nothing in them."""

    def __init__(self, units: list[str]):
        self.units, self.lefts, self.rights = units, {}, {EPSILON: 0}
        sides = [unit.split(UNIT) for unit in units]
        l = np.array([self.lefts.setdefault(x[0], len(self.lefts)) for x in sides], np.int64)  # noqa: E741
        r = np.array([self.rights.setdefault(x[1], len(self.rights)) for x in sides], np.int64)
        self.width = len(self.rights) + 1
        keys = l * self.width + r
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        cells = (len(self.lefts) + 1) * self.width
        self.dense = cells <= DENSE
        self.size = cells if self.dense else len(units) + 1
        self.own = keys if self.dense else np.arange(len(units))  # the slot of each unit

    def left(self, side: str) -> int:
        return self.lefts.get(side, len(self.lefts))

    def right(self, side: str) -> int:
        return self.rights.get(side, len(self.rights))

    def slots(self, lefts: np.ndarray, rights: np.ndarray | int) -> np.ndarray:
        key = lefts * self.width + rights
        return key if self.dense else self._found(key)

    def _found(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.order[at], len(self.units)) if len(self.keys) else np.zeros_like(key)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """Places in ``units`` of slots that hold a unit."""
        return self._found(slots) if self.dense else slots

    def spread(self, values: np.ndarray, empty: float) -> np.ndarray:
        out = np.full(self.size, empty)
        out[self.own] = values
        return out


def _steps(shape: tuple, units: Units, span_l: int, span_p: int) -> Iterator[tuple]:
    """(i, k, b, low, high, slots): slots of (row, place), or (row, 1) for units without phones."""
    _, n, m, lefts, rights = shape
    for i, k, b, low, high in edges(n, m, span_l, span_p):
        yield i, k, b, low, high, units.slots(lefts[k - i - 1][i][:, None], rights[b - 1][:, low:high] if b else 0)


def add_expected(shape: tuple, weight: np.ndarray, units: Units, p: np.ndarray, counts: np.ndarray, span_l: int, span_p: int) -> float:
    """Add the entries' expected counts to ``counts``; returns their log likelihood. Entries without a path add nothing."""
    rows, n, m, _, _ = shape
    forward = np.zeros((n + 1, len(rows), m + 1))
    forward[0, :, 0] = 1.0
    held = []
    for i, k, b, low, high, slots in _steps(shape, units, span_l, span_p):
        q = p[slots]
        forward[k, :, low + b : high + b] += forward[i, :, low:high] * q
        held.append((i, k, b, low, high, slots, q))
    total = forward[n, :, m]
    fits = total > EPS
    if not fits.any():
        return 0.0
    backward = np.zeros_like(forward)
    backward[n, fits, m] = weight[fits] / total[fits]
    for i, k, b, low, high, slots, q in reversed(held):
        rest = q * backward[k, :, low + b : high + b]
        backward[i, :, low:high] += rest
        share = forward[i, :, low:high] * rest
        np.add.at(counts, slots.ravel(), share.ravel() if b else share.sum(axis=1))
    return float((weight[fits] * np.log(total[fits])).sum())


def best_paths(shape: tuple, units: Units, logs: np.ndarray, span_l: int, span_p: int) -> list[np.ndarray]:
    """[(rows, numbers of units), ...] from the last unit to the first; a row stays out once its path is done, and where it has none. The first of equal paths."""
    rows, n, m, _, _ = shape
    best = np.full((n + 1, len(rows), m + 1), -math.inf)
    best[0, :, 0] = 0.0
    came = np.zeros(best.shape, np.int64)
    slot = np.zeros(best.shape, np.int64)
    for i, k, b, low, high, slots in _steps(shape, units, span_l, span_p):
        s = best[i, :, low:high] + logs[slots]
        there = (k, slice(None), slice(low + b, high + b))
        better = s > best[there]
        best[there][better] = s[better]
        came[there][better] = (k - i) * (span_p + 1) + b
        slot[there][better] = np.broadcast_to(slots, s.shape)[better]
    out = []
    at = np.flatnonzero(best[n, :, m] > -math.inf)
    k, j = np.full(len(at), n), np.full(len(at), m)
    while len(at):
        out.append((rows[at], units.numbers(slot[k, at, j])))
        step = came[k, at, j]
        k, j = k - step // (span_p + 1), j - step % (span_p + 1)
        on = k > 0
        at, k, j = at[on], k[on], j[on]
    return out


def paths_of(table: pa.Table, units: Units, names: pa.Array, logs: np.ndarray, span_l: int, span_p: int) -> pa.ListArray:
    """The units of each row's best path, null where there is none."""
    rows, numbers, turn = [], [], []
    for shape in shapes(table, span_l, span_p, units.left, units.right):
        for t, (at, found) in enumerate(best_paths(shape, units, logs, span_l, span_p)):
            rows.append(at)
            numbers.append(found)
            turn.append(np.full(len(at), -t))
    if not rows:
        return pa.nulls(table.num_rows, pa.list_(pa.string()))
    row = np.concatenate(rows)
    order = np.lexsort((np.concatenate(turn), row))
    lengths = np.bincount(row, minlength=table.num_rows)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = names.take(pa.array(np.concatenate(numbers)[order]))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(lengths == 0))


class Sides:
    """Numbers of sides in order of appearance."""

    def __init__(self):
        self.names: dict[str, int] = {}

    def __call__(self, side: str) -> int:
        return self.names.setdefault(side, len(self.names))


def _pairs(left: Sides, right: Sides, l: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:  # noqa: E741
    lefts, rights = pa.array(list(left.names), pa.string()), pa.array(list(right.names), pa.string())
    for k in range(0, len(l), ROWS):
        unit = pc.binary_join_element_wise(lefts.take(pa.array(l[k : k + ROWS])), rights.take(pa.array(r[k : k + ROWS])), UNIT)
        yield pa.RecordBatch.from_arrays([unit], ["unit"])


def possible_units(batches: Iterator[pa.RecordBatch], span_l: int, span_p: int) -> Iterator[pa.RecordBatch]:
    """Batches (unit): what the entries' letters and phones can make, each once for a table of at most ``DENSE`` cells; larger alphabets give it several times."""
    left, right = Sides(), Sides()
    right(EPSILON)
    seen = np.zeros((0, 1), bool)
    for table in gathered(batches):
        held = list(shapes(table, span_l, span_p, left, right))
        size = len(left.names), len(right.names)
        dense = size[0] * size[1] <= DENSE
        if dense:
            grown = np.zeros(size, bool)
            grown[: seen.shape[0], : seen.shape[1]] = seen
            seen = grown
        else:  # what was seen goes out; the numbers are kept for this table only
            yield from _pairs(left, right, *np.nonzero(seen))
        for rows, _, _, lefts, rights in held:
            none = np.zeros((len(rows), 1), np.int64)
            for a in lefts:
                for b in [none, *rights]:
                    if dense:
                        seen[a[:, :, None], b[None]] = True
                    else:
                        key = np.unique(a[:, :, None] * size[1] + b[None])
                        yield from _pairs(left, right, key // size[1], key % size[1])
        if not dense:
            left, right = Sides(), Sides()
            right(EPSILON)
            seen = np.zeros((0, 1), bool)
    yield from _pairs(left, right, *np.nonzero(seen))
