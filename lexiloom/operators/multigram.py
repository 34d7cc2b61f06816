"""Many-to-many joint alignment: soft EM over units, Viterbi paths, segmentation, n-gram model and decoding.

Entries are grouped with weights and stay partitioned. The unit table is pruned
each round and broadcast below a checked size. Each task adds its expected counts
before the shuffle. ``expected_counts``, ``best_path`` and ``decode`` say what one
entry gives; tables of entries go through the same sums in numpy (``lattice``).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import unit_letters, unit_phones
from lexiloom.operators import lattice
from lexiloom.session import written
from lexiloom.symbols import BEGIN, END, EPS, EPSILON, JOINER, UNIT, joins_for

MAX_UNITS = 2_000_000
PRUNE = 1e-8


def uid(letters: list[str], phones: list[str]) -> str:
    return JOINER.join(letters) + UNIT + (JOINER.join(phones) or EPSILON)


def phones_of(unit: str) -> list[str]:
    side = unit.split(UNIT)[1]
    return [] if side == EPSILON else side.split(JOINER)


def grouped(entries: DataFrame) -> DataFrame:
    return entries.groupBy("letters", "phones").agg(F.count("*").alias("weight"))


def _edges(letters, phones, span_l, span_p, q):
    """(i, j, k, m, unit) of all units that the model has, in order of i and j."""
    n, m = len(letters), len(phones)
    lefts = [[JOINER.join(letters[i : i + a]) for a in range(1, min(span_l, n - i) + 1)] for i in range(n)]
    rights = [[JOINER.join(phones[j : j + b]) or EPSILON for b in range(min(span_p, m - j) + 1)] for j in range(m + 1)]
    for i in range(n):
        for j in range(m + 1):
            for a, left in enumerate(lefts[i], 1):
                for b, right in enumerate(rights[j]):
                    unit = left + UNIT + right
                    p = q.get(unit, 0.0) if q is not None else 1.0
                    if p > EPS:
                        yield i, j, i + a, j + b, unit, p


def expected_counts(letters, phones, span_l, span_p, q) -> tuple[float, dict[str, float]]:
    """(probability, expected count of each unit) of one entry; probability 0 if it has no path."""
    edges = list(_edges(letters, phones, span_l, span_p, q))
    n, m = len(letters), len(phones)
    forward = [[0.0] * (m + 1) for _ in range(n + 1)]
    forward[0][0] = 1.0
    for i, j, k, x, _, p in edges:
        if forward[i][j]:
            forward[k][x] += forward[i][j] * p
    total = forward[n][m]
    if total <= EPS:
        return 0.0, {}
    backward = [[0.0] * (m + 1) for _ in range(n + 1)]
    backward[n][m] = 1.0
    for i, j, k, x, _, p in reversed(edges):
        backward[i][j] += p * backward[k][x]
    counts: dict[str, float] = defaultdict(float)
    for i, j, k, x, unit, p in edges:
        c = forward[i][j] * p * backward[k][x]
        if c:
            counts[unit] += c / total
    return total, counts


def best_path(letters, phones, span_l, span_p, q) -> list[str] | None:
    """Units of the most likely path; the first found of equal ones."""
    n, m = len(letters), len(phones)
    best = {(0, 0): (0.0, None, None)}
    for i, j, k, x, unit, p in _edges(letters, phones, span_l, span_p, q):
        if (i, j) in best:
            s = best[i, j][0] + math.log(p)
            if (k, x) not in best or s > best[k, x][0]:
                best[k, x] = s, (i, j), unit
    if (n, m) not in best or not n:
        return None
    path, at = [], (n, m)
    while at != (0, 0):
        _, at, unit = best[at]
        path.append(unit)
    return path[::-1]


def initial_units(entries: DataFrame, span_l: int = 2, span_p: int = 2) -> DataFrame:
    """(unit, prob): every unit that an entry can hold, uniform. Each task sends a unit once, however many entries hold it."""
    rows = entries.where("size(letters) > 0").select("letters", "phones")
    found = rows.mapInArrow(lambda batches: lattice.possible_units(batches, span_l, span_p), "unit string").distinct()
    units = written(found, "units")
    return units.select("unit", F.lit(1.0 / max(1, units.count())).alias("prob"))


def _collected(q: DataFrame) -> dict[str, float]:
    rows = q.select("unit", "prob").limit(MAX_UNITS + 1).toArrow()
    if rows.num_rows > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units can't be broadcast; prune more")
    return dict(zip(rows["unit"].to_pylist(), rows["prob"].to_pylist(), strict=True))


def e_step(entries: DataFrame, units: lattice.Units, q: np.ndarray, span_l: int, span_p: int) -> tuple[np.ndarray, float]:
    """(expected count of each unit, log likelihood) of entries (letters, phones, weight); each task adds up its own first."""
    table = entries.sparkSession.sparkContext.broadcast((units, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, q = table.value
        p, counts, likely, some = known.spread(np.where(q > EPS, q, 0.0), 0.0), np.zeros(known.size), 0.0, False
        for rows in lattice.gathered(batches):
            weight, some = rows["weight"].to_numpy().astype(float), True
            for shape in lattice.shapes(rows, span_l, span_p, known.left, known.right):
                likely += lattice.add_expected(shape, weight[shape[0]], known, p, counts, span_l, span_p)
        if some:
            own = counts[known.own]
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(own[held], likely))], ["place", "count"])

    added = entries.select("letters", "phones", "weight").mapInArrow(run, "place long, count double").groupBy("place").agg(F.sum("count").alias("count")).toArrow()
    table.unpersist()
    place, count = added["place"].to_numpy(), added["count"].to_numpy()
    counts = np.zeros(len(units.units) + 1)
    counts[place] = count  # -1, the last, has the log likelihood
    return counts[:-1], float(counts[-1])


def m_step(counts: np.ndarray, prune: float = PRUNE) -> np.ndarray:
    """Normalised counts, 0 for those below ``prune``, but for the best one, normalised again."""
    strong = (counts > 0) & (counts >= prune * counts.sum())
    if not strong.any():
        strong[counts.argmax()] = True
    kept = np.where(strong, counts, 0.0)
    return kept / kept.sum()


def fit_units(entries: DataFrame, span_l: int = 2, span_p: int = 2, iterations: int = 15, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """((unit, prob), log likelihood of each round) by soft EM."""
    spark = entries.sparkSession
    # small cached tables would be put together to fewer tasks than there are cores
    pairs = grouped(entries).repartition(2 * spark.sparkContext.defaultParallelism).persist()
    names, told = sorted(_collected(initial_units(pairs, span_l, span_p))), []
    q = np.full(len(names), 1.0 / max(1, len(names)))
    for _ in range(iterations):
        units = lattice.Units(names)
        counts, likely = e_step(pairs, units, q, span_l, span_p)
        told.append(likely)
        if not counts.any():
            break
        q = m_step(counts)
        names, q = [names[k] for k in np.flatnonzero(q)], q[q > 0]
        if len(told) > 1 and abs(told[-1] - told[-2]) <= tolerance * max(1.0, abs(told[-2])):
            break
    pairs.unpersist()
    return spark.createDataFrame(pa.table({"unit": pa.array(names, pa.string()), "prob": pa.array(q, pa.float64())})), told


def viterbi(entries: DataFrame, q: DataFrame, span_l: int = 2, span_p: int = 2) -> DataFrame:
    """``entries`` with ``units``: the best path, or null."""
    found = {unit: math.log(p) for unit, p in _collected(q).items() if p > EPS}
    table = entries.sparkSession.sparkContext.broadcast((lattice.Units(list(found)), np.array(list(found.values()))))
    schema = entries.select("*").schema.add("units", entries.schema["letters"].dataType)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = table.value
        logs, unit_names = known.spread(values, -math.inf), pa.array(known.units, pa.string())
        for rows in lattice.gathered(batches):
            paths = lattice.paths_of(rows, known, unit_names, logs, span_l, span_p)
            yield from pa.table([*rows.columns, paths], names).to_batches()

    return entries.mapInArrow(run, schema)


def top_units(q: DataFrame, min_letters: int = 1, *, min_prob: float = 0.0, min_phones: int = 0) -> DataFrame:
    """(unit, letters, phones, prob), likeliest first."""
    rows = q.select("unit", unit_letters(F.col("unit")).alias("letters"), unit_phones(F.col("unit")).alias("phones"), "prob")
    return rows.where((F.size("letters") >= min_letters) & (F.size("phones") >= min_phones) & (F.col("prob") >= min_prob)).orderBy(F.desc("prob"), "unit")


def join_candidates(q: DataFrame, side: str = "letters", min_size: int = 2, min_mass: float = 0.0) -> DataFrame:
    """(tokens, mass): sides of at least ``min_size`` tokens by their summed probability."""
    rows = top_units(q).where(F.size(side) >= min_size)
    return rows.groupBy(F.array_join(side, " ").alias("tokens")).agg(F.sum("prob").alias("mass")).where(F.col("mass") >= min_mass)


def join_report(q: DataFrame, side: str = "letters", min_prob: float = 0.0, top: int = 20) -> DataFrame:
    """(tokens, total_mass, modal_match, modal_confidence, alternatives): what each join candidate stands for.

    A candidate is a ``side`` longer than what it stands for: two letters for one
    phone, or two phones for one letter. ``alternatives``: up to four (tokens, mass).
    """
    other = "phones" if side == "letters" else "letters"
    rows = top_units(q).where(F.size(side) > F.size(other)).select(F.array_join(side, " ").alias("tokens"), F.array_join(other, " ").alias("match"), "prob")
    rank = F.row_number().over(Window.partitionBy("tokens").orderBy(F.desc("prob"), "match"))
    ranked = rows.withColumns({"rank": rank, "total": F.sum("prob").over(Window.partitionBy("tokens"))}).where((F.col("rank") <= 5) & (F.col("total") >= min_prob))
    told = ranked.groupBy("tokens").agg(
        F.first("total").alias("total_mass"),
        F.max(F.when(F.col("rank") == 1, F.col("match"))).alias("modal_match"),
        F.max(F.when(F.col("rank") == 1, F.col("prob") / F.col("total"))).alias("modal_confidence"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "match", "prob")))).alias("alternatives"),
    )
    return told.withColumn("alternatives", F.transform("alternatives", lambda x: F.struct(x["match"].alias("tokens"), x["prob"].alias("mass")))).orderBy(F.desc("total_mass"), "tokens").limit(top)


def nontrivial_units(q: DataFrame, locale: str = "default", phoneset: str = "ipa", min_prob: float = 1e-5) -> DataFrame:
    """Units with two or more letters or phones, likeliest first, and whether the locale's joins list their sides."""
    rows = top_units(q, min_prob=min_prob).where((F.size("letters") >= 2) | (F.size("phones") >= 2))
    listed = lambda side, kind: F.array_join(side, " ").isin([" ".join(p) for p in joins_for(locale, kind)])
    return rows.withColumns({"letters_joined": listed("letters", "letters"), "phones_joined": listed("phones", phoneset)})


def segment(words: DataFrame, q: DataFrame, span_l: int = 2) -> DataFrame:
    """``words`` (word, letters) with ``segments``: the likeliest parting into letter sides, or null."""
    marginal: dict[str, float] = defaultdict(float)
    for unit, p in _collected(q).items():
        marginal[unit.split(UNIT)[0]] += p
    table = words.sparkSession.sparkContext.broadcast(dict(marginal))
    schema = words.select("*").schema.add("segments", words.schema["letters"].dataType)
    names = schema.names

    def best(letters):
        score, back = [0.0] + [-math.inf] * len(letters), [0] * (len(letters) + 1)
        for i in range(len(letters)):
            for a in range(1, min(span_l, len(letters) - i) + 1):
                p = table.value.get(JOINER.join(letters[i : i + a]), 0.0)
                if p > EPS and score[i] + math.log(p) > score[i + a]:
                    score[i + a], back[i + a] = score[i] + math.log(p), i
        if score[-1] == -math.inf:
            return None
        out, at = [], len(letters)
        while at:
            out.append(" ".join(letters[back[at] : at]))
            at = back[at]
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(x) for x in batch.column(names.index("letters")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names)

    return words.mapInArrow(run, schema)


class NgramModel:
    """Add-k n-gram model over units, backing off where a history wasn't seen."""

    def __init__(self, counts: list[tuple[str | None, ...]], order: int = 3, add_k: float = 0.01):
        self.order, self.add_k = order, add_k
        self.n: dict[tuple, int] = {tuple(w for w in r[:3] if w is not None): r[3] for r in counts}
        self.total = sum(n for w, n in self.n.items() if len(w) == 1)
        self.size = max(1, len({w[0] for w in self.n if len(w) == 1} - {BEGIN, END}))

    def log_prob(self, history: tuple[str, ...], unit: str) -> float:
        for k in range(min(self.order - 1, len(history)), 0, -1):
            seen = self.n.get(history[-k:], 0)
            if seen:
                return math.log((self.n.get((*history[-k:], unit), 0) + self.add_k) / (seen + self.add_k * self.size))
        return math.log((self.n.get((unit,), 0) + self.add_k) / (self.total + self.add_k * self.size))


def decode(letters: list[str], q: dict[str, dict[str, float]], lm: NgramModel, span_l: int = 2, beam: int = 0) -> list[str] | None:
    """Phones of the likeliest unit sequence over ``letters``; None where a letter has no unit."""
    states: list[dict[tuple, tuple[float, tuple]]] = [{} for _ in range(len(letters) + 1)]
    states[0][(BEGIN,)] = 0.0, ()
    keep = max(1, lm.order - 1)
    for i in range(len(letters)):
        here = sorted(states[i].items(), key=lambda x: (-x[1][0], x[0]))
        for history, (score, path) in here[:beam] if beam else here:
            for a in range(1, min(span_l, len(letters) - i) + 1):
                for unit, p in q.get(JOINER.join(letters[i : i + a]), {}).items():
                    s = score + math.log(p) + lm.log_prob(history, unit)
                    to = (*history, unit)[-keep:]
                    if to not in states[i + a] or s > states[i + a][to][0]:
                        states[i + a][to] = s, (path, unit)
    if not states[-1]:
        return None
    path, phones = max(sorted(states[-1].items()), key=lambda x: x[1][0])[1][1], []
    while path:
        path, unit = path
        phones.append(phones_of(unit))
    return [p for side in reversed(phones) for p in side]


class PairDecoder:
    """``decode`` at order 2 over all histories, for many words.

    Pairs that were never seen differ only by their history, so the best history
    stands for all of them; the pairs that were seen are asked one by one.
    """

    def __init__(self, q: dict[str, dict[str, float]], lm: NgramModel, span_l: int = 2):
        self.span = span_l
        self.units = {side: sorted(units) for side, units in q.items()}
        self.logs = {side: np.array([math.log(q[side][u]) for u in units]) for side, units in self.units.items()}
        self.rank = {u: k for k, u in enumerate(sorted(u for units in self.units.values() for u in units))}
        self.ranks = {side: np.array([self.rank[u] for u in units]) for side, units in self.units.items()}
        spread = lm.add_k * lm.size
        seen = {w[0]: n for w, n in lm.n.items() if len(w) == 1 and n}
        # the log probability of any unit never seen after the history; -inf where the history wasn't seen
        rare = lambda h: math.log(lm.add_k / (seen[h] + spread)) if h in seen else -math.inf
        self.rare = {side: np.array([rare(u) for u in units]) for side, units in self.units.items()} | {None: np.array([rare(BEGIN)])}
        self.alone = {side: np.array([math.log((seen.get(u, 0) + lm.add_k) / (lm.total + spread)) for u in units]) for side, units in self.units.items()}
        place = {u: (side, k) for side, units in self.units.items() for k, u in enumerate(units)}
        known: dict[tuple, list] = defaultdict(list)
        for w, n in lm.n.items():
            if len(w) == 2 and n and w[0] in seen and w[1] in place:
                side, k = (None, 0) if w[0] == BEGIN else place.get(w[0], (None, None))
                if k is not None:
                    to, x = place[w[1]]
                    known[side, to].append((k, x, math.log((n + lm.add_k) / (seen[w[0]] + spread))))
        self.known = {key: tuple(map(np.array, zip(*rows, strict=True))) for key, rows in known.items()}

    def __call__(self, letters: list[str]) -> list[str] | None:
        states: list[list[tuple]] = [[] for _ in range(len(letters) + 1)]  # (side, scores, from which state, from which of its units, begin)
        states[0] = [(None, np.zeros(1), None, None, 0)]
        for i in range(len(letters)):
            here = states[i]
            if not here:
                continue
            # for histories that were seen and others apart, the best: of equal ones that of the higher score, then the first
            score = np.concatenate([x[1] for x in here])
            rare = np.concatenate([self.rare[x[0]] for x in here])
            rank = np.concatenate([self.ranks[x[0]] if x[0] is not None else np.array([-1]) for x in here])
            group = np.concatenate([np.full(len(x[1]), g) for g, x in enumerate(here)])
            local = np.concatenate([np.arange(len(x[1])) for x in here])
            first = np.cumsum([0] + [len(x[1]) for x in here])
            seen = np.flatnonzero(rare > -math.inf)
            other = np.flatnonzero(rare == -math.inf)
            for a in range(1, min(self.span, len(letters) - i) + 1):
                side = JOINER.join(letters[i : i + a])
                if side not in self.units:
                    continue
                logs = self.logs[side]
                every = np.arange(len(logs))
                offers = []  # (unit, history, score)
                if len(seen):
                    h = seen[np.lexsort((rank[seen], -score[seen], -(score[seen] + rare[seen])))[0]]
                    offers.append((every, np.full(len(logs), h), score[h] + logs + rare[h]))
                if len(other):
                    h = other[np.lexsort((rank[other], -score[other]))[0]]
                    offers.append((every, np.full(len(logs), h), score[h] + logs + self.alone[side]))
                for g, x in enumerate(here):
                    if (x[0], side) in self.known:
                        k, u, lp = self.known[x[0], side]
                        offers.append((u, first[g] + k, x[1][k] + logs[u] + lp))
                unit, history, s = (np.concatenate(c) for c in zip(*offers, strict=True))
                order = np.lexsort((rank[history], -score[history], -s, unit))
                best = order[np.concatenate([[True], np.diff(unit[order]) > 0])]  # every unit has an offer
                states[i + a].append((side, s[best], group[history[best]], local[history[best]], i))
        if not states[-1]:
            return None
        at = len(letters)
        ends = [(-x[1].max(), self.rank[self.units[x[0]][int(x[1].argmax())]], g, int(x[1].argmax())) for g, x in enumerate(states[at]) if x[0] is not None]
        if not ends:
            return []
        _, _, g, k = min(ends)
        phones = []
        while at:
            side, _, groups, units, at = states[at][g]
            phones.append(phones_of(self.units[side][k]))
            g, k = int(groups[k]), int(units[k])
        return [p for x in reversed(phones) for p in x]


def decode_words(words: DataFrame, q: DataFrame, counts: DataFrame, span_l: int = 2, order: int = 3, add_k: float = 0.01, beam: int = 0) -> DataFrame:
    """``words`` (word, letters) with ``predicted``; the units and n-gram counts (w1, w2, w3, n) are broadcast below a checked size."""
    by_letters: dict[str, dict[str, float]] = defaultdict(dict)
    for unit, p in _collected(q).items():
        by_letters[unit.split(UNIT)[0]][unit] = p
    grams = counts.select("w1", "w2", "w3", "n").limit(MAX_UNITS + 1).collect()
    if len(grams) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} n-grams can't be broadcast")
    model = words.sparkSession.sparkContext.broadcast((dict(by_letters), [tuple(r) for r in grams]))
    schema = words.select("*").schema.add("predicted", words.schema["letters"].dataType)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, rows = model.value
        lm = NgramModel(rows, order, add_k)
        pairs = PairDecoder(units, lm, span_l) if order == 2 and not beam else None
        for batch in batches:
            found = [pairs(x) if pairs else decode(x, units, lm, span_l, beam) for x in batch.column(names.index("letters")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names)

    return words.mapInArrow(run, schema)
