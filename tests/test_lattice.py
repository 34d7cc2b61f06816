"""Tables of entries in numpy against the plain forms, an entry at a time."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import lattice
from lexiloom.operators import multigram as M
from lexiloom.plans import queries as Q
from lexiloom.symbols import BEGIN, END, UNIT


def entries(seed, n=40):
    """Words of up to six tokens, some of them joined, so that sides of one name are made in several ways."""
    r = random.Random(seed)
    rows = [([r.choice(["a", "b", "s₊h", "s", "h"]) for _ in range(r.randint(0, 6))], [r.choice("xyz∅") for _ in range(r.randint(0, 6))]) for _ in range(n)]
    kind = pa.list_(pa.string())
    return r, rows, pa.table({"letters": pa.array([x[0] for x in rows], kind), "phones": pa.array([x[1] for x in rows], kind)})


@pytest.mark.parametrize("seed, spans, dense, step", [(1, (2, 2), 8_000_000, 16_384), (2, (3, 2), 10, 5), (3, (2, 1), 10, 16_384), (4, (1, 1), 8_000_000, 5)])
def test_tables_against_plain(monkeypatch, seed, spans, dense, step):
    monkeypatch.setattr(lattice, "DENSE", dense)
    monkeypatch.setattr(lattice, "STEP", step)
    r, rows, table = entries(seed)
    every = {edge[4] for a, b in rows for edge in M._edges(a, b, *spans, None)}
    made = [u for batch in lattice.possible_units(iter(table.to_batches(max_chunksize=7)), *spans) for u in batch.column(0).to_pylist()]
    assert set(made) == every and (dense == 10 or len(made) == len(every))
    q = {u: r.choice([0.1, 0.2, 0.3]) for u in r.sample(sorted(every), len(every) * 4 // 5)}  # equal paths among them
    units, values = lattice.Units(list(q)), np.array(list(q.values()))
    counts, likely, plain, told = np.zeros(units.size), 0.0, Counter(), 0.0
    for shape in lattice.shapes(table, *spans, units.left, units.right):
        likely += lattice.add_expected(shape, np.full(len(shape[0]), 2.0), units, units.spread(values, 0.0), counts, *spans)
    for a, b in rows:
        p, found = M.expected_counts(a, b, *spans, q)
        told += 2 * math.log(p) if p else 0.0
        for u, c in found.items():
            plain[u] += 2 * c
    assert abs(likely - told) < 1e-9 * abs(told) and np.allclose(counts[units.own], [plain[u] for u in q], atol=1e-9)
    logs = units.spread(np.array([math.log(p) for p in q.values()]), -math.inf)
    assert lattice.paths_of(table, units, pa.array(list(q)), logs, *spans).to_pylist() == [M.best_path(a, b, *spans, q) for a, b in rows]


def test_units_of_the_queries_are_fitted_to_the_end(spark, monkeypatch):
    """unit_em, suggest_joins and multigram_pronounce stopped after two rounds."""
    rows = [(f"w{k}", a, b) for k, (a, b) in enumerate(entries(5)[1]) if len(a) >= len(b)]
    made = spark.createDataFrame(rows, "word string, letters array<string>, phones array<string>")
    monkeypatch.setattr(Q, "alignable", lambda *_: made)
    want = {u.unit: u.prob for u in M.fit_units(made)[0].collect()}
    short = {u.unit: u.prob for u in M.fit_units(made, iterations=2)[0].collect()}
    for got in (Q._units(spark, ""), Q._units_of(made)):
        got = {u.unit: u.prob for u in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)
        assert got.keys() != short.keys() or any(abs(got[u] - short[u]) > 1e-6 for u in got)


def test_pairs_decode_as_all_histories_do():
    """multigram_pronounce kept 20 histories; now all count."""
    for seed in range(8):
        r, rows, _ = entries(seed)
        q = {u: r.uniform(0.01, 1) for u in sorted({edge[4] for a, b in rows for edge in M._edges(a, b, 2, 2, None)})}
        sides, grams = {}, Counter()
        for u, p in q.items():
            sides.setdefault(u.split(UNIT)[0], {})[u] = p
        for path in filter(None, (M.best_path(a, b, 2, 2, q) for a, b in rows)):
            marked = [BEGIN, *path, END]
            grams.update((u, None, None) for u in marked)
            grams.update((u, v, None) for u, v in zip(marked, marked[1:], strict=False))
        lm = M.NgramModel([(*w, n) for w, n in grams.items()], 2)
        pairs = M.PairDecoder(sides, lm)
        words = [[r.choice(["a", "b", "s₊h", "s", "h", "q"][: 5 + (k % 5 == 0)]) for _ in range(r.randint(0, 6))] for k in range(40)]
        assert [pairs(w) for w in words] == [M.decode(w, sides, lm) for w in words]
