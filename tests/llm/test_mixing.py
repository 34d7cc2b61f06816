import hashlib
import re

import numpy as np

from lexiloom.llm import mixing as m

SCHEMA = "doc_id long, text string, source string, lang string, topic string, weight string, chance int, share double"


def make():
    r = np.random.default_rng(5)
    rows = []
    for i in range(900):
        text = " ".join(["w"] * int(r.integers(1, 60)))
        text += ["", " License", " a@b", " | x |", " k = v"][int(r.choice(5, p=[0.7, 0.1, 0.1, 0.05, 0.05]))]
        rows.append((i, text, f"s{int(r.choice(4, p=[0.6, 0.2, 0.1, 0.1]))}", ["en", "de"][int(r.random() < 0.3)], "clash", "clash", 1, 2.0))
    rows += [(None, None, None, None, "x", "x", 1, 1.0), (None, "a b", "s1", None, "x", "x", 1, 1.0), (3, "a b", "null", "en", "x", "x", 1, 1.0), (3, "a b", "null", "en", "x", "x", 1, 1.0), (901, "", "only", "en", "x", "x", 1, 1.0), (902, "w " * 70000, "s1", "en", "x", "x", 1, 1.0)]
    return rows


def topic(text):
    return next((t for t, marks in m.TOPICS.items() if any(x in (text or "") for x in marks)), m.OTHER)


def brute(rows, targets):
    keys = [(r[2], r[3], topic(r[1])) for r in rows]
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    cells = {}
    for k, t in zip(keys, tokens, strict=True):
        cells[k] = cells.get(k, 0) + t
    total = sum(cells.values())
    share = {k: t / total for k, t in cells.items() if t}
    want = []
    for d, margin in enumerate(m.MARGINS):
        sums = {}
        for k in share:
            sums[k[d]] = sums.get(k[d], 0) + cells[k]
        if isinstance(targets[margin], dict):
            named = targets[margin]
            rest = sum(v for k, v in sums.items() if k not in named)
            raw = {k: named[k] if k in named else (1 - sum(named.values())) * v / rest for k, v in sums.items()}
        else:
            raw = {k: v ** targets[margin] for k, v in sums.items()}
        want.append({k: v / sum(raw.values()) for k, v in raw.items()})
    off = lambda: max((abs(sum(x for k, x in share.items() if k[d] == v) - w) for d in range(3) for v, w in want[d].items()), default=0)
    done = 0
    while done < m.ROUNDS or (done < m.MAX_ROUNDS and off() > m.TOLERANCE):
        for _ in range(m.STEP):
            for d in range(3):
                for v in want[d]:
                    have = sum(x for k, x in share.items() if k[d] == v)
                    share |= {k: x * want[d][v] / have for k, x in share.items() if k[d] == v}
        done += m.STEP
    weight = {k: round(share[k] * total / cells[k], 6) for k in share}
    top = max(weight.values())
    out = []
    for r, k, t in zip(rows, keys, tokens, strict=True):
        name = str(r[0]) if r[0] is not None else hashlib.sha256((r[1] or "").encode()).hexdigest()
        draw = int(hashlib.sha256(f"{m.SEED}:{name}".encode()).hexdigest()[:13], 16) / 2**52
        chance = round(weight[k] / top, 6) if k in weight else 1.0
        out.append((r[0], k[2], t, weight.get(k, 0.0), chance, draw < chance))
    return out, want, share


def close(a, b):
    return a[:3] == b[:3] and abs(a[3] - b[3]) < 2e-6 and abs(a[4] - b[4]) < 2e-6 and a[5] == b[5]


def test_matches_brute_force(spark):
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    for targets in (m.TARGETS, {"source": {"s0": 0.25, "s1": 0.25}, "lang": 1.0, "topic": 1.0}):
        got = sorted((tuple(r) for r in m.mix(docs, targets).collect()), key=str)
        want = sorted(brute(rows, targets)[0], key=str)
        assert len(got) == len(want) and all(map(close, got, want))


def test_margins_are_met(spark):
    rows = make()
    told, want, share = brute(rows, m.TARGETS)
    # what the query's own chances keep on average, by margin, is in proportion to the targets
    got = {}
    keys = {(r[0], r[1]): (r[2], r[3]) for r in rows}
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    for r in m.mix(docs).collect():
        source, lang = keys[rows[r.doc_id][:2]]
        for d, v in enumerate((source, lang, r.topic)):
            got[d, v] = got.get((d, v), 0) + r.n_tokens * r.chance
    for d in range(3):
        total = sum(x for (k, _), x in got.items() if k == d)
        for v, w in want[d].items():
            assert abs(got[d, v] / total - w) < 1e-3
    for d in range(3):
        for v, w in want[d].items():
            assert abs(sum(x for k, x in share.items() if k[d] == v) - w) < 1e-3


def test_rounds_with_a_shuffle_agree(spark, monkeypatch):
    docs = spark.createDataFrame(make(), SCHEMA)
    monkeypatch.setattr(m, "ROUNDS", 5)
    monkeypatch.setattr(m, "MAX_ROUNDS", 5)  # each shuffled round is six checkpoints
    one = sorted(map(str, m.mix(docs).collect()))
    monkeypatch.setattr(m, "MAX_CELLS_IN_TASK", 0)
    assert sorted(map(str, m.mix(docs).collect())) == one


def test_sample_keeps_columns(spark):
    docs = spark.createDataFrame(make(), SCHEMA)
    kept = m.sample(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(make(), m.TARGETS)[0] if r[5])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.mix(empty).collect() == [] and m.sample(empty).collect() == []
