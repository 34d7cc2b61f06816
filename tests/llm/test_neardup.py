import numpy as np

from lexiloom.llm import neardup as nd

SCHEMA = "vec_id long, embedding array<float>, label int, node long, grp string, n_links string"


def make():
    r = np.random.default_rng(8)
    rows = []

    def add(v, label):
        rows.append((len(rows), None if v is None else [None if x is None else float(x) for x in v], label, 1, "clash", "clash"))

    for i in range(700):
        add(r.normal(size=16), i % 3)
    hot = r.normal(size=16)
    for _ in range(90):
        add(hot + r.normal(size=16) * 0.03, 1)  # more than a list holds
    for _ in range(25):
        near = r.normal(size=16)
        for _ in range(int(r.integers(2, 5))):
            add(near * r.uniform(0.5, 2) + r.normal(size=16) * 0.02, int(r.integers(0, 3)))
    for _ in range(40):
        add(rows[3][1], 0)  # copies
    add(rows[3][1], 2)
    add(rows[3][1], None)
    for v in (None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 8, [1.0] * 8, [3e38] * 16, [-3e38] * 16, [1e-30] * 16):
        add(v, 0)
    rows.append((None, *rows[3][1:]))
    rows.append(rows[5])
    return rows


def brute(rows):
    ok, unit = [], {}
    for k, r in enumerate(rows):
        v = r[1]
        if r[2] is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            x = np.float32(v).astype(np.float64)
            unit[k] = x / abs(x).max()
            unit[k] /= np.linalg.norm(unit[k])
            ok.append(k)
    links = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= nd.THRESHOLD] for k in ok}
    out, seen = {}, set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links.get(j, [])), least, rows[j][0] == least)
    return [out[k] for k in range(len(rows))]


def test_matches_brute_force(spark):
    rows = make()
    told = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.audit_recall for r in told}) == 1 and told[0].audit_recall >= nd.MIN_RECALL
    got = sorted((tuple(r)[:4] for r in told), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    # the graph is approximate: nothing may be linked wrongly, nearly all must be found
    assert all(str(a[0]) == str(b[0]) and a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(a[1] for a in got) >= 0.99 * sum(b[1] for b in want) and len(wrong) <= 4
    hot = [a for a, b in zip(got, want, strict=True) if b[1] >= 60]
    assert len(hot) > 50


def linked_groups():
    """A label of 4 groups, each of 3 tight groups of 40 vectors that are linked with each other as well."""
    r = np.random.default_rng(21)
    rows = []
    for _ in range(4):
        middle = r.normal(size=64)
        middle /= np.linalg.norm(middle)
        for _ in range(3):
            off = r.normal(size=64)
            own = middle + 0.08 * off / np.linalg.norm(off)
            rows += [(len(rows) + k, [float(x) for x in own + r.normal(size=64) * 0.001], 1, 1, "clash", "clash") for k in range(40)]
    return rows


def test_links_between_saturated_groups(spark):
    rows = linked_groups()
    want = sorted(brute(rows))
    assert len({w[2] for w in want}) == 4 and all(w[1] == 119 for w in want)
    assert sorted(tuple(r)[:4] for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_exact_pass_when_the_audit_fails(spark, monkeypatch):
    rows = make()
    monkeypatch.setattr(nd, "MAX_ATTEMPTS", 1)
    monkeypatch.setattr(nd, "MAX_ROUNDS", 1)
    monkeypatch.setattr(nd, "TILE", 100)
    monkeypatch.setattr(nd, "audit_recall", lambda *_: 0.0)
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.audit_recall for r in got} == {1.0}
    assert sorted(str(tuple(r)[:4]) for r in got) == sorted(map(str, brute(rows)))


def test_audit_sees_what_is_missing(spark):
    nodes, _ = nd.nodes_of(spark.createDataFrame(make(), SCHEMA), "vec_id", "embedding", "label")
    none = spark.createDataFrame([], "node long, links long")
    assert nd.audit_recall(nodes, none) == 0.0


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_across_many_blocks(spark, monkeypatch):
    """Small blocks, so that bits and tables matter, short lists and small tiles: all links are still there."""
    for name, value in {"BLOCK": 16, "LIST": 6, "TILE": 20}.items():
        monkeypatch.setattr(nd, name, value)
    bits, tables = nd._plan(260, nd.THRESHOLD)
    assert bits > 3 and (1 - (1 - np.arccos(nd.THRESHOLD) / np.pi) ** bits) ** tables <= nd.MISS
    r = np.random.default_rng(5)
    rows, at = make(), r.normal(size=16)
    for _ in range(60):  # a chain, more than a tile, of vectors with few links each
        off = r.normal(size=16)
        at = at / np.linalg.norm(at) + 0.12 * off / np.linalg.norm(off)
        rows.append((len(rows), [float(x) for x in at], 1, 1, "clash", "clash"))
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == sorted(map(str, brute(rows)))


def test_work_is_in_proportion_to_links(spark):
    """Vectors without links ask for next to none of the others: each kept a dozen neighbours, in every round, before."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 64))
    x[3990:] = x[:10] + 0.01 * r.normal(size=(10, 64))
    rows = spark.createDataFrame([(k, [float(c) for c in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    nodes, _ = nd.nodes_of(rows, "vec_id", "embedding", "label")
    links, saturated = nd.graph(nodes)
    assert links.count() == 10 and saturated.count() == 0
    assert nd._candidates(nodes, nd.THRESHOLD, 0).count() <= 400
