import random
import re

import numpy as np
import pytest
import xxhash

from lexiloom.llm.simhash import fingerprints_of, keep_one, linked_fingerprints, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    ids = {c: min((rows[k][0] for k in range(len(rows)) if comp[k] == c and rows[k][0] is not None), default=None) for c in set(comp)}
    return sorted(((r[0], f"{f:016x}", ids[c]) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    out = []
    for i in range(40):
        text = r.choices(words, k=r.choice([3, 5, 60, 200]))
        for _ in range(r.choice([1, 1, 4])):
            copy = list(text)
            copy[r.randrange(len(copy))] = r.choice(words)
            out.append((len(out), " ".join(copy)))
    out += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "İ É ONE two"), (None, out[0][1]), (None, "lonely words here are none"), (5, out[5][1])]
    out += [(906, "x " * 30000), (907, "x " * 30001 + "y z q r")]
    return out


def test_fingerprints_match_plain_form(rows):
    got = [int(x) % (1 << 64) for x in fingerprints_of([t for _, t in rows])]
    assert got == [plain(t) for _, t in rows]


def test_components_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_links_find_every_pair_within_the_distance(spark):
    r = np.random.default_rng(1)
    base = r.integers(-(2**63), 2**63 - 1, 60)
    fps = set(base.tolist())
    for x in base.tolist():
        for n in (1, 2, 3, 4, 5):
            for b in r.choice(64, n, replace=False).tolist():
                x ^= (1 << b) - (1 << 64) * (b == 63)
            fps.add(x)
    fps = sorted(fps)
    got = {(a, b) for a, b in linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert want and got == want
    assert linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long")).count() == len(want)
    both = linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), second_key=True).collect()
    assert len(both) == len(want) and {tuple(r) for r in both} == want


def test_keep_one(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for i, _, c in brute(rows) if c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want)
    assert got.count(None) == 1  # the lonely text; the other null id is a copy


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []
