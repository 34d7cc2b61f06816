import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexiloom.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, `row` string, x0 int, mean int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def make(seed=1, n=500):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéßñ", k=r.randint(1, 9))) for _ in range(3000)]
    rows = []
    for i in range(n):
        words = r.choices(vocabulary, k=int(math.exp(r.gauss(5, 0.6))))
        if i % 25 == 0:
            words = [w + "%%%" for w in words]
        text = " ".join(words)
        if i % 40 == 3:
            text = (text[:60] + "\n") * 9
        rows.append((i, text, r.choice(["en", "en", "en", "de"]), r.choice(["a", "a", "a", "b", "c"])))
    odd = [(900, None, None, None), (901, "", "en", "a"), (902, "\x0b \n\n", "de", None), (None, "a b c d " * 30, "xx", "a"), (903, rows[1][1], "en", "a"), (903, rows[1][1], "en", "a"), (904, "w " * 60000, "en", "a")]
    return [(*x, "clash", "clash", "clash", 1, 2) for x in rows + odd]


def test_counts_match_plain_form():
    for row in make(n=80):
        assert q.text_counts(row[1]) == plain_counts(row[1])
    text = "a b c d e f g h x a b c d e f g h"
    assert q.text_counts(text) == plain_counts(text) and q.text_counts(text)[4] == 16


def test_chi2():
    assert abs(q.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(q.chi2_cdf(9.4877, 4) - 0.95) < 1e-5


def brute_kept(rows):
    """The rule over plain lists, with concentration steps that sort all distances."""
    vectors, groups = {}, {}
    for k, row in enumerate(rows):
        nw, ch, sy, du, rp, nl = plain_counts(row[1])
        share = lambda a, b: math.log1p(100.0 * a / max(b, 1))
        x = [math.log(max(nw, 1)), math.log(max(ch, 1) / max(nw, 1)), share(sy, ch), share(du, nl), share(rp, nw)]
        vectors[k] = np.array([math.floor(1024 * v + 0.5) for v in x]) / 1024
        if nw:
            for key in ((2, row[2], row[3]), (1, row[2]), (0,)):
                groups.setdefault(key, []).append(k)
    floors = np.array(q.FLOORS)
    plain = lambda x, share: (x.mean(0), safe(np.cov(x.T, bias=True) * q.consistency(share)))
    safe = lambda c: c + np.diag(np.maximum(0, floors**2 - np.diag(c)) + q.RIDGE * floors**2)
    dist = lambda x, m, c: np.einsum("ki,ij,kj->k", x - m, np.linalg.inv(c), x - m)

    def estimate(x):
        m = np.median(x, 0)
        d = np.maximum(1.4826 * np.median(abs(x - m), 0), floors)
        z = (x - m) / d
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        signs = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
        ends = []
        for m, c in ((m, safe(np.diag(d**2))), (m, safe(signs.T @ signs / len(x) * np.outer(d, d) * 5)), (x.mean(0), safe(np.cov(x.T, bias=True)))):
            h = math.ceil(q.SUPPORT * len(x))
            for _ in range(q.MAX_STEPS):
                m, c = plain(x[np.argsort(dist(x, m, c), kind="stable")[:h]], h / len(x))
            ends.append((np.linalg.slogdet(c)[1], m, c))
        _, m, c = min(ends, key=lambda e: e[0])
        return len(x), *plain(x[dist(x, m, c) <= q.chi2_quantile(0.975, 5)], 0.975)

    told = {key: estimate(np.array([vectors[k] for k in ks])) for key, ks in groups.items()}

    def drawn(own, above):
        w, off = own[0] / (own[0] + q.PRIOR_ROWS), own[1] - above[0]
        return w * own[1] + (1 - w) * above[0], w * own[2] + (1 - w) * above[1] + w * (1 - w) * np.outer(off, off)

    kept = {}
    for key, ks in groups.items():
        if key[0] == 2:
            m, c = drawn(told[key], drawn(told[1, key[1]], told[0,][1:]))
            kept |= dict(zip(ks, dist(np.array([vectors[k] for k in ks]), m, c) <= q.chi2_quantile(1 - q.TAIL, 5), strict=True))
    return kept


def exact_mcd(x, h):
    """Mean and covariance of the h rows with the least determinant, by trying all subsets."""
    subsets = np.array(list(combinations(range(len(x)), h)))
    rows = x[subsets] - x[subsets].mean(1, keepdims=True)
    best = x[subsets[np.linalg.det(np.einsum("kni,knj->kij", rows, rows)).argmin()]]
    return best.mean(0), np.cov(best.T, bias=True)


@pytest.mark.parametrize("seed", range(4))
def test_fit_agrees_with_exact_mcd(spark, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(20, 5)) @ r.normal(size=(5, 5)) * 3 + r.normal(size=5)
    x[:3] += 60 * r.normal(size=5)  # a clump far away, which moves the plain mean
    x = np.round(1024 * x)
    rows = spark.createDataFrame([(0, None, None, *map(int, v)) for v in x], "level int, lang string, source string, " + ", ".join(f"x{i} long" for i in range(5)))
    told = q.mcd(rows, True).collect()
    assert len(told) == 1
    d = lambda mean, cov: np.einsum("ki,ij,kj->k", x / 1024 - mean, np.linalg.inv(cov), x / 1024 - mean)
    mean, cov = exact_mcd(x / 1024, 15)
    near = x[d(mean, cov * q.consistency(0.75)) <= q.chi2_quantile(0.975, 5)] / 1024
    far = d(near.mean(0), np.cov(near.T, bias=True) * q.consistency(0.975)) > q.chi2_quantile(1 - q.TAIL, 5)
    got = d(np.array(told[0].mean), q._full(told[0]["cov"])) > q.chi2_quantile(1 - q.TAIL, 5)
    assert set(np.nonzero(far)[0]) == set(np.nonzero(got)[0]) >= {0, 1, 2}


def test_checkpointed_fit_agrees(spark, monkeypatch):
    docs = spark.createDataFrame(make(n=60), SCHEMA)
    monkeypatch.setattr(q, "MAX_STEPS", 2)
    one = sorted(map(str, q.quality_rules(docs).collect()))
    monkeypatch.setattr(q, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(map(str, q.quality_rules(docs).collect())) == one


def test_base_columns_and_verdicts(spark):
    rows = make()
    r = random.Random(3)
    fresh = lambda k: " ".join("".join(r.choices("abcdeéßñ", k=r.randint(1, 9))) for _ in range(k))
    planted = {
        950: "\n".join(x for lines in [[fresh(2) for _ in range(20)]] for _ in range(8) for x in r.sample(lines, 20)),  # nearly every line repeats
        951: fresh(100) + " " + (p := fresh(22)) + " " + fresh(8) + " " + p,  # 29 % repeated words
        952: " ".join(w + "%%%" for w in fresh(120).split()),
        953: " ".join(w * 9 for w in fresh(120).split()),
    }
    rows += [(k, t, "en", s, "clash", "clash", "clash", 1, 2) for k, t in planted.items() for s in ("a", f"seen once {k % 2}")[: 1 + (k > 951)]]
    got = sorted((tuple(x) for x in q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    base = []
    for row in rows:
        c = plain_counts(row[1])
        base.append((row[0], *c[:5], c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert [x[:7] for x in got] == sorted(base, key=str)
    kept = {x[0]: x[7] for x in got}
    failed = {x[0]: x[6] for x in got}
    assert not any(x[7] for x in got if x[6])
    assert all(not failed[k] for k in planted) and not any(kept[k] for k in planted)
    junk = [x for x in rows if "%%%" in (x[1] or "")]
    clean = [x[0] for x in rows if x[0] is not None and x[0] < 900 and x[0] % 25 and x[0] % 40 != 3 and not failed[x[0]]]
    assert junk and not any(kept[x[0]] for x in junk)
    assert clean and all(kept[k] for k in clean)


def test_keep_clean_keeps_columns(spark):
    docs = spark.createDataFrame(make(), SCHEMA)
    kept = q.keep_clean(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    verdicts = [tuple(r) for r in q.quality_rules(docs).where("kept").select("doc_id").collect()]
    assert sorted(map(str, verdicts)) == sorted(str((r.doc_id,)) for r in kept.collect())


@pytest.mark.parametrize("n", [0, 3])
def test_few_rows(spark, n):
    docs = spark.createDataFrame(make()[4 : n + 4], SCHEMA)
    assert q.quality_rules(docs).count() == n and q.keep_clean(docs).count() == n
