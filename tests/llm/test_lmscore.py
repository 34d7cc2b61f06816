import math
import os
import random

import pytest

from lexiloom.llm import lmscore as lm
from lexiloom.llm import phraseindex as px


def plain_cross(reference, text):
    """``reference``: lines that may be matched."""
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and any(text[at : at + n + 1] in line for line in reference):
            n += 1
        at, count = at + max(n, 1), count + 1
    return count


def plain_own(text):
    seen, count, at = {""}, 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in seen:
            n += 1
        seen.add(text[at : at + n])
        at, count = at + n, count + 1
    return count


def words(r, letters, n):
    return " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(n))


@pytest.mark.parametrize(("dense", "few"), [(256, 0), (256, 99), (2, 0), (2, 99), (256, 3)])
def test_parses_match_plain_forms(monkeypatch, dense, few):
    monkeypatch.setattr(lm, "MAX_DENSE", dense)
    monkeypatch.setattr(lm, "FEW_LINES", few)
    r = random.Random(4)
    for _ in range(60):
        lines = [words(r, "abé", r.randint(1, 25)) for _ in range(r.randint(1, 6))]
        lines += r.choices(lines, k=r.randrange(3))
        owners = [r.choice([3, 5, 10**15]) for _ in lines]
        texts = [words(r, "abéz😀\0", r.randrange(40)) for _ in range(r.randint(1, 5))]
        automaton = lm.SuffixAutomaton(lines, owners)
        asked = texts + lines
        assert automaton.phrases(asked).tolist() == [plain_cross(lines, x) for x in asked]
        whose = [r.choice([None, 3, 5, 7]) for _ in asked]
        want = [plain_cross([y for y, o in zip(lines, owners, strict=True) if o != own], x) for x, own in zip(asked, whose, strict=True)]
        assert automaton.phrases(asked, whose).tolist() == want
        assert lm.own_phrases(texts[0]) == plain_own(texts[0])
    first, second = lm.SuffixAutomaton(["abc abd", "xyz"], [1, 2]), lm.SuffixAutomaton(["dd abx"] * 2, [2, 1])
    if dense > 2:
        told = lm.parse([(first, ["abd", "xyz", "abc"], [None, 2, 1]), (second, ["abd", "dd abx"], [1, 1]), (first, ["zz"], [None])])
        assert [x.tolist() for x in told] == [[1, 3, 3], [2, 1], [2]]
    assert lm.SuffixAutomaton(["abcabd"]).phrases(["abcabd", "", "abcabdx"]).tolist() == [1, 0, 2]
    # no match runs from one line into the next, whatever code points they hold
    assert lm.SuffixAutomaton(["ab￿", "￿cd"]).phrases(["ab￿￿cd", "ab\0cd"]).tolist() == [2, 3]
    assert lm.SuffixAutomaton(["a" * 3000, "b" + "a" * 2000]).phrases(["a" * 7000]).tolist() == [3]


def make():
    r = random.Random(9)
    rows = []
    for i in range(240):
        lang = ["en", "de", "xx"][i % 3]
        rows.append((i, "\n".join(words(r, {"en": "abcd", "de": "efgh", "xx": "xyz"}[lang], r.randint(0, 12)) for _ in range(r.randint(1, 9))), lang, "clash"))
    rows += [(900, words(r, "efgh", 60), "en", "c"), (901, None, "en", "c"), (902, "", "de", "c"), (903, "no language", None, "c"), (None, words(r, "abcd", 50), "en", "c"), (904, "abcd " * 30000, "en", "c"), (3, rows[3][1], "en", "c"), (905, "\n\n", "en", "c")]
    rows += [(2000 + k, rows[3][1] + "\n" + rows[6][1], "en", "c") for k in range(25)]
    return rows


def brute(spark, rows, ids):
    """Every line against its shard of the reference, by plain substring search."""
    from pyspark.sql import functions as F

    lines = sorted({line for r in rows for line in (r[1] or "").split("\n")})
    hashes = {r.line: r.h for r in spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    reference, chars = {}, {}
    for i, text, lang, _ in rows:
        if i in ids and lang:
            chars[lang] = chars.get(lang, 0) + len(text or "")
    shards = {lang: math.ceil(n / lm.SHARD_CHARS) for lang, n in chars.items() if n}
    for i, text, lang, _ in rows:
        if i in ids and lang in shards:
            for line in filter(None, (text or "").split("\n")):
                reference.setdefault((lang, hashes[line] % shards[lang]), []).append((i, line))
    out = []
    for i, text, lang, _ in rows:
        text = text or ""
        if lang not in shards:
            out.append((i, len(text), None, None, None, None))
            continue
        phrases = bits = 0
        for line in filter(None, text.split("\n")):
            there = reference.get((lang, hashes[line] % shards[lang]), [])
            n = plain_cross([x for o, x in there if i not in ids or o != i], line)
            phrases, bits = phrases + n, bits + n * math.log2(max(2, sum(len(x) for _, x in there)))
        own = plain_own(text)
        cross = bits / len(text) if text else None
        out.append((i, len(text), phrases, own, cross, cross - own * math.log2(own) / len(text) if text else None))
    return out


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CHARS", 900)
    monkeypatch.setattr(lm, "LINES_PER_TASK", 40)
    rows = [r for r in make() if r[0] != 904]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_phrases string")
    ids = {i for i in range(240) if i % 3 < 2 and i % 2}
    got = sorted((tuple(r) for r in lm.score(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()), key=str)
    want = sorted(brute(spark, rows, ids), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert all((x is None and y is None) or abs(x - y) < 2e-5 for x, y in zip(a[4:], b[4:], strict=True)), (a, b)
    # one text under 25 ids has one score, and repeats the reference
    told = {r[0]: r for r in got}
    assert len({told[2000 + k][1:] for k in range(25)}) == 1
    english = sorted(told[i][5] for i in range(0, 240, 3) if told[i][1] > 120)
    assert told[900][5] > english[-1]  # German letters under English
    assert told[2000][5] < english[0]


def test_long_text(spark):
    docs = spark.createDataFrame([r for r in make() if r[0] in (904, 3, 9)], "doc_id long, text string, lang string, n_phrases string")
    got = {r.doc_id: r for r in lm.score(docs, spark.createDataFrame([(3,), (9,)], "doc_id long")).collect()}
    assert got[904].n_chars == 150000 and got[904].n_phrases > 0


def test_good_ids_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.doc_id for r in lm.good_ids(labels).collect()] == [1]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lm.score(empty, lm.good_ids(labels)).collect() == []


def test_whole_scores_match_brute_force(spark, monkeypatch):
    """Every line against all reference lines of its language, in several pieces and buckets, by plain substring search."""
    for name, value in {"PIECE": 900, "BUCKET": 700, "CHUNK": 500, "RUN": 4}.items():
        monkeypatch.setattr(px, name, value)
    rows = [r for r in make() if r[0] != 904]
    rows += [(3000, "é😀 abcd ab￿z\0q\n" + "abab" * 60, "en", "c"), (3001, "ab" * 90 + "\n" + "ab" * 50 + "é😀", "en", "c"), (3002, "ẞ efgh\n\n", "fr", "c"), (3003, "\n\n", "it", "c"), (3004, "nel mezzo", "it", "c")]
    rows += [(3100 + k, rows[3][1][:40] + words(random.Random(k), "abcd", 3), "en", "c") for k in range(30)]
    ids = {i for i in range(240) if i % 3 < 2 and i % 2} | {3000, 3001, 3002, 3003} | {3100 + k for k in range(0, 30, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_phrases string")
    got = sorted((tuple(r) for r in lm.score(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long"), whole=True).collect()), key=str)
    reference, size = {}, {}
    for i, text, lang, _ in rows:
        if i in ids and text:
            size.setdefault(lang, 0)
            for line in filter(None, text.split("\n")):
                reference.setdefault(lang, []).append((i, line))
                size[lang] += len(line)
    want = []
    for i, text, lang, _ in rows:
        text = text or ""
        if lang not in size:
            want.append((i, len(text), None, None))
            continue
        there = [x for o, x in reference.get(lang, []) if i not in ids or o != i]
        phrases = sum(plain_cross(there, line) for line in text.split("\n"))
        want.append((i, len(text), phrases, plain_own(text), phrases * math.log2(max(2, size[lang])) / len(text) if text else None))
    want.sort(key=str)
    assert [a[:4] for a in got] == [b[:4] for b in want]
    for a, b in zip(got, want, strict=True):
        assert len(b) == 4 or (a[4] is None and b[4] is None) or abs(a[4] - b[4]) < 2e-6


def test_phrases_of_all_shards_are_seen(spark, monkeypatch):
    """A line of pieces from many reference lines has one phrase for each, wherever they are."""
    monkeypatch.setattr(lm, "SHARD_CHARS", 200)
    r = random.Random(12)
    rows = [(k, words(r, "abcdefghij", 12), "en") for k in range(60)]
    rows.append((500, "".join(x[1][5:35] for x in rows[:10]), "en"))
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k,) for k in range(60)], "doc_id long")
    got = {r.doc_id: r.n_phrases for r in lm.score(docs, ids, whole=True).collect()}
    assert got[500] <= 10 < {r.doc_id: r.n_phrases for r in lm.score(docs, ids).collect()}[500]


def test_reference_lines_are_not_compared_with_themselves(spark, monkeypatch):
    """A reference document meets itself wherever its phrases start; what is compared must not grow with the square of its lines."""
    r = random.Random(5)
    lines = [words(r, "abcdefgh", 1500) for _ in range(3)]
    rows = [(k, line, "en") for k, line in enumerate(lines)]
    place, _ = px.build(spark.createDataFrame(rows, "doc_id long, line string, grp string"))["en"]
    compared, alike = [], px._alike

    def counting(*args):
        out = alike(*args)
        compared.append(int(out.sum()))
        return out

    monkeypatch.setattr(px, "_alike", counting)
    index = px.Index(place)
    got = index.phrases([x.encode() for x in lines], [0, 1, 2])
    assert got.tolist() == [plain_cross([y for y in lines if y != x], x) for x in lines]
    assert sum(compared) < 20 * sum(map(len, lines))


@pytest.mark.parametrize("lost", [False, True])
def test_array_holds_every_suffix_in_order(spark, monkeypatch, lost):
    """Suffixes are dealt to files, in one pass; a sorting task that runs again and lacks its file takes them from the text."""
    for name, value in {"PIECE": 700, "BUCKET": 500, "CHUNK": 300}.items():
        monkeypatch.setattr(px, name, value)
    put = px._put
    if lost:
        monkeypatch.setattr(px, "_put", lambda path, data, at: None if "/dealt-" in path else put(path, data, at))
    r = random.Random(6)
    rows = [(k, words(r, "abé😀", 30), "en") for k in range(40)] + [(99, "ab" * 60, "en")]
    place, _ = px.build(spark.createDataFrame(rows, "doc_id long, line string, grp string"))["en"]
    index = px.Index(place)
    text = index.text.tobytes()[:-8]
    at = index.array.tolist()
    assert sorted(at) == [k for k, b in enumerate(text) if b & 0xC0 != 0x80 and b != 0xFF]
    told = [index.text[k : k + px.DEPTH].tobytes() for k in at]
    assert told == sorted(told)
    assert not [x for x in os.listdir(place) if x.startswith("dealt-")]
