import random
import re
from collections import Counter

from lexiloom.llm import licenses as li

SCHEMA = "doc_id long, text string, license string, dice int"


def plain(text):
    """Every passage against every template, without bounds."""
    text = text or ""
    units, at = {(0, len(text))}, 0
    lines = []
    for line in text.split("\n"):
        lines.append((at, at + len(line), bool(re.search(r"[^\x20\x09-\x0D]", line))))
        at += len(line) + 1
    units |= {(a, b) for a, b, full in lines if full}
    k = 0
    while k < len(lines):
        if lines[k][2]:
            first = k
            while k < len(lines) and lines[k][2]:
                k += 1
            units.add((lines[first][0], lines[k - 1][1]))
        k += 1
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = lambda t: re.findall(r"[0-9]+(?:\.[0-9]+)*|[0-9a-z]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    bag = lambda w: Counter(zip(w, w[1:], strict=False))
    out = []
    for a, b in sorted(units, key=lambda u: (u[0], -u[1])):
        one = bag(words(lower[a:b]))
        scores = []
        for name, template in sorted(li.TEMPLATES.items()):
            two = bag(words(template))
            both, total = sum((one & two).values()), sum(one.values()) + sum(two.values())
            if total and 20 * both >= 8 * total:
                scores.append((2 * both / total, name))
        if scores:
            top = max(s for s, _ in scores)
            out.append((top, a, b, next(n for s, n in scores if s == top)))
    return out


def make():
    r = random.Random(2)
    names = list(li.TEMPLATES)
    texts = [None, "", "one", " \n\n ", "license", "Released under the MIT License.", "RELEASED under\nthe MIT license!", "é " * 40000 + "\nLicensed under CC BY-NC 4.0.\n"]
    for _ in range(120):
        words = li.TEMPLATES[r.choice(names)].split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(["foo", "license", "the", "ÄÖ"])
        notice = (" " if r.random() < 0.7 else "\n").join(words)
        texts.append("\n".join(["prose about nothing at all"] * r.randrange(3)) + r.choice(["\n", "\n\n", ""]) + notice + r.choice(["\n", "\n\n  \n", " "]) + "more prose")
    return texts


def test_matches_brute_force(spark):
    texts = make()
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, texts[5], "x", 1), (5, texts[5], "x", 1)], SCHEMA)
    got = li.scan(docs).collect()
    assert len(got) == len(texts) + 2
    found = 0
    for r in got:
        want = plain(texts[5 if r.doc_id is None else r.doc_id])
        assert r.matches == ",".join(f"{n}:{a}:{b}" for _, a, b, n in want) and r.n_matches == len(want)
        best = max(want, key=lambda x: (x[0], -x[1], x[2]), default=None)
        assert (r.license, r.dice) == ((best[3], round(best[0], 6)) if best else (None, None))
        found += bool(want)
    assert found > 60
    assert li.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_over_breaks_and_within_lines(spark, tmp_path):
    from lexiloom.llm.queries import op3_license_scans

    prose = "prose about nothing at all\n" * 20
    gpl, isc = (li.TEMPLATES[k].split() for k in ("GPL-3.0 header", "ISC"))
    broken = lambda w: " ".join(w[: len(w) // 2]) + "\n\n" + " ".join(w[len(w) // 2 :])
    texts = [
        prose + broken(gpl) + "\n\n" + prose,
        prose + broken(isc) + "\n\n" + prose,
        "Copyright 2021 Ada Lovelace. Released under the MIT License.",
        "The tool is small and quick. Licensed under CC BY-NC 4.0. See the site.",
        broken(gpl) + " Parts are from elsewhere and of other origin. Released under the MIT License. And so on.",
        "A driving license and the software of its author, with no warranties. " * 30,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op3_license_scans(spark, str(tmp_path)).collect()}
    assert [got[k].license for k in range(6)] == ["GPL-3.0 header", "ISC", "MIT", "CC-BY-NC-4.0", "MIT", None]
    assert all(got[k].dice == 1.0 for k in range(4))
    name, start, end = got[2].matches.split(":")
    assert texts[2][int(start) : int(end)] == "Released under the MIT License"
    assert {m.split(":")[0] for m in got[4].matches.split(",")} == {"GPL-3.0 header", "MIT"}
