import pyarrow.parquet as pq
import pytest

import corpus_pipeline as p
from lexiloom.llm import mixing, quality, secrets, sentencepiece
from tests.llm import test_mixing, test_quality, test_secrets, test_simhash

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def rows():
    return [tuple(r[c] for c in COLUMNS) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def brute(rows):
    """What each stage keeps, by the brute-force forms of the operators' tests."""
    kept = test_quality.brute_kept([(r[0], r[1], r[2], r[3]) for r in rows])
    judged = []
    for k, r in enumerate(rows):
        c = test_quality.plain_counts(r[1])
        if c[0] >= quality.MIN_WORDS and 100 * c[4] <= quality.MAX_REPEAT_PERCENT * c[0] and kept[k]:
            judged.append(r)
    yield judged
    best = {c for _, _, c in test_simhash.brute([r[:2] for r in judged])}
    single = [r for r in judged if r[0] in best]
    yield single
    weights = test_secrets.plain_weights()
    masked = []
    for r in single:
        text, out, at = r[1] or "", "", 0
        for a, _, b, _ in test_secrets.plain_spans(text, weights)[1]:
            if a >= at:
                out += text[at:a] + secrets.MASK
            at = max(at, b)
        new = out + text[at:]
        masked.append((r[0], new, r[2], r[3], r[4] if new == text else len(new)))
    yield masked
    drawn = test_mixing.brute([(r[0], r[1], r[3], r[2]) for r in masked], mixing.TARGETS)[0]
    sampled = [r for r, d in zip(masked, drawn, strict=True) if d[5]]
    yield sampled
    tokenizer = sentencepiece.build_tokenizer(sentencepiece.parse_model(open(sentencepiece.MODEL, "rb").read()))
    yield [(r[0], tokenizer.encode(r[1], add_special_tokens=False).ids) for r in sampled]


def test_stages_match_brute_force(spark, rows, tmp_path):
    docs, want = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), brute(rows)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(tuple, docs.collect())) == sorted(next(want)), name
    got = sorted((r.doc_id, list(r.token_ids)) for r in p.STAGES[-1][1](spark, docs, SF).collect())
    assert got and got == sorted(next(want))


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string, kept boolean, fp long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a " * 50000, "en", None, 100000), (3, " ".join(f"w{i}" for i in range(40)), "en", "a", 1)]
    odd = [(*r, "x", False, 1) for r in [*odd, odd[3], odd[3]]]
    for docs in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() <= 1
