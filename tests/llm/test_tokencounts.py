import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import tokencounts as tc

COUNTER = tc.Counter(open(tc.RANKS, "rb").read())
ALPHABET = st.text(alphabet="ab 's\n\t1.,é😀'lvre", max_size=60)


def test_count_is_the_encoders():
    for text in ["", "it's  we'll \n\n x", "a" * 500, "   ", "don't 'dont 12345 é😀"]:
        assert tc.plant(COUNTER, text).n_tokens == len(COUNTER.encoding.encode_ordinary(text))


@settings(max_examples=400, deadline=None)
@given(ALPHABET, st.lists(st.tuples(st.integers(-3, 70), st.integers(-3, 70), ALPHABET), max_size=6))
def test_edits_count_as_a_new_text(text, edits):
    tree, plain = tc.plant(COUNTER, text), text
    for a, b, new in edits:
        tree.edit(a, b, new)
        a = min(max(a, 0), len(plain))
        plain = plain[:a] + new + plain[min(max(b, a), len(plain)) :]
        fresh = tc.plant(COUNTER, plain)
        assert tree.text == plain and tree.arrays() == fresh.arrays() and tree.n_tokens == fresh.n_tokens
        assert tree.chars[1] == len(plain)


def test_long_text_touches_little():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40000))
    tree = tc.plant(COUNTER, text)
    for _ in range(200):
        a = r.randrange(len(tree.text))
        tree.edit(a, a + r.randrange(30), r.choice(["", "new words here", " ", "x" * 50]))
    assert tree.reencoded < 200 * 12
    assert tree.n_tokens == len(COUNTER.encoding.encode_ordinary(tree.text))
    tree.edit(0, 10**9, "word " * 5000)
    assert tree.arrays() == tc.plant(COUNTER, "word " * 5000).arrays()
    tree.edit(0, 10**9, "")
    assert tree.n_tokens == 0


def test_frames(spark):
    rows = [(1, "some text, that's edited here", "c"), (1, "some text, that's edited here", "c"), (None, "w " * 3000, "c"), (2, None, "c"), (3, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string")
    trees = tc.build_trees(docs)
    assert sorted(str((r.doc_id, r.n_tokens)) for r in trees.collect()) == sorted(str((a, len(COUNTER.encoding.encode_ordinary(t or "")))) for a, t, _ in rows)
    done = tc.apply_edits(trees.withColumn("edits", tc.edit_script())).collect()
    for r in done:
        assert r.n_tokens == len(COUNTER.encoding.encode_ordinary(r.text)) == sum(r.counts)
    assert len(done) == 5 and done[0].text != rows[0][1]
    assert tc.build_trees(docs.limit(0)).collect() == []


@pytest.mark.parametrize("edits", ["null", "array(null)", "array(named_struct('start', null, 'end', null, 'text', null))"])
def test_null_edits(spark, edits):
    trees = tc.build_trees(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    got = tc.apply_edits(trees.selectExpr("*", f"cast({edits} as array<struct<start:long,end:long,text:string>>) as edits")).first()
    assert (got.text, got.n_tokens, got.n_reencoded) == ("a b c", 3, 0)
