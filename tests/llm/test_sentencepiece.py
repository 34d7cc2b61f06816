import struct

import pyarrow.parquet as pq
import pytest
import sentencepiece

from lexiloom.llm import sentencepiece as sp

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  a  b ", "\n\n x\t", "é😀́ ﬁ Ａ", "a\x00b", "     ", "<s> </s> <unk> <0x41>", "long " * 30000, "x" * 50000, "日本語のテキスト", "word", "word"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        else:
            out += varint(number << 3) + varint(value)
    return out


def unigram(byte_fallback, remove):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    words = ["▁", "▁th", "▁the", "th", "t", "h", "e", "a", "an", "and", "▁and", "n", "d", "s", "▁s", "and▁x", "▁▁", "b", "c", "x"]
    pieces += [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    trainer = message((3, 1), (35, int(byte_fallback)), (40, 0), (41, 1), (42, 2), (43, 2**64 - 1))
    normalizer = message((1, b"identity"), (3, 1), (4, int(remove)), (5, 1))
    return message(*((1, message((1, p.encode()), (2, s), (3, k))) for p, s, k in pieces), (2, trainer), (3, normalizer))


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("remove", [True, False])
def test_unigram_parity(byte_fallback, remove):
    raw = unigram(byte_fallback, remove)
    ours, theirs = sp.build_tokenizer(sp.parse_model(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in ["the and  that  ", "thand xs and▁x", "", "   ", " the cat sat", "the zéd", "a" * 3000, "and xand x"]:
        assert ours.encode(text, add_special_tokens=False).ids == theirs.encode(text), text


def test_bpe_parity_and_round_trip(spark):
    texts = TEXTS + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    docs = spark.createDataFrame([(None if k == 3 else k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, token_ids string, n_tokens int")
    rows = sp.encode(docs, parity=True)
    got = rows.collect()
    assert len(got) == len(texts) and all(r.parity and r.lossless and r.n_tokens == len(r.token_ids) for r in got)
    other = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    for r in got:
        if r.doc_id is not None:
            assert r.token_ids == other.encode(texts[r.doc_id] or "")
    back = {r.doc_id: r.text for r in sp.decode(rows.drop("lossless")).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts) if k != 3)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(empty).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in sp.decode(rows).collect()} == {1: None, 2: ""}


def test_joined_decoding_matches():
    """Joining pieces before markers become spaces gives the decoding of every encoded text; other ids go to the tokenizer's own decoder."""
    with open(sp.MODEL, "rb") as f:
        model = sp.parse_model(f.read())
    tokenizer = sp.build_tokenizer(model)
    decoder = sp.build_decoder(model, tokenizer)
    assert decoder is not tokenizer
    texts = [t or "" for t in TEXTS] + ["▁a ▁▁b▁", " ▁", "▁", "a\u2581\u0301", "\ue296\u0081"] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    ids = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert decoder.decode_batch(ids, skip_special_tokens=False) == tokenizer.decode_batch(ids, skip_special_tokens=False)
    # bytes that spell a marker stay one in decode(), and a model without the marker as a piece keeps its decoder
    spelled = [tokenizer.token_to_id(f"<0x{b:02X}>") for b in sp.MARK.encode()]
    assert tokenizer.decode(spelled, skip_special_tokens=False) == sp.MARK
    bare = sp.Model([p for p in model.pieces if p[0] != sp.MARK], model.kind, True)
    assert sp.build_decoder(bare, tokenizer) is tokenizer
