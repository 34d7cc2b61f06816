"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format), and a tokenizer with the
same behaviour is rebuilt from it: the normaliser (character map, white-space
rules, metaspace marker), the unigram scores or the BPE merges that the scores
imply, and byte fallback. Batches are encoded by the library's threads.
With ``parity``, ids and decoded texts are held against the sentencepiece library.

Defined cases: null text encodes as empty, without ids; texts are encoded
whole, whatever their length; repeated rows and null ids are encoded like any
other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the driver's tokenizers lie; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts, or characters, that one call of the library encodes.
BATCH_TEXTS, BATCH_CHARS = 256, 1_000_000
#: Of a model file that is broadcast.
MAX_MODEL_BYTES = 32 << 20


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-size values and submessages as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[wire] if wire != 2 else varint()
        yield tag >> 3, raw[at : at + size]
        at += size


def parse_model(raw: bytes) -> Model:
    """A serialised SentencePiece model."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.treat_whitespace_as_suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 44:
                    model.unk_surface = v.decode("utf-8")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """The pairs that may merge, best score of the merged piece first (of equal scores, the lower id)."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, UNUSED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-model.pieces[i][1], i, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: Model):
    """A ``tokenizers.Tokenizer`` that encodes and decodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind not in (UNIGRAM, BPE) or not model.escape_whitespaces or model.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with a metaspace prefix are supported")
    unk = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unk, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), unk_token=model.pieces[unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # turns spaces into markers one by one, where normalizers.Replace runs a regular expression; the text stays in one piece
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=False)
    added = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if added:
        tokenizer.add_tokens(added)
    # never a prefix of its own: a first piece may hold several markers, and only one is the dummy prefix
    parts = [decoders.Metaspace(replacement=MARK, prepend_scheme="never", split=False)]
    if model.byte_fallback:
        parts.append(decoders.ByteFallback())
    parts.append(decoders.Fuse())
    if model.add_dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return tokenizer


def build_decoder(model: Model, tokenizer):
    """A tokenizer for decoding what ``tokenizer`` encoded: pieces are joined before markers become spaces, not after.

    That differs only for bytes that spell a marker, which no text is encoded as where the marker is a piece; other
    models get ``tokenizer`` itself, as do those with user-defined pieces.
    """
    from tokenizers import Tokenizer, decoders

    kinds = {p: kind for p, _, kind in model.pieces}
    if not model.byte_fallback or kinds.get(MARK) != NORMAL or USER_DEFINED in kinds.values():
        return tokenizer
    quick = Tokenizer(tokenizer.model)
    parts = [decoders.ByteFallback(), decoders.Fuse(), decoders.Metaspace(replacement=MARK, prepend_scheme="never", split=False)]
    if model.add_dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    quick.decoder = decoders.Sequence(parts)
    return quick


_BUILT: dict[bytes, tuple] = {}


def _built(raw: bytes, threads: int):
    """(tokenizer, decoder of what it encodes, sentencepiece processor) of a model, once per worker process."""
    key = hashlib.sha256(raw).digest()
    if key not in _BUILT:
        # read when the library starts its threads
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor()
        processor.LoadFromSerializedProto(raw)
        model = parse_model(raw)
        tokenizer = build_tokenizer(model)
        _BUILT[key] = tokenizer, build_decoder(model, tokenizer), processor
    return _BUILT[key]


def _chunks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in order, few enough at once for bounded memory: the column as a whole never becomes Python strings."""
    sizes = pc.utf8_length(column).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin == BATCH_TEXTS or size + n > BATCH_CHARS):
            yield column.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield column.slice(begin).to_pylist()


def _model_bytes(df: DataFrame, model: str):
    with open(model, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is larger than {MAX_MODEL_BYTES} bytes, too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, parity: bool = False) -> DataFrame:
    """(doc_id, token_ids, n_tokens, lossless[, parity]) of every row.

    ``lossless``: decoding gives the text back. ``parity``: the sentencepiece
    library has the same ids for the text and the same text for the ids.
    """
    raw = _model_bytes(docs, model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = rows.select("doc_id").schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("lossless", "boolean")
    if parity:
        schema = schema.add("parity", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, decoder, processor = _built(raw.value, threads)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                back = decoder.decode_batch(ids, skip_special_tokens=False)
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())]
                if parity:
                    other = processor.encode(texts, num_threads=threads)
                    texts_of_other = processor.decode(other, num_threads=threads)
                    arrays.append(pa.array([a == b and c == d for a, b, c, d in zip(ids, other, back, texts_of_other, strict=True)], pa.bool_()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids", threads: int = 2) -> DataFrame:
    """(doc_id, text) of rows of token ids; null ids give null, no ids the empty text."""
    raw = _model_bytes(rows, model)
    narrow = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids"))
    schema = narrow.select("doc_id").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, *_ = _built(raw.value, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                ids = part.column(1).to_pylist()
                texts = tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], schema.names)

    return narrow.mapInArrow(run, schema)
