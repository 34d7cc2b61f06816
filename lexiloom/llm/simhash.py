"""SimHash near-duplicates, found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (21, 21 and 22 bits). Two
fingerprints that differ in four bits at most differ in at most one bit within
some segment, so they agree on that segment with one of its bits deleted. Every
fingerprint is indexed under each of its 64 one-wildcard segment variants, an
equality join brings candidates together, and the join condition verifies the
distance. The first segment that qualifies (and its first position, where the
segments are equal) alone reports a pair, so no pair comes twice.

Such a key has about 20 bits, so that candidates grow with the square of the
fingerprints. Beyond ``SECOND_KEY_FROM`` of them a second exact key is added: a
pair that differs in at most one bit of a segment differs in at most four of the
other bits, so of five parts that those are cut into one is equal. Keys then
have about 29 bits, and either plan finds the same pairs.

Defined cases: null text counts as empty; a text without words has fingerprint
zero, which links like any other; a null id takes part, and is never the
smallest of a component unless it holds nothing else; repeated rows stay
repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.shared import connected_components, written

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: First bit of each segment, and the end.
CUTS = (0, 21, 42, 64)
#: Distinct fingerprints from which five times the index rows cost less than the candidates they save.
SECOND_KEY_FROM = 16_000_000
#: Hashes that one numpy pass holds; below 65,536, as the lanes count in 16 bits.
PASS = 60_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _hashes(text: str | None, size: int) -> np.ndarray:
    # bytes.split() parts at exactly \x20 and \x09-\x0D
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(s, SEED) for s in shingles), np.uint64)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of ``hashes`` from a start to the next, how many have each of the 64 bits; runs under 65,536."""
    counts = np.empty((len(starts), 64), np.int64)
    lanes = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, starts)
        for lane in range(4):
            counts[:, 16 * lane + k] = (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    return counts


def fingerprints_of(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit SimHash of each text: bit b is set if over half of its shingle hashes have bit b."""
    totals, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    runs: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if runs:
            starts = np.cumsum([0, *map(len, runs[:-1])])
            np.add.at(totals, owner, _bit_counts(np.concatenate(runs), starts))
        runs.clear(), owner.clear()
        held = 0

    for i, text in enumerate(texts):
        h = _hashes(text, size)
        sizes[i] = len(h)
        for at in range(0, len(h), PASS):
            runs.append(h[at : at + PASS])
            owner.append(i)
            held += len(runs[-1])
        if held >= PASS:
            flush()
    flush()
    bits = (2 * totals > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(row_id, text_hash, fp): the fingerprint of every whole text, and Spark's 64-bit hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = pa.array(fingerprints_of(part.column(2).to_pylist(), size), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fps], ["row_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "row_id long, text_hash long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) * (mask >> 63)


def _bits(begin: int, end: int) -> int:
    return (1 << end) - (1 << begin)


def _parts(segment: int, number: int) -> list[int]:
    """Masks of the parts that the bits outside a segment are cut into."""
    outside = [b for b in range(64) if not CUTS[segment] <= b < CUTS[segment + 1]]
    cuts = [k * len(outside) // number for k in range(number + 1)]
    return [sum(1 << b for b in outside[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _variants(fps: DataFrame, name: str, parts: int) -> DataFrame:
    """(p, part, key, name): the fingerprint's variants, each once for every part of the second key (one, empty, if ``parts`` is 0)."""
    fp, p = F.col("fp"), F.col("p")
    one = F.expr("shiftleft(1L, p)")
    value: Column = F.lit(None)
    for begin, end in zip(CUTS, CUTS[1:], strict=False):
        segment = F.shiftrightunsigned(fp.bitwiseAND(F.bitwise_not(one)), begin).bitwiseAND(F.lit((1 << (end - begin)) - 1))
        value = F.when((p >= begin) & (p < end), segment).otherwise(value)
    key = p * (1 << 22) + value.cast("int")
    spread = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    if not parts:
        return spread.select(key.cast("int").alias("key"), F.col("fp").alias(name))
    held: Column = F.lit(None)
    for s in range(len(CUTS) - 1):
        here = F.array(*(F.struct(F.lit(k).alias("part"), fp.bitwiseAND(F.lit(_signed(m))).alias("rest")) for k, m in enumerate(_parts(s, parts))))
        held = F.when((p >= CUTS[s]) & (p < CUTS[s + 1]), here).otherwise(held)
    return spread.select(key.cast("int").alias("key"), F.explode(held).alias("x"), F.col("fp").alias(name)).select("key", "x.part", "x.rest", name)


def linked_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, second_key: bool | None = None) -> DataFrame:
    """(a, b), a < b: pairs of distinct values of ``fp`` that differ in 1 to ``max_bits`` bits, each once.

    Exact for ``max_bits`` up to 5 (three segments, one wildcard), with the second key or without (None: by their number).
    """
    if not 0 < max_bits <= 5:
        raise ValueError("three segments with one wildcard find up to 5 differing bits")
    distinct = fps.select("fp").where("fp is not null").distinct()
    if second_key is None:
        second_key = distinct.count() >= SECOND_KEY_FROM
    parts = max_bits + 1 if second_key else 0
    left, right = _variants(distinct, "a", parts), _variants(distinct, "b", parts)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    p = F.shiftright("key", 22)
    first: Column = F.lit(False)
    before: Column = F.lit(True)
    for s, (begin, end) in enumerate(zip(CUTS, CUTS[1:], strict=False)):
        here = F.bit_count(differ.bitwiseAND(F.lit(_signed(_bits(begin, end)))))
        own = (p >= begin) & (p < end) & ((here == 1) | (p == begin))
        if parts:  # the first part that is equal
            found: Column = F.lit(None).cast("int")
            for k, m in reversed(list(enumerate(_parts(s, parts)))):
                found = F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, k).otherwise(found)
            own = own & (F.col("part") == found)
        first = first | (before & own)
        before = before & (here > 1)
    keys = ["key", "part", "rest"] if parts else ["key"]
    return left.hint("merge").join(right, keys).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & first).select("a", "b")


def components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component, component_id): for each fingerprint of (row_id, fp) its component's least fingerprint and least row_id."""
    groups = written(fps.groupBy("fp").agg(F.min("row_id").alias("least")), "simhash-groups")
    links = connected_components(linked_fingerprints(groups, max_bits))
    members = links.join(groups, links.node == groups.fp).select("component", "fp", "least")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "component").select("fp", "component", "component_id")
    alone = F.col("component").isNull()
    return groups.join(linked, "fp", "left").select(
        "fp",
        F.when(alone, F.col("fp")).otherwise(F.col("component")).alias("component"),
        F.when(alone, F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(components(fps, max_bits), "fp").select(F.col("row_id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, one for each component: that with the smallest id.

    A null id yields to any other id of its component; a component of null ids
    keeps one row. Of rows repeated with one id and one text, one stays (by a
    hash of all columns that can be hashed).
    """
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    row_id = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(text_hash, F.lit(1 << 61)))
    named = docs.withColumns({"__row_id": row_id, "__text_hash": text_hash})
    fps = written(fingerprints(named.select("__row_id", F.col(text_col).alias("text")), "__row_id"), "simhash")
    best = fps.join(components(fps, max_bits), "fp").groupBy("component").agg(F.min(F.struct("row_id", "text_hash")).alias("best"))
    repeats = fps.groupBy("row_id", "text_hash").agg(F.count("*").alias("__n"))
    keys = best.select("best.*").join(repeats, ["row_id", "text_hash"])
    keys = written(keys.select(F.col("row_id").alias("__row_id"), F.col("text_hash").alias("__text_hash"), "__n"), "simhash-kept")
    rows = named.join(keys.hint("shuffle_hash"), ["__row_id", "__text_hash"])
    if keys.where("__n > 1").isEmpty():
        return rows.select(*(rows[c] for c in docs.columns))
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    once = rows.where("__n > 1").groupBy("__row_id", "__text_hash").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashable)).alias("row"))
    return rows.where("__n = 1").select(*docs.columns).unionByName(once.select("row.*"))
