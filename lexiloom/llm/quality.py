"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each whole text gives five counts. Their transformed vector (log length, log
mean word length, and the shares of symbols, repeated lines and repeated words
on a log scale) is held against the minimum-covariance-determinant (MCD)
estimate of its group of language and source; a squared Mahalanobis distance
above the chi-squared quantile rejects the text.

The MCD fit covers every text and runs as concentration steps in Spark, from
three starts (median and deviation from it, spatial signs, plain moments): a scan
of the vectors gives, per group and distance bin, counts, sums and products; the
bins nearest the centre, the last of them in part, hold the share ``SUPPORT`` of
the group and give the next mean and covariance. The start that ends with the
least determinant counts, and is reweighted. Vectors are whole numbers (units of
1/1024) with whole-number sums, so the result does not hang on the order of the
rows. A group's estimate is drawn towards that of its language, and a language's
towards that of all texts, by ``PRIOR_ROWS`` / (rows + ``PRIOR_ROWS``): groups of
any size are judged by one rule.

Defined cases: null text counts as empty, null language or source is a group of
its own; texts without words fail the base rule and stay out of the fit;
repeated rows count each; an empty table gives an empty table; other columns are
ignored (``keep_clean`` passes them through).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import checkpointed, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
UNIT = 1024
#: Rows that the estimate of the next larger group counts for.
PRIOR_ROWS = 100
SUPPORT = 0.75
#: Chance that a regular text lies beyond the limit, if vectors were normal.
TAIL = 1e-6
MAX_STEPS = 15
#: Least standard deviation of each part of the vector; shares are zero in most texts. A text in which nearly every line
#: repeats, or words at the base rule's limit, lies beyond the limit by that part alone.
FLOORS = (0.5, 0.08, 0.35, 0.7, 0.55)
#: Of the floors' squares, added to every covariance, so that few or equal rows have one that can be inverted.
RIDGE = 0.01
#: Estimates that are collected and broadcast (about 0.5 kB each); beyond, they are checkpointed and joined by a shuffle.
MAX_BROADCAST_GROUPS = 10_000
#: Distance bins to a doubling.
BINS = 16
STARTS = ("median", "signs", "moments")
PARTS = len(FLOORS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_PAIRS = [(i, j) for i in range(PARTS) for j in range(i, PARTS)]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    codes: dict[bytes, int] = {}
    ranks = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    span = 1
    while span < window:  # rank windows of 2, 4, 8 words by the pair of their halves: exact, no hashes
        step = min(span, window - span)
        _, ranks = np.unique(ranks[: len(ranks) - step] * (n + 1) + ranks[step:], return_inverse=True)
        span += step
    starts = np.bincount(ranks)[ranks] > 1
    if not starts.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    cover[:-window][starts] += 1
    cover[window:][starts] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word) of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    # code points: bytes but for the continuation bytes, less the white space
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines)


def _with_counts(docs: DataFrame, text_col: str, names: list[str], keep_text: bool) -> DataFrame:
    """The columns of ``docs`` (without the text, unless it is kept) and the six counts of its texts."""
    at = docs.columns.index(text_col)
    kept = [k for k, c in enumerate(docs.columns) if keep_text or c != text_col]
    schema = docs.select(*(docs[docs.columns[k]] for k in kept)).schema
    for n in names:
        schema = schema.add(n, "long")
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(t.as_py()) for t in batch.column(at)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *(pa.array(counts[:, k]) for k in range(len(names)))], columns)

    return docs.mapInArrow(run, schema)


def _vector(names: list[str]) -> list[Column]:
    """The transformed counts in whole units."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines = (F.greatest(F.col(n), F.lit(0)) for n in names)
    share = lambda part, whole: F.log1p(100.0 * part / F.greatest(whole, F.lit(1)))
    parts = [F.log(F.greatest(n_words, F.lit(1))), F.log(F.greatest(word_chars, F.lit(1)) / F.greatest(n_words, F.lit(1))), share(n_symbols, word_chars), share(n_dup_lines, n_lines), share(n_repeat_words, n_words)]
    return [F.round(UNIT * x).cast("long").alias(f"x{i}") for i, x in enumerate(parts)]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the covariance of the ``share`` of normal rows nearest the centre is multiplied with."""
    return 1.0 if share >= 1 else share / chi2_cdf(chi2_quantile(share, PARTS), PARTS + 2)


KEY = "level int, lang string, source string"
ESTIMATES = f"{KEY}, start string, size double, mean array<double>, cov array<double>, precision array<double>, logdet double"
_SUMS = ["n", *(f"s{i}" for i in range(PARTS)), *(f"s{i}_{j}" for i, j in _PAIRS)]


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of a number of rows, their sums and their products."""
    n, s, ss = sums[0], sums[1 : 1 + PARTS], sums[1 + PARTS :]
    mean, cov = s / n, np.empty((PARTS, PARTS))
    for (i, j), x in zip(_PAIRS, ss, strict=True):
        cov[i, j] = cov[j, i] = x / n - mean[i] * mean[j]
    return mean / UNIT, cov / UNIT**2


def _row(key: tuple, start: str, size: float, mean: np.ndarray, cov: np.ndarray) -> tuple:
    floors = np.array(FLOORS) ** 2
    cov = cov + np.diag(np.maximum(0, floors - np.diag(cov)) + RIDGE * floors)
    precision = np.linalg.inv(cov)
    flat = lambda m: [float(m[i, j]) for i, j in _PAIRS]
    return *key, start, float(size), mean.tolist(), flat(cov), flat(precision), float(np.linalg.slogdet(cov)[1])


def _full(flat: list[float]) -> np.ndarray:
    out = np.empty((PARTS, PARTS))
    for (i, j), x in zip(_PAIRS, flat, strict=True):
        out[i, j] = out[j, i] = x
    return out


_ESTIMATE_COLUMNS = [f.split()[0] for f in ESTIMATES.split(", ")]


def _key_of(frame: pd.DataFrame) -> tuple:
    return int(frame["level"].iloc[0]), *(None if pd.isna(x) else x for x in (frame["lang"].iloc[0], frame["source"].iloc[0]))


def _concentrated(frame: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group and start, from its distance bins: the nearest ones, the last in part, up to the share SUPPORT."""
    frame = frame.sort_values("bin")
    n = frame["n"].to_numpy(float)
    size = n.sum()
    part = np.clip((math.ceil(SUPPORT * size) - (np.cumsum(n) - n)) / n, 0, 1)
    sums = part @ frame[_SUMS].to_numpy(float)
    mean, cov = _moments(sums)
    return pd.DataFrame([_row(_key_of(frame), frame["start"].iloc[0], size, mean, cov * consistency(sums[0] / size))], columns=_ESTIMATE_COLUMNS)


def _reweighted(frame: pd.DataFrame) -> pd.DataFrame:
    """The estimate from the rows within the 0.975 quantile; the share that a normal group has there, not what was met: outliers must not widen it."""
    mean, cov = _moments(frame[_SUMS].to_numpy(float).sum(axis=0))
    return pd.DataFrame([_row(_key_of(frame), frame["start"].iloc[0], frame["size"].iloc[0], mean, cov * consistency(0.975))], columns=_ESTIMATE_COLUMNS)


def _distance() -> Column:
    total: Column = F.lit(0.0)
    d = [F.col(f"x{i}") / float(UNIT) - F.col("mean")[i] for i in range(PARTS)]
    for k, (i, j) in enumerate(_PAIRS):
        total = total + F.col("precision")[k] * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def _sums(x: list[Column] | None = None) -> list[Column]:
    x = x or [F.col(f"x{i}") for i in range(PARTS)]
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(PARTS)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _PAIRS)]


def _settled(df: DataFrame, small: bool) -> tuple[DataFrame, list]:
    """``df`` computed: rows on the driver if there are few, whose number is checked before, else a checkpoint."""
    if not small:
        return checkpointed(df), []
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema), rows


def _joined(rows: DataFrame, told: DataFrame, small: bool, keys: tuple[str, ...] = ("level", "lang", "source"), how: str = "inner") -> DataFrame:
    """Null-safe join; ``told`` is broadcast only if it was found to be small."""
    told = told.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(F.broadcast(told) if small else told, on, how).drop(*(f"__{k}" for k in keys))


def _levels(vectors: DataFrame) -> DataFrame:
    """Each row for its group, its language and all texts."""
    none = F.lit(None).cast("string")
    keys = [F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")) for level, lang, source in ((2, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (0, none, none))]
    return vectors.select(F.explode(F.array(*keys)).alias("k"), *(f"x{i}" for i in range(PARTS))).select("k.*", *(f"x{i}" for i in range(PARTS)))


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """(key, start, mean, precision) of each start; only the order of distances matters."""
    by = ["level", "lang", "source"]
    median = _settled(rows.groupBy(*by).agg(*(F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(PARTS))), small)[0]
    off = _joined(rows, median, small)
    deviation = off.groupBy(*by, *(f"m{i}" for i in range(PARTS))).agg(*(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i in range(PARTS)))
    spread = [F.greatest(1.4826 * F.col(f"d{i}") / UNIT, F.lit(FLOORS[i])).alias(f"d{i}") for i in range(PARTS)]
    scale = _settled(deviation.select(*by, *((F.col(f"m{i}") / UNIT).alias(f"m{i}") for i in range(PARTS)), *spread), small)[0]
    scaled = _joined(rows, scale, small)
    z = [(F.col(f"x{i}") / float(UNIT) - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(PARTS)]
    norm = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    signs = scaled.select(*by, *(F.when(norm > 0, F.round(UNIT * x / norm)).otherwise(0).cast("long").alias(f"z{i}") for i, x in enumerate(z)), *(f"x{i}" for i in range(PARTS)))
    both = [*_sums(), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"z{i}_{j}") for i, j in _PAIRS)]
    told = _joined(signs.groupBy(*by).agg(*both), scale, small)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at in range(len(frame)):
                r = frame.iloc[at : at + 1]
                key, size = _key_of(r), float(r["n"].iloc[0])
                m, d = (r[[f"{c}{i}" for i in range(PARTS)]].to_numpy(float)[0] for c in "md")
                mean, cov = _moments(r[_SUMS].to_numpy(float)[0])
                shape = _full(r[[f"z{i}_{j}" for i, j in _PAIRS]].to_numpy(float)[0] / size / UNIT**2) * np.outer(d, d) * PARTS
                out += [_row(key, "median", size, m, np.diag(d * d)), _row(key, "signs", size, m, shape), _row(key, "moments", size, mean, cov)]
            yield pd.DataFrame(out, columns=_ESTIMATE_COLUMNS)

    return _settled(told.mapInPandas(run, ESTIMATES), small)[0]


def _drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a group's estimate with those of its language and of all texts: each drawn towards the next."""

    def mixed(size: float, mean: np.ndarray, cov: np.ndarray, above: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w, off = size / (size + PRIOR_ROWS), mean - above[0]
        return w * mean + (1 - w) * above[0], w * cov + (1 - w) * above[1] + w * (1 - w) * np.outer(off, off)

    for frame in frames:
        out = []
        for r in frame.to_dict("records"):
            own, lang, every = ((r[f"size{k}"], np.array(r[f"mean{k}"], float), _full(r[f"cov{k}"])) for k in (2, 1, 0))
            mean, cov = mixed(*own, mixed(*lang, every[1:]))
            precision = np.linalg.inv(cov)
            key = (None if pd.isna(x) else x for x in (r["lang"], r["source"]))
            out.append((*key, mean.tolist(), [float(precision[i, j]) for i, j in _PAIRS]))
        yield pd.DataFrame(out, columns=["lang", "source", "mean", "precision"])


def mcd(rows: DataFrame, small: bool) -> DataFrame:
    """ESTIMATES, one for each key (level, lang, source) of ``rows``: the start with the least determinant, reweighted."""
    by = ["level", "lang", "source"]
    now = _starts(rows, small)
    done = now.where("false")
    for k in range(MAX_STEPS):
        bins = _joined(rows, now, small).withColumn("bin", F.floor(BINS * F.log2(_distance() + 2.0**-10)).cast("int")).groupBy(*by, "start", "bin").agg(*_sums())
        after, told = _settled(bins.groupBy(*by, "start").applyInPandas(_concentrated, ESTIMATES), small)
        was = now.select(*by, "start", F.col("logdet").alias("was"))
        step = _joined(after, was, False, (*by, "start"))
        # starts have no determinant of so many rows yet
        still = (F.col("was") - F.col("logdet") > 1e-9) if k else F.lit(True)
        if small:  # a few rows on the driver: no job
            before = {tuple(r[c] for c in (*by, "start")): r.logdet for r in now.collect()}
            going = [r for r in told if not k or before[tuple(r[c] for c in (*by, "start"))] - r.logdet > 1e-9]
            names = {tuple(r[c] for c in (*by, "start")) for r in going}
            spark = rows.sparkSession
            done = spark.createDataFrame(done.collect() + [r for r in told if tuple(r[c] for c in (*by, "start")) not in names], after.schema)
            now = spark.createDataFrame(going, after.schema)
            if not going:
                break
        else:
            done = checkpointed(done.unionByName(step.where(~still).drop("was")))
            now = checkpointed(step.where(still).drop("was"))
            if now.isEmpty():
                break
    every = done.unionByName(now)
    best = every.groupBy(*by).agg(F.min_by(F.struct("start", "size", "mean", "precision"), F.struct("logdet", "start")).alias("b")).select(*by, "b.*")
    regular = _joined(rows, _settled(best, small)[0], small).where(_distance() <= chi2_quantile(0.975, PARTS)).groupBy(*by, "start", "size").agg(*_sums())
    return _settled(regular.groupBy(*by).applyInPandas(_reweighted, ESTIMATES), small)[0]


def fit(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """(lang, source, mean, precision) of each group of ``vectors`` (lang, source, x0, x1, ...), and whether they are few."""
    small = vectors.select("lang", "source").distinct().count() <= MAX_BROADCAST_GROUPS // len(STARTS) // 2
    told = mcd(_levels(vectors), small)
    level = lambda k: told.where(F.col("level") == k).select("lang", "source", *(F.col(c).alias(f"{c}{k}") for c in ("size", "mean", "cov")))
    both = _joined(level(2), level(1).drop("source"), small, ("lang",))
    full = _joined(both.withColumn("one", F.lit(0)), level(0).drop("lang", "source").withColumn("one", F.lit(0)), small, ("one",)).drop("one")
    return _settled(full.mapInPandas(_drawn, "lang string, source string, mean array<double>, precision array<double>"), small)[0], small


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, keep_text: bool) -> DataFrame:
    """row (the columns of ``docs``), the five counts, base_failed, kept."""
    names = [f"__{n}" for n in (*COUNTS, "n_lines")]
    rows = written(_with_counts(docs, text_col, names, keep_text), "quality")
    own = [c for c in rows.columns if c not in names]
    lang, source = F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")
    rows = rows.select(F.struct(*own).alias("row"), *(F.col(f"__{n}").alias(n) for n in COUNTS), lang, source, *_vector(names))
    fitted, small = fit(rows.where("n_words > 0").select("lang", "source", *(f"x{i}" for i in range(PARTS))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    regular = F.col("mean").isNull() | (_distance() <= chi2_quantile(1 - TAIL, PARTS))
    return _joined(rows, fitted, small, ("lang", "source"), "left").select("row", *COUNTS, failed.alias("base_failed"), (~failed & regular).alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    return _judged(narrow, "text", "lang", "source", False).select("row.doc_id", *COUNTS, "base_failed", "kept")


def keep_clean(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that both the base rule and the MCD rule keep, all columns unchanged."""
    return _judged(docs, text_col, lang_col, source_col, True).where("kept").select("row.*")
