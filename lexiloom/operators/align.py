"""One-to-one letter-phone alignment by hard EM.

The model is a table of letters by phones, small whatever the lexicon's size, so
it is broadcast; entries stay partitioned. The best placement of silent letters
is found by dynamic programming, not by listing all placements.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.symbols import EPSILON

#: Rows of a model that may be collected and broadcast (letters by phones).
MAX_MODEL_ROWS = 1_000_000


def _normalised(grid: DataFrame) -> DataFrame:
    return grid.select("letter", "phone", (F.col("w") / F.sum("w").over(Window.partitionBy("letter"))).alias("prob"))


def initial_model(entries: DataFrame) -> DataFrame:
    """(letter, phone, prob): uniform over all pairs and epsilon, heavier where they are one symbol, and for epsilon at non-letters."""
    letters = entries.select(F.explode("letters").alias("letter")).distinct()
    phones = entries.select(F.explode("phones").alias("phone")).distinct().unionByName(entries.sparkSession.createDataFrame([(EPSILON,)], "phone string")).distinct()
    weight = F.lit(1.0) + F.when(F.col("letter") == F.col("phone"), 1.0).otherwise(0.0) + F.when((F.col("phone") == EPSILON) & ~F.col("letter").rlike(r"^\p{L}"), 100.0).otherwise(0.0)
    # alphabets by phone sets: bounded by the symbols, not by the entries
    return _normalised(letters.join(F.broadcast(phones)).withColumn("w", weight))


def estimate_model(aligned: DataFrame) -> DataFrame:
    """(letter, phone, prob) of aligned entries (letters, state): add-one counts over all pairs seen, more epsilon for ' and -."""
    counts = aligned.select(F.explode(F.arrays_zip(F.col("letters").alias("letter"), F.col("state").alias("phone"))).alias("x")).groupBy("x.letter", "x.phone").agg(F.count("*").alias("n"))
    grid = counts.select("letter").distinct().join(F.broadcast(counts.select("phone").distinct()))
    boost = F.when((F.col("phone") == EPSILON) & F.col("letter").isin("'", "-"), 100.0).otherwise(0.0)
    return _normalised(grid.join(counts, ["letter", "phone"], "left").withColumn("w", F.coalesce("n", F.lit(0)) + 1.0 + boost))


def best_state(letters: list[str], phones: list[str], model: dict[tuple[str, str], float]) -> list[str] | None:
    """The most likely phone or epsilon for each letter; of equal ones that with the earliest silence."""
    n, m = len(letters), len(phones)
    if m > n:
        return None
    below = [-1.0] * (m + 1)
    below[m] = 1.0
    silent = []
    for i in range(n - 1, -1, -1):
        row, choice = [-1.0] * (m + 1), [False] * (m + 1)
        quiet = model.get((letters[i], EPSILON), 0.0)
        for j in range(max(0, m - (n - i)), min(m, i) + 1):
            a = quiet * below[j] if below[j] >= 0 else -1.0
            b = model.get((letters[i], phones[j]), 0.0) * below[j + 1] if j < m and below[j + 1] >= 0 else -1.0
            choice[j] = a >= b and a >= 0
            row[j] = a if choice[j] else b
        below = row
        silent.append(choice)
    silent.reverse()
    state, j = [], 0
    for i in range(n):
        if silent[i][j]:
            state.append(EPSILON)
        else:
            state.append(phones[j])
            j += 1
    return state


def collected(model: DataFrame) -> dict[tuple[str, str], float]:
    rows = model.limit(MAX_MODEL_ROWS + 1).collect()
    if len(rows) > MAX_MODEL_ROWS:
        raise ValueError(f"a model of more than {MAX_MODEL_ROWS} rows can't be broadcast")
    return {(r.letter, r.phone): r.prob for r in rows}


def align_once(entries: DataFrame, model: DataFrame) -> DataFrame:
    """``entries`` with ``state``: their best alignment under a model."""
    table = entries.sparkSession.sparkContext.broadcast(collected(model))
    schema = entries.select("*").schema.add("state", entries.schema["letters"].dataType)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probs = table.value
        for batch in batches:
            letters, phones = (batch.column(names.index(c)).to_pylist() for c in ("letters", "phones"))
            states = [best_state(a, b, probs) for a, b in zip(letters, phones, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.list_(pa.string()))], names)

    return entries.mapInArrow(run, schema).where("state is not null")


def align(entries: DataFrame, max_iterations: int = 100, min_change: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(aligned entries, model): align and re-estimate until no more than ``min_change`` of the entries change."""
    entries = entries.persist()
    try:
        model, before = initial_model(entries), None
        for _ in range(max_iterations):
            aligned = align_once(entries, model).persist()
            mark = aligned.agg(F.sum(F.xxhash64("letters", "state").cast("decimal(38,0)")), F.count("*")).first()
            model = estimate_model(aligned)
            if before is not None and tuple(mark) == before[0]:
                break
            if before is not None:
                if min_change:
                    changed = aligned.select("letters", "state").exceptAll(before[1].select("letters", "state")).count()
                    if changed <= min_change * mark[1]:
                        break
                before[1].unpersist()
            before = tuple(mark), aligned
        return aligned, model
    finally:
        entries.unpersist()
