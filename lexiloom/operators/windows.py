"""Context windows and counts of vectors, letters, phones and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.arrays import bigrams, context_windows
from lexiloom.symbols import BEGIN, END


def aligned_positions(aligned: DataFrame, keys: list[str], width: int = 7) -> DataFrame:
    """(keys, pos, c0, ..., p): the window around each letter and the phone aligned with it."""
    rows = aligned.select(*keys, F.posexplode(F.arrays_zip(context_windows(F.col("letters"), width).alias("w"), F.col("state").alias("p"))).alias("pos", "x"))
    return rows.select(*keys, (F.col("pos") + 1).alias("pos"), *(F.get("x.w", i).alias(f"c{i}") for i in range(width)), F.col("x.p").alias("p"))


def vector_counts(aligned: DataFrame, width: int = 7) -> DataFrame:
    names = [f"c{i}" for i in range(width)]
    return aligned_positions(aligned, [], width).drop("pos").groupBy(*names, "p").agg(F.count("*").alias("n"))


def letter_phone_counts(aligned: DataFrame) -> DataFrame:
    """(letter, phone, n) over aligned positions."""
    pairs = aligned.select(F.explode(F.arrays_zip(F.col("letters").alias("letter"), F.col("state").alias("phone"))).alias("x"))
    return pairs.groupBy("x.letter", "x.phone").agg(F.count("*").alias("n"))


def ngram_counts(sequences: DataFrame, tokens: Column, order: int = 3) -> DataFrame:
    """(w1, w2, w3, k, n): n-grams of every order up to ``order``, with begin and end marks; missing words null."""
    padded = F.concat(F.array_repeat(F.lit(BEGIN), 1), tokens, F.array(F.lit(END)))
    grams = lambda k: F.when(F.size(padded) >= k, F.transform(F.sequence(F.lit(0), F.size(padded) - k), lambda i: F.struct(*((F.get(padded, i + j) if j < k else F.lit(None).cast("string")).alias(f"w{j + 1}") for j in range(3)), F.lit(k).alias("k"))))
    return sequences.select(F.explode(F.concat(*(F.coalesce(grams(k), F.expr("cast(array() as array<struct<w1:string,w2:string,w3:string,k:int>>)")) for k in range(1, order + 1)))).alias("g")).groupBy("g.w1", "g.w2", "g.w3", "g.k").agg(F.count("*").alias("n"))


def bigram_counts(entries: DataFrame) -> DataFrame:
    """(side, bigram, n) of letters and of phones."""
    side = lambda name, c: F.struct(F.lit(name).alias("side"), bigrams(F.col(c)).alias("grams"))
    rows = entries.select(F.explode(F.array(side("letters", "letters"), side("phones", "phones"))).alias("x"))
    return rows.select("x.side", F.explode("x.grams").alias("bigram")).groupBy("side", "bigram").agg(F.count("*").alias("n"))


def split_test(entries: DataFrame, seed: str = "42", fraction: float = 0.1, max_test: int | None = 2000) -> DataFrame:
    """``entries`` with is_test: words ranked by hash, as many as min(max_test, max(1, fraction * n)) of them.

    The cut is found from counts per hash prefix, so no task ranks all words.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("word")), 256)
    hashed = entries.withColumns({"__h": digest, "__prefix": F.substring(digest, 1, 3)})
    words = hashed.select("__h", "__prefix").distinct()
    by_prefix = words.groupBy("__prefix").agg(F.count("*").alias("n"))
    total = by_prefix.agg(F.sum("n")).first()[0] or 0
    want = max(1, int(total * fraction))
    want = min(max_test, want) if max_test else want
    running = by_prefix.withColumn("before", F.sum("n").over(Window.orderBy("__prefix")) - F.col("n"))  # 4,096 rows
    rank = F.row_number().over(Window.partitionBy("__prefix").orderBy("__h"))
    picked = words.withColumn("__rank", rank).join(F.broadcast(running.drop("n")), "__prefix").where(F.col("before") + F.col("__rank") <= want)
    return hashed.join(picked.select("__h", F.lit(True).alias("is_test")), "__h", "left").drop("__h", "__prefix").withColumn("is_test", F.coalesce("is_test", F.lit(False)))
