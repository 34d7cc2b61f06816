"""The stateless parts of the engine over streams: parsing, tokenising and pronouncing, row by row.

Every function here takes a batch or a streaming DataFrame; nothing holds state,
so there are no watermarks or windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.arrays import letters_of
from lexiloom.functions.text import normal_tokens
from lexiloom.operators.tree import distributions, predicted, with_exceptions


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of text files as they appear in a folder."""
    return spark.readStream.text(path)


def pronounce(lines: DataFrame, tree: DataFrame, exceptions: DataFrame | None = None, width: int = 7) -> DataFrame:
    """(word, phones) of every token of ``lines`` (value)."""
    words = lines.select(F.explode(normal_tokens(F.lower("value"))).alias("word"))
    found = distributions(words.withColumn("letters", letters_of(F.col("word"))), tree, width).withColumn("predicted", predicted(F.col("dists")))
    if exceptions is not None:
        return with_exceptions(found.select("word", "predicted"), exceptions).select("word", "phones")
    return found.select("word", F.col("predicted").alias("phones"))


def render(pronounced: DataFrame) -> DataFrame:
    """(value): word<tab>phones."""
    return pronounced.select(F.concat_ws("\t", "word", F.array_join("phones", " ")).alias("value"))
