"""Held-out evaluation: error rates, confusions, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.arrays import POLICIES, edit_distance, matches_in_place, phones_match


def gold_variants(entries: DataFrame) -> DataFrame:
    """(word, gold): the set of pronunciations of each word."""
    return entries.groupBy("word").agg(F.array_sort(F.collect_set("phones")).alias("gold"))


def metrics(rows: DataFrame, locale: str | None = None, by: list[str] | None = None) -> DataFrame:
    """WER, relaxed WER, PER, relaxed PER and position accuracy, in percent, of rows (phones, predicted, gold)."""
    expected, got = F.col("phones"), F.col("predicted")
    length = F.greatest(F.size(expected), F.size(got))
    told = rows.select(
        *(by or []),
        (expected != got).cast("int").alias("wrong"),
        (~phones_match(got, expected, F.col("gold"), locale)).cast("int").alias("wrong_relaxed"),
        edit_distance(got, expected).alias("edits"),
        edit_distance(got, expected, locale).alias("edits_relaxed"),
        length.alias("length"),
        matches_in_place(got, expected, locale).alias("matches"),
    )
    percent = lambda a, b: F.round(100.0 * a / b, 4)
    total = F.sum("length")
    return told.groupBy(*(by or [])).agg(
        F.count("*").alias("n_test"),
        percent(F.sum("wrong"), F.count("*")).alias("wer"),
        percent(F.sum("wrong_relaxed"), F.count("*")).alias("wer_relaxed"),
        percent(F.sum("edits"), total).alias("per"),
        percent(F.sum("edits_relaxed"), total).alias("per_relaxed"),
        percent(F.sum("matches"), total).alias("pos_acc"),
    )


def substitutions(rows: DataFrame) -> DataFrame:
    """(gold_phone, pred_phone, n): unequal phones place by place, and rows ``__len__`` for unequal lengths."""
    n = F.least(F.size("phones"), F.size("predicted"))
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("phones", i).alias("gold_phone"), F.get("predicted", i).alias("pred_phone"))))
    length = F.when(F.size("phones") != F.size("predicted"), F.array(F.struct(F.lit("__len__").alias("gold_phone"), F.size("phones").cast("string").alias("pred_phone"))))
    none = F.expr("cast(array() as array<struct<gold_phone:string,pred_phone:string>>)")
    return rows.select(F.explode(F.concat(F.coalesce(pairs, none), F.coalesce(length, none))).alias("x")).where("x.gold_phone <> x.pred_phone").groupBy("x.gold_phone", "x.pred_phone").agg(F.count("*").alias("n"))


def audit_policy(entries: DataFrame, policy: str) -> DataFrame:
    """(entries, changed_entries, changed_phones): what a train-normalise policy would alter."""
    after = POLICIES[policy](F.col("word"), F.col("phones"))
    differ = F.greatest(F.size("phones"), F.size("after")) - matches_in_place(F.col("phones"), F.col("after"))
    rows = entries.select("phones", after.alias("after"))
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum((F.col("phones") != F.col("after")).cast("int")), F.lit(0)).alias("changed_entries"), F.coalesce(F.sum(differ), F.lit(0)).alias("changed_phones"))


LENGTH_PENALTY = 0.5


def closeness(predicted: Column, phones: Column) -> Column:
    """Places in which two pronunciations agree, less half the difference of their lengths; -1 at least."""
    off = F.abs(F.size(predicted) - F.size(phones))
    return F.greatest(F.lit(-1.0), matches_in_place(predicted, phones) - LENGTH_PENALTY * off)


def closest_variant(variants: DataFrame) -> DataFrame:
    """(word, closest): of a word's variants that closest to ``predicted``, the first of equal ones."""
    key = F.struct(F.col("close"), (-F.col("variant")).alias("first"))
    return variants.withColumn("close", closeness(F.col("predicted"), F.col("phones"))).groupBy("word").agg(F.max_by(F.array_join("phones", " "), key).alias("closest"))


def exceptions(variants: DataFrame) -> DataFrame:
    """(word, phones): words that the model gets wrong or that have several variants, with the variant closest to it."""
    told = variants.groupBy("word").agg(F.count("*").alias("n"), F.max((F.col("phones") == F.col("predicted")).cast("int")).alias("hit"))
    return told.where("n > 1 or hit = 0").join(closest_variant(variants), "word").select("word", F.split("closest", " ").alias("phones"))


def compare(results: DataFrame) -> DataFrame:
    """(locale, per_one, per_many, winner, delta): rows (locale, model, per) of two models side by side."""
    wide = results.groupBy("locale").pivot("model", ["one", "many"]).agg(F.first("per"))
    delta = F.round(F.col("one") - F.col("many"), 4)
    return wide.select("locale", F.col("one").alias("per_one"), F.col("many").alias("per_many"), F.when(delta > 0, "many").when(delta < 0, "one").otherwise("tie").alias("winner"), delta.alias("delta"))


def worst_words(rows: DataFrame, n: int = 20) -> DataFrame:
    """(word, mismatches) of the ``n`` wrong words with most mismatches, then by word."""
    off = F.greatest(F.size("phones"), F.size("predicted")) - matches_in_place(F.col("predicted"), F.col("phones"))
    return rows.where(F.col("phones") != F.col("predicted")).select("word", off.alias("mismatches")).orderBy(F.desc("mismatches"), "word").limit(n)


def most_common(counts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` rows with the largest ``n``; ties by the other columns."""
    return counts.orderBy(F.desc("n"), *(c for c in counts.columns if c != "n")).limit(n)
