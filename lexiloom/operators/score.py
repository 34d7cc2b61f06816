"""Scores of pronunciations, and the lexicon checks that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.arrays import once


def combine(scores: Column, method: str = "geometric") -> Column:
    """One score of an array of probabilities; 0 where it is empty or holds a zero."""
    return once(scores, lambda held: _combined(held, method))


def _combined(scores: Column, method: str) -> Column:
    n = F.size(scores)
    total = lambda f: F.aggregate(scores, F.lit(0.0), lambda a, x: a + f(x))
    value = {
        "geometric": F.exp(total(F.log) / n),
        "product": F.aggregate(scores, F.lit(1.0), lambda a, x: a * x),
        "arithmetic": total(lambda x: x) / n,
        "min": F.array_min(scores),
        "harmonic": n / total(lambda x: 1 / x),
    }[method]
    return F.when((n == 0) | F.exists(scores, lambda x: x <= 0), 0.0).otherwise(value)


def phone_scores(dists: Column, phones: Column) -> Column:
    """For each given phone the highest probability that any position gives it."""
    best = lambda every, p: F.aggregate(every, F.lit(0.0), lambda most, d: F.when(d["phone"] == p, F.greatest(most, d["prob"])).otherwise(most))
    return once(F.flatten(dists), lambda every: F.transform(phones, lambda p: best(every, p)))


def zero_scored(scored: DataFrame) -> DataFrame:
    """Words of (word, prons map) with a variant of score 0."""
    return scored.where(F.exists(F.map_values("prons"), lambda x: x == 0))


def low_scored(scored: DataFrame, threshold: float = 0.01, min_len: int = 5) -> DataFrame:
    best = F.array_max(F.map_values("prons"))
    return scored.withColumn("best", best).where((F.col("best") < threshold) & F.col("word").rlike("^[A-Za-z]+$") & (F.length("word") >= min_len))


def score_gaps(scored: DataFrame, high: float = 0.1, low: float = 0.01) -> DataFrame:
    """Words of two or more variants whose best and worst scores lie far apart, with their ratio."""
    best, worst = F.array_max(F.map_values("prons")), F.array_min(F.map_values("prons"))
    rows = scored.withColumns({"best": best, "worst": worst}).where((F.size("prons") > 1) & (F.col("best") > high) & (F.col("worst") < low))
    return rows.withColumn("ratio", F.when(F.col("worst") > 0, F.col("best") / F.col("worst")).otherwise(float("inf")))


FUNCTION_WORDS = "of the to is was were have has had".split()


def classify(word: Column, phones: Column, score: Column) -> Column:
    """Why a low-scored variant is in doubt: spelled-out or title abbreviation, function word, foreign name, or to be reviewed."""
    low = F.lower(word)
    letters, n = F.length(F.regexp_replace(low, "[^a-z]", "")), F.size(phones)
    return (
        F.when(score == 0, "ABBREV")
        .when((letters <= 4) & (n > letters * 1.5), "ABBREV")
        .when(low.rlike(r"^(mr|dr|jr|sr|st)\.?$"), "ABBREV")
        .when(low.isin(*FUNCTION_WORDS), "FUNCTION")
        .when(low.rlike("^xia|^zh[aeiou]|iao$|^qia|^qiu"), "FOREIGN")
        .when(low.rlike("^mc[a-z]|^mac[a-z]"), "FOREIGN")
        .otherwise("REVIEW")
    )


def triage(variants: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(word, phones, score, ...) with best and category; words of under two letters a-z go, and scores from ``threshold`` on are OK."""
    best = variants.groupBy("word").agg(F.max("score").alias("best"))  # pre-aggregated, whatever a word's number of variants
    rows = variants.where(F.length(F.regexp_replace(F.lower("word"), "[^a-z]", "")) >= 2).join(best, "word")
    return rows.withColumn("category", F.when(F.col("score") >= threshold, "OK").otherwise(classify(F.col("word"), F.col("phones"), F.col("score"))))


def triage_order(rows: DataFrame) -> DataFrame:
    """By category: OK best first, others worst first, then by word."""
    return rows.orderBy("category", F.when(F.col("category") == "OK", -F.col("score")).otherwise(F.col("score")), "word")


def score_lexicon(entries: DataFrame, dists: str = "dists", method: str = "geometric") -> DataFrame:
    """Entries (word, phones, dists, predicted) with ``score`` and ``flag``: = where the model says the same, else !."""
    score = combine(phone_scores(F.col(dists), F.col("phones")), method)
    return entries.withColumns({"score": score, "flag": F.when(F.col("phones") == F.col("predicted"), "=").otherwise("!")})


def score_variants(scored: DataFrame) -> DataFrame:
    """(word, prons): all variants of each word with their scores, best first."""
    one = F.struct((-F.col("score")).alias("neg"), F.array_join("phones", " ").alias("pron"))
    told = scored.groupBy("word").agg(F.array_sort(F.collect_list(one)).alias("x"))
    return told.select("word", F.transform("x", lambda v: F.struct(v["pron"].alias("pron"), (-v["neg"]).alias("score"))).alias("prons"))


def select_scored(scored: DataFrame, threshold: float | None = None, top: int | None = None, bottom: int | None = None) -> DataFrame:
    """Rows under a threshold, or the best or worst few; ties by word."""
    if threshold is not None:
        scored = scored.where(F.col("score") < threshold)
    if top is not None:
        return scored.orderBy(F.desc("score"), "word").limit(top)
    rows = scored.orderBy("score", "word")
    return rows if bottom is None else rows.limit(bottom)


def rank_changes(variants: DataFrame) -> DataFrame:
    """(word, variant, score, new_rank) of words whose order by score isn't their order of variants."""
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "variant"))
    ranked = variants.withColumn("new_rank", rank)
    return ranked.withColumn("moved", F.max(F.col("new_rank") != F.col("variant")).over(Window.partitionBy("word"))).where("moved").drop("moved")


def histogram(variants: DataFrame) -> DataFrame:
    """(bucket, n, avg_score, min_score, max_score) over five buckets."""
    s = F.col("score")
    bucket = F.when(s < 0.2, "0.0-0.2").when(s < 0.4, "0.2-0.4").when(s < 0.6, "0.4-0.6").when(s < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return variants.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def confidence_bands(rows: DataFrame) -> DataFrame:
    """(band, n, mean) of rows (confidences): words by their least certain phone."""
    least = F.array_min("confidences")
    band = F.when(least >= 0.8, "high").when(least >= 0.6, "medium").otherwise("low")
    return rows.where(F.size("confidences") > 0).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(combine(F.col("confidences"), "arithmetic")).alias("mean"))


def phone_usage(entries: DataFrame, samples: int = 3) -> DataFrame:
    """(phone, n, words): occurrences and the first few words of each phone; words are cut per phone before they are gathered."""
    used = entries.select("word", F.explode("phones").alias("phone"))
    counts = used.groupBy("phone").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("phone").orderBy("word"))
    first = used.distinct().withColumn("rank", rank).where(F.col("rank") <= samples).groupBy("phone").agg(F.array_sort(F.collect_list("word")).alias("words"))
    return counts.join(first, "phone")


def check_phones(entries: DataFrame, spec: DataFrame) -> DataFrame:
    """(phone, status): missing from the specification, unused by the lexicon, or written in another normal form."""
    from lexiloom.functions.text import nfc

    used = entries.select(F.explode("phones").alias("phone")).distinct().select(nfc("phone").alias("nfc"), F.col("phone").alias("raw_l"))
    given = spec.select("phone").distinct().select(nfc("phone").alias("nfc"), F.col("phone").alias("raw_s"))
    both = used.join(given, "nfc", "full")
    status = F.when(F.col("raw_s").isNull(), "missing").when(F.col("raw_l").isNull(), "unused").when(F.col("raw_l") != F.col("raw_s"), "form")
    return both.select(F.coalesce("raw_l", "raw_s").alias("phone"), status.alias("status")).where("status is not null")
