"""Lexicon, alignment, vector, exception and score files as DataFrames, and back.

Reading goes through ``spark.read.text``; the parsers take any DataFrame with a
``value`` column, so they also run over streams. Where order decides, a ``seq``
column carries it.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions.arrays import letters_of
from lexiloom.functions.text import is_comment, nfc, strip_variant, variant_rank

#: How each kind of lexicon line is read: separator, inline comments, variant suffix, composed letters.
DIALECTS = {
    "main": {"tab_first": True, "inline": "#.*$", "bare": True, "suffix": "strip", "nfc": False},
    "aligner": {"tab_first": True, "inline": r"\s#.*$", "suffix": "strip", "nfc": True},
    "tsv": {"tab_only": True, "inline": None, "suffix": "strip", "nfc": False},
    "tsv_keep": {"tab_only": True, "inline": None, "suffix": "keep", "nfc": False},
    "scored": {"tab_first": False, "inline": None, "suffix": "rank", "nfc": False},
    "no_variants": {"tab_first": False, "inline": None, "suffix": "drop", "nfc": False},
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value); a missing file raises FileNotFoundError."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return spark.read.text(path)


def parse_lexicon(lines: DataFrame, dialect: str = "main") -> DataFrame:
    """``lines`` (value, ...) that are entries, with word, phones and variant; comments, blanks and malformed lines go."""
    rules = DIALECTS[dialect]
    stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    line = stripped(F.col("value"))
    if rules["inline"]:
        line = stripped(F.regexp_replace(line, rules["inline"], ""))
    if rules["nfc"]:
        line = nfc(line)
    tabbed = F.contains(line, F.lit("\t"))
    if rules.get("tab_only"):
        word, rest, ok = F.trim(F.element_at(F.split(line, "\t", 2), 1)), F.get(F.split(line, "\t", 2), 1), tabbed
    else:
        pair = F.split(line, r"\s+", 2)
        if rules.get("tab_first"):
            pair = F.when(tabbed, F.split(line, "\t")).otherwise(pair)
        word, rest, ok = F.trim(F.get(pair, 0)), F.get(pair, 1), F.size(pair) > 1
    phones = F.filter(F.split(F.trim(rest), r"\s+"), lambda p: p != "")
    spoken = (F.size("phones") > 0) | tabbed if rules.get("bare") else F.size("phones") > 0
    rows = lines.where(~is_comment(F.col("value"))).withColumns({"word": word, "phones": phones}).where(ok & (F.col("word") != "") & spoken)
    if rules["suffix"] == "drop":
        rows = rows.where(~F.contains("word", F.lit("(")))
    rank = variant_rank(F.col("word"))
    bare = strip_variant(F.col("word")) if rules["suffix"] in ("strip", "rank") else F.col("word")
    return rows.select(*[c for c in lines.columns if c != "value"], bare.alias("word"), "phones", rank.alias("variant"))


def parse_alignments(lines: DataFrame) -> DataFrame:
    """``letters<tab>phones`` with as many on each side."""
    side = lambda i: F.split(F.get(F.split("value", "\t"), i), " ")
    return lines.where(F.contains("value", F.lit("\t"))).select(side(0).alias("letters"), side(1).alias("state")).where(F.size("letters") == F.size("state"))


def render_alignments(aligned: DataFrame) -> DataFrame:
    return aligned.select(F.concat_ws("\t", F.array_join("letters", " "), F.array_join("state", " ")).alias("value"))


def parse_vectors(lines: DataFrame, width: int = 7, target_first: bool = False) -> DataFrame:
    """(c0, ..., p, n) counted; headers, comments and vectors of another width go."""
    cells = F.split("value", " ")
    rows = lines.where(~F.startswith("value", F.lit("0 1")) & ~F.startswith("value", F.lit("#"))).where(F.size(cells) == width + 1)
    at = lambda i: F.get(cells, i + target_first)
    target = F.get(cells, 0 if target_first else width)
    names = [f"c{i}" for i in range(width)]
    return rows.select(*(at(i).alias(f"c{i}") for i in range(width)), target.alias("p")).groupBy(*names, "p").agg(F.count("*").alias("n"))


def parse_exceptions(lines: DataFrame) -> DataFrame:
    """(word, phones); of several lines for one word the last by ``seq``."""
    cells = F.split("value", "\t")
    rows = lines.where(~is_comment(F.col("value")) & (F.size(cells) == 2)).select("seq", F.lower(F.get(cells, 0)).alias("word"), F.split(F.trim(F.get(cells, 1)), r"\s+").alias("phones"))
    return rows.groupBy("word").agg(F.max_by("phones", "seq").alias("phones"))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, prons map of scores) of JSON lines; scores may be strings."""
    rows = spark.read.schema("word string, freq bigint, prons map<string,string>").json(path)
    return rows.withColumn("prons", F.transform_values("prons", lambda _, v: v.cast("double")))


def read_phoneset(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        phones = json.load(f)
    if not isinstance(phones, list):
        raise ValueError("a phone set is a JSON list")
    return spark.createDataFrame([(p,) for p in phones], "phone string")


def _decimal(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), "0+$", ""), r"\.$", "")


def write_scored(rows: DataFrame, path: str) -> None:
    rows.withColumn("prons", F.transform_values("prons", lambda _, v: _decimal(v))).write.json(path)


def render_lexicon(entries: DataFrame) -> DataFrame:
    """(value): processed entries (word, variant, phones) as lines, variants numbered from 2."""
    suffix = F.when(F.col("variant") > 1, F.concat(F.lit("("), F.col("variant").cast("string"), F.lit(")"))).otherwise("")
    return entries.select("word", "variant", F.concat("word", suffix, F.lit(" "), F.array_join("phones", " ")).alias("value")).orderBy("word", "variant").select("value")


def process_lexicon(entries: DataFrame, remove_stress: bool = True, lowercase: bool = True, deduplicate: bool = True) -> DataFrame:
    """(word, variant, phones): entries (seq, word, phones) cleaned, variants of a word numbered by first appearance."""
    from lexiloom.functions.text import strip_stress

    word = F.lower("word") if lowercase else F.col("word")
    phones = F.transform("phones", strip_stress) if remove_stress else F.col("phones")
    rows = entries.select("seq", word.alias("word"), phones.alias("phones"))
    if deduplicate:
        rows = rows.groupBy("word", "phones").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("seq", "phones"))
    return rows.select("word", rank.alias("variant"), "phones")


def first_of_cooked(entries: DataFrame) -> DataFrame:
    """Of entries with equal letters and phones (after cooking) the first by ``seq``."""
    return entries.groupBy("letters", "phones").agg(F.min("seq").alias("seq"))


def placements(letters: Column, phones: Column) -> Column:
    """The number of ways to place the phones on the letters, as double, for words of any length."""
    n, k = F.size(letters), F.least(F.size(phones), F.size(letters) - F.size(phones))
    steps = F.when(k < 1, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(1), k))
    ways = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when(F.size(phones) > n, 0.0).otherwise(F.round(ways))


def admissible(entries: DataFrame, max_combinations: int | None = None, locale: str = "") -> DataFrame:
    """Entries (letters, phones) that the aligner takes: enough letters, and few enough placements (0 and None: any)."""
    letters = F.concat("letters", F.array(F.lit("#"))) if locale.startswith("fr") else F.col("letters")
    rows = entries.withColumn("letters", letters).where("size(letters) >= size(phones)")
    return rows.where(placements(F.col("letters"), F.col("phones")) <= max_combinations) if max_combinations else rows


#: Bytes that one placement takes where all are listed, and how many are worth a warning.
PLACEMENT_BYTES, MANY_BYTES = 50, 8 << 30


def alignment_space(entries: DataFrame) -> DataFrame:
    """(entries, placements, bytes, too_many): what listing every placement would take."""
    total = F.coalesce(F.sum(placements(F.col("letters"), F.col("phones"))), F.lit(0.0))
    return entries.agg(F.count("*").alias("entries"), total.alias("placements")).select("entries", "placements", (F.col("placements") * PLACEMENT_BYTES).alias("bytes"), (F.col("placements") * PLACEMENT_BYTES > MANY_BYTES).alias("too_many"))


def cooked(entries: DataFrame) -> DataFrame:
    """Entries (letters, phones) of which neither side is empty."""
    return entries.where("size(letters) > 0 and size(phones) > 0")


def sample_entries(entries: DataFrame, n: int, keys: list[str], seed: str = "42") -> DataFrame:
    """``n`` entries without replacement, least by the SHA-256 of the seed and their keys."""
    return entries.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256), *keys).limit(n)


def parse_aligner_log(lines: DataFrame) -> DataFrame:
    """(word, combinations) of the lines ``toomany: word n`` that an aligner logged."""
    found = lambda i: F.regexp_extract("value", r"toomany\W+(\S+)\s+(\d+)", i)
    return lines.where(F.contains("value", F.lit("toomany"))).select(found(1).alias("word"), found(2).try_cast("double").alias("combinations")).where("word <> ''")


def render_vectors(vectors: DataFrame, header: bool = True) -> DataFrame:
    """(value): counted vectors (c0, ..., p, n) as lines, each as often as it was counted, after a header."""
    names = [c for c in vectors.columns if c[0] == "c" and c[1:].isdigit()]
    lines = vectors.select(F.explode(F.array_repeat(F.concat_ws(" ", *names, "p"), F.col("n").cast("int"))).alias("value"))
    if not header:
        return lines
    return vectors.sparkSession.createDataFrame([(" ".join([*map(str, range(len(names))), "P"]),)], "value string").unionByName(lines)


def write_triage(rows: DataFrame, path: str) -> None:
    """Triaged variants as tab-separated files, a folder for each category."""
    flat = rows.select("category", "score", "word", F.array_join("phones", " ").alias("phones"))
    flat.repartition("category").sortWithinPartitions("score", "word").write.partitionBy("category").csv(path, sep="\t")


def write_scored_lexicon(rows: DataFrame, path: str) -> None:
    """Scored entries (score, word, phones, predicted, flag), best first, tab-separated."""
    flat = rows.select(F.format_string("%.6f", "score").alias("score"), "word", F.array_join("phones", " ").alias("phones"), F.array_join("predicted", " ").alias("predicted"), "flag")
    flat.orderBy(F.desc("score"), "word").write.csv(path, sep="\t")


def write_joins(reports: dict[str, DataFrame], about: dict, path: str) -> None:
    """Join reports by side and the settings they were made with, as one JSON file; a report has at most its top rows."""
    told = about | {name: [r.asDict(recursive=True) for r in report.collect()] for name, report in reports.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(told, f, ensure_ascii=False, indent=1)


def write_manifest(path: str, **about: object) -> dict:
    """What a lexicon file is (name, version, hash, number of entries) as JSON beside it."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(about, f, ensure_ascii=False, indent=1, sort_keys=True)
    return about


def lexicon_hash(lines: DataFrame) -> DataFrame:
    """(dict_hash): 8 hex digits of the SHA-256 of all stripped lines in order of ``seq``; a lexicon is one file, and hashed as one."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.trim("value").alias("line"))))
    return lines.agg(F.substring(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), ""), 256), 1, 8).alias("dict_hash"))


def with_letters(entries: DataFrame) -> DataFrame:
    return entries.withColumn("letters", letters_of(F.lower("word")))
