"""A lexicon derived from the driver's documents, in Spark and as SQL for DuckDB.

Words are runs of a-z, of any length. Rules give each word a first
pronunciation (digraphs, x and qu expansions, silent h and final e), and a
second one where th or a final e allow another. Both engines give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import written

RULES = [("sch", "S"), ("ch", "C"), ("sh", "S"), ("th", "T"), ("ph", "f"), ("ck", "k"), ("qu", "kw"), ("x", "ks"), ("h", "")]
SECOND = [("sch", "S"), ("ch", "C"), ("sh", "S"), ("th", "D"), ("ph", "f"), ("ck", "k"), ("qu", "kw"), ("x", "ks"), ("h", "")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def counted_words(texts: DataFrame) -> DataFrame:
    """(word, lang, n) of (lang, text). Counted by language first: the least of strings is found by sorting, so it is sought among distinct words only."""
    found = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    counted = found.groupBy("word", "lang").agg(F.count("*").alias("n"))
    return counted.groupBy("word").agg(F.min("lang").alias("lang"), F.sum("n").alias("n"))


_WORDS: dict[tuple[str, str], DataFrame] = {}


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, lang, n): each word with its smallest language and number of occurrences; found once for each folder in an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WORDS:
        _WORDS[key] = written(counted_words(documents(spark, sf_dir)), "words")
    return _WORDS[key]


def _spoken(word: Column, rules: list[tuple[str, str]]) -> Column:
    for old, new in rules:
        word = F.replace(word, F.lit(old), F.lit(new))
    return word


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, lang, n, variant, letters, phones)."""
    rows = words(spark, sf_dir)
    first, second = _spoken(F.col("word"), RULES), _spoken(F.col("word"), SECOND)
    silent = (F.length("word") > 2) & F.col("word").rlike("e$")
    one = F.when(silent, F.regexp_replace(first, "e$", "")).otherwise(first)
    two = F.when(silent, F.regexp_replace(second, "e$", "@")).otherwise(second)
    both = rows.select("word", "lang", "n", F.explode(F.array(F.struct(F.lit(1).alias("variant"), one.alias("p")), F.struct(F.lit(2).alias("variant"), two.alias("p")))).alias("x"), one.alias("p1"))
    kept = both.where("x.p <> '' and (x.variant = 1 or x.p <> p1)")
    chars = lambda c: F.filter(F.split(c, ""), lambda y: y != "")
    return kept.select("word", "lang", "n", F.col("x.variant").alias("variant"), chars(F.col("word")).alias("letters"), chars(F.col("x.p")).alias("phones"))


def _sql(word: str, rules: list[tuple[str, str]]) -> str:
    for old, new in rules:
        word = f"replace({word}, '{old}', '{new}')"
    return word


#: Common table expressions: words(word, lang, n) and lex(word, lang, n, variant, letters, phones).
LEX_SQL = f"""found AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
words AS (SELECT word, min(lang) AS lang, count(*) AS n FROM found GROUP BY word),
said AS (SELECT word, lang, n, {_sql('word', RULES)} AS p1, {_sql('word', SECOND)} AS p2, length(word) > 2 AND word LIKE '%e' AS silent FROM words),
spoken AS (SELECT word, lang, n, CASE WHEN silent THEN regexp_replace(p1, 'e$', '') ELSE p1 END AS p1, CASE WHEN silent THEN regexp_replace(p2, 'e$', '@') ELSE p2 END AS p2 FROM said),
lex AS (SELECT word, lang, n, 1 AS variant, string_split(word, '') AS letters, string_split(p1, '') AS phones FROM spoken WHERE p1 <> ''
  UNION ALL SELECT word, lang, n, 2, string_split(word, ''), string_split(p2, '') FROM spoken WHERE p2 <> '' AND p2 <> p1)"""


def scored(lex: DataFrame) -> DataFrame:
    """``lex`` with a score in thousandths, made up from a digest of word and variant."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("/", "word", F.col("variant").cast("string"))), 1, 6), 16, 10).cast("long")
    # squared, so that some are tiny; one in 1000 is zero
    return lex.withColumn("score", (F.pmod(digest, F.lit(1000)) * F.pmod(digest, F.lit(1000))).cast("double") / 1e6)


SCORED_SQL = """scored AS (SELECT *, CAST((d % 1000) * (d % 1000) AS DOUBLE) / 1e6 AS score FROM (SELECT *, CAST(('0x' || substr(md5(word || '/' || variant), 1, 6)) AS BIGINT) AS d FROM lex))"""


def naive(word: Column) -> Column:
    """What a spelling-bound model would say: one phone a letter but for x."""
    return F.filter(F.split(F.replace(F.replace(word, F.lit("x"), F.lit("ks")), F.lit("ph"), F.lit("f")), ""), lambda y: y != "")


NAIVE_SQL = "string_split(replace(replace(word, 'x', 'ks'), 'ph', 'f'), '')"
