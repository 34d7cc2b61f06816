"""One query per operator over the driver's tables, with SQL for DuckDB where SQL can say it.

All run over whole tables. Keys name the operators of the survey.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import arrays as A
from lexiloom.functions import text as T
from lexiloom.operators import align as AL
from lexiloom.operators import evaluate as E
from lexiloom.operators import multigram as M
from lexiloom.operators import score as S
from lexiloom.operators import tree as TR
from lexiloom.operators import windows as W
from lexiloom.plans.derived import LEX_SQL, NAIVE_SQL, SCORED_SQL, documents, lexicon, naive, scored, words
from lexiloom.sources import lexicon as L
from lexiloom.symbols import joins_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def with_lex(select: str, *more: str) -> str:
    return f"WITH {', '.join([LEX_SQL, *more])} {select}"


def flat(c: str):
    return F.array_join(c, " ").alias(c)


# == lexicon files


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): the lexicon as lines, with tabs, suffixes, comments, blanks and malformed lines among them."""
    lex = lexicon(spark, sf_dir)
    phones = F.array_join("phones", " ")
    suffix = F.when(F.col("variant") > 1, F.lit("(2)")).otherwise("")
    line = F.when(F.length("word") % 3 == 0, F.concat("word", suffix, F.lit("\t"), phones)).when(F.length("word") % 3 == 1, F.concat("word", suffix, F.lit("  "), phones, F.lit(" # note"))).otherwise(F.concat("word", suffix, F.lit(" "), phones))
    extra = F.when(F.length("word") == 5, F.array(F.lit(";;; comment"), F.lit(""), F.col("word"), F.lit("# x y"))).otherwise(F.array().cast("array<string>"))
    return lex.select(F.col("variant").alias("seq"), F.explode(F.concat(F.array(line), extra)).alias("value"))


@query(with_lex("SELECT word, variant, array_to_string(phones, ' ') AS phones FROM lex"))
def parse_lines(spark, sf_dir):
    return L.parse_lexicon(rendered_lines(spark, sf_dir)).select("word", "variant", flat("phones"))


@query(with_lex("SELECT word, variant, array_to_string(phones, ' ') AS phones FROM lex WHERE length(word) % 3 = 0"))
def parse_tsv(spark, sf_dir):
    return L.parse_lexicon(rendered_lines(spark, sf_dir), "tsv").select("word", "variant", flat("phones"))


_PROCESS = "raw AS (SELECT variant AS seq, word, array_to_string(list_transform(phones, lambda p: regexp_replace(CASE WHEN p IN ('a', 'e', 'i', 'o', 'u') THEN p || variant ELSE p END, '[012]$', '')), ' ') AS phones FROM lex UNION ALL SELECT 3, word, array_to_string(phones, ' ') FROM lex)"


@query(with_lex("SELECT word, row_number() OVER (PARTITION BY word ORDER BY seq, phones) AS variant, phones FROM (SELECT word, phones, min(seq) AS seq FROM raw GROUP BY word, phones)", _PROCESS))
def process_lexicon(spark, sf_dir):
    lex = lexicon(spark, sf_dir)
    stressed = F.transform("phones", lambda p: F.when(p.isin("a", "e", "i", "o", "u"), F.concat(p, F.col("variant").cast("string"))).otherwise(p))
    raw = lex.select(F.col("variant").alias("seq"), F.upper("word").alias("word"), stressed.alias("phones")).unionByName(lex.select(F.lit(3).alias("seq"), "word", "phones"))
    return L.process_lexicon(raw).select("word", "variant", flat("phones"))


@query(with_lex("SELECT array_to_string(phones, ' ') AS phones, count(*) AS n, min(word) AS word FROM lex GROUP BY 1"))
def homophones(spark, sf_dir):
    return lexicon(spark, sf_dir).groupBy("phones").agg(F.count("*").alias("n"), F.min("word").alias("word")).select(flat("phones"), "n", "word")


@query(with_lex("SELECT array_to_string(letters, ' ') AS letters, array_to_string(phones, ' ') AS phones, min(variant) AS seq FROM lex GROUP BY 1, 2"))
def dedup_cooked(spark, sf_dir):
    lex = lexicon(spark, sf_dir).select(F.col("variant").alias("seq"), "letters", "phones")
    return L.first_of_cooked(lex.unionByName(lex.withColumn("seq", F.col("seq") + 2))).select(flat("letters"), flat("phones"), "seq")


_WAYS_SQL = "round(exp(lgamma(len(letters) + 1.0) - lgamma(len(phones) + 1.0) - lgamma(len(letters) - len(phones) + 1.0)))"


@query(with_lex(f"SELECT word, variant FROM lex WHERE len(letters) >= len(phones) AND {_WAYS_SQL} <= 100"))
def admission_filter(spark, sf_dir):
    return L.admissible(lexicon(spark, sf_dir), 100).select("word", "variant")


_each = lambda f: f"array_to_string(list_transform(phones, lambda p: {f}), ' ')"


@query(with_lex(f"SELECT word, variant, {_each('p')} AS bare, {_each('p')} AS cmu, {_each('p')} AS xsampa, {_each("p || '1'")} AS none, {_each("p || '3'")} AS other FROM lex"))
def strip_stress(spark, sf_dir):
    one = lambda f: F.array_join(F.transform("phones", f), " ")
    digit, mark = lambda p: F.concat(p, F.lit("1")), lambda p: F.concat(F.lit('"'), p)
    return lexicon(spark, sf_dir).select("word", "variant", one(lambda p: T.strip_stress(digit(p))).alias("bare"), one(lambda p: T.strip_phoneset_stress(digit(p), "cmu")).alias("cmu"), one(lambda p: T.strip_phoneset_stress(mark(p), "xsampa")).alias("xsampa"), one(lambda p: T.strip_phoneset_stress(digit(p), "none")).alias("none"), one(lambda p: T.strip_stress(F.concat(p, F.lit("3")))).alias("other"))


@query(with_lex(f"SELECT word, variant, {_each("CASE WHEN p = 'a' AND variant = 1 THEN 'AA1' WHEN p = 'a' THEN 'AA0' WHEN p = 'e' THEN 'EH0' WHEN p = 'o' THEN 'AO' WHEN p = 'k' THEN 'K' ELSE p END")} AS phones FROM lex"))
def stress_filter(spark, sf_dir):
    """Digits that go become 0 on vowels; bare vowels stay bare, consonants get none."""
    told = {"e": "EH0", "o": "AO", "k": "K2"}
    marked = F.transform("phones", lambda p: F.when(p == "a", F.when(F.col("variant") == 1, "AA1").otherwise("AA2")).otherwise(F.coalesce(*(F.when(p == a, b) for a, b in told.items()), p)))
    return lexicon(spark, sf_dir).select("word", "variant", F.array_join(T.filter_stress(marked, "1", True), " ").alias("phones"))


@query(with_lex("SELECT substr(sha256(string_agg(word || ' ' || array_to_string(phones, ' '), '' ORDER BY word, variant)), 1, 8) AS dict_hash FROM lex"))
def lexicon_hash(spark, sf_dir):
    lex = lexicon(spark, sf_dir)
    return L.lexicon_hash(lex.select(F.struct("word", "variant").alias("seq"), F.concat_ws(" ", "word", flat("phones")).alias("value")))


# == text


_EDGE = r"^[\p{P}\p{S}\p{C}\p{M}\p{Z}]+|[\p{P}\p{S}\p{C}\p{M}\p{Z}]+$"
_NORMAL_SQL = "SELECT token, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '" + _EDGE + "', '', 'g') AS token FROM documents) WHERE token <> '' GROUP BY token"
_NORMAL_SQL = _NORMAL_SQL.replace("_array(text,", "_array(nfc_normalize(text),")


@query(_NORMAL_SQL)
def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(T.normal_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM conversations) WHERE token <> '' GROUP BY token")
def tokenize_raw(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.explode(T.raw_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_TOKENS_SQL = "tokens AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents)"
_LETTERS = r"[^\p{L}\p{Mn}\p{Mc}\-''.]"


def _tokens(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("token")).distinct().where("token <> ''")


@query(f"WITH {_TOKENS_SQL} SELECT token, nfc_normalize(replace(replace(token, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771))) AS composed FROM tokens WHERE token <> ''")
def nfc(spark, sf_dir):
    apart = F.replace(F.replace("token", F.lit("é"), F.lit("e\u0301")), F.lit("ñ"), F.lit("n\u0303"))
    return _tokens(spark, sf_dir).select("token", T.nfc(apart).alias("composed"))


@query(f"WITH {_TOKENS_SQL} SELECT token, strip_accents(token) AS folded FROM tokens WHERE token <> ''")
def remove_accents(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", T.fold_accents("token").alias("folded"))


@query(f"WITH {_TOKENS_SQL} SELECT token, regexp_replace(token, '{_LETTERS}', '', 'g') AS letters FROM tokens WHERE token <> ''")
def filter_letters(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", T.letters_only(F.col("token")).alias("letters"))


_NOT = r"[^\-.''\p{L}]"
_XLIT = {
    "default": f"lower(regexp_replace(strip_accents(token), '{_NOT}', '', 'g'))",
    "en_US": f"lower(regexp_replace(strip_accents(token), '{_NOT}', '', 'g'))",
    "en_IN": "token",
    "es_MX": f"lower(regexp_replace(translate(strip_accents(translate(token, 'ñÑüÜ', '①②③④')), '①②③④', 'ñÑüÜ'), '{_NOT}', '', 'g'))",
    **{k: f"regexp_replace(lower(token), '{_NOT}', '', 'g')" for k in ("fr_FR", "de_DE", "pt_BR")},
    "it_IT": r"regexp_replace(lower(translate(token, 'èÈéÉòÒóÓ', 'ɛɛeeɔɔoo')), '[^\-.\p{L}]', '', 'g')",
}


@query(f"WITH {_TOKENS_SQL} " + " UNION ALL ".join(f"SELECT token, '{k}' AS locale, {x} AS cooked FROM tokens WHERE token <> ''" for k, x in _XLIT.items()))
def cook_letters(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    cooked = rows.select("token", *(T.transliterate(F.col("token"), k).alias(k) for k in T.LOCALES))
    return cooked.unpivot("token", list(T.LOCALES), "locale", "cooked")


_CODE = "'U+' || CASE WHEN unicode(c) < 4096 THEN lpad(upper(to_hex(unicode(c))), 4, '0') ELSE upper(to_hex(unicode(c))) END"


@query(f"WITH {_TOKENS_SQL} SELECT token, array_to_string(list_transform(string_split(token, ''), lambda c: {_CODE}), ' ') AS points FROM tokens WHERE token <> ''")
def codepoints(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token", F.array_join(T.code_points(F.col("token")), " ").alias("points"))


@query(with_lex("SELECT word, regexp_replace(word, '(tsch|sch|ch|ck|pf|ph|qu|eu|au|ai|ei|ie)', '<\\1>', 'g') AS marked FROM words"))
def join_tokens(spark, sf_dir):
    rows = words(spark, sf_dir).select("word", A.letters_of(F.col("word")).alias("letters"))
    joined = A.join_tokens(F.col("letters"), joins_for("de_DE", "letters"))
    names = F.transform(joined, lambda t: F.when(F.contains(t, F.lit("₊")), F.concat(F.lit("<"), F.replace(t, F.lit("₊"), F.lit("")), F.lit(">"))).otherwise(t))
    return rows.select("word", F.array_join(names, "").alias("marked"))


@query(with_lex("SELECT word, array_to_string(letters, ' ') AS letters, len(letters) - len(regexp_extract_all(word, 'sh|ch|th|ph|wh|ng|ck')) AS n_tokens FROM lex WHERE variant = 1"))
def uncook(spark, sf_dir):
    lex = lexicon(spark, sf_dir).where("variant = 1")
    cooked = A.join_tokens(F.col("letters"), joins_for("en_US", "letters"))
    silent = F.flatten(F.transform(cooked, lambda t: F.array(t, F.lit("∅"))))
    return lex.select("word", F.array_join(A.uncook(silent), " ").alias("letters"), F.size(cooked).cast("long").alias("n_tokens"))


@query(with_lex("SELECT word, variant, regexp_replace(array_to_string(phones, ''), '(ju|ks|ts)', '<\\1>', 'g') AS marked FROM lex"))
def cook_phones(spark, sf_dir):
    """Phones, some of them glued and stressed, as an American model takes them."""
    lex = lexicon(spark, sf_dir)
    glued = F.array(F.array_join(F.transform("phones", lambda p: F.concat(p, F.lit("%"))), "₊"))
    cooked = A.join_tokens(A.cook_phones(glued, "default", "xsampa", True), joins_for("en_US", "ipa"))
    names = F.transform(cooked, lambda t: F.when(F.contains(t, F.lit("₊")), F.concat(F.lit("<"), F.replace(t, F.lit("₊"), F.lit("")), F.lit(">"))).otherwise(t))
    return lex.select("word", "variant", F.array_join(names, "").alias("marked"))


_SYMBOLS_SQL = "token"
for _old, _new in T._SPELLED.items():
    _SYMBOLS_SQL = f"replace({_SYMBOLS_SQL}, '{_old}', '{_new}')"


@query(f"WITH {_TOKENS_SQL} SELECT token, replace(replace({_SYMBOLS_SQL}, 'A', 'Ae'), '.', '-') AS plain FROM tokens WHERE token <> ''")
def plain_symbols(spark, sf_dir):
    """Ligatures, dashes and full-width letters, planted in the tokens, as plain letters."""
    odd = F.replace(F.replace("token", F.lit("A"), F.lit("Æ")), F.lit("."), F.lit("—"))
    wide = F.replace(odd, F.lit("t"), F.lit("ｔ"))
    return _tokens(spark, sf_dir).select("token", T.plain_symbols(wide).alias("plain"))


@query(with_lex("SELECT word, variant, array_to_string(letters, '₊') || chr(31) || array_to_string(phones, '₊') AS unit, len(letters) AS n_letters, len(phones) AS n_phones FROM lex"))
def unit_id_codec(spark, sf_dir):
    unit = T.unit_id(F.col("letters"), F.col("phones"))
    return lexicon(spark, sf_dir).select("word", "variant", unit.alias("unit")).select("word", "variant", "unit", F.size(T.unit_letters(F.col("unit"))).alias("n_letters"), F.size(T.unit_phones(F.col("unit"))).alias("n_phones"))


# == windows and counts


_PAD_SQL = "list_concat(['•', '•', '•'], letters, ['•', '•', '•'])"
_WINDOW_SQL = f"spread AS (SELECT word, unnest(range(1, len(letters) + 1)) AS pos, {_PAD_SQL} AS padded, list_concat(phones, list_transform(range(len(letters) - len(phones)), lambda z: '∅')) AS state FROM lex WHERE variant = 1 AND len(letters) >= len(phones)), vectors AS (SELECT word, pos, {', '.join(f'padded[pos + {i}] AS c{i}' for i in range(7))}, state[pos] AS p FROM spread)"


def left_aligned(spark, sf_dir) -> DataFrame:
    """A fixed alignment to count over: phones first, silence last."""
    lex = lexicon(spark, sf_dir).where("variant = 1 and size(letters) >= size(phones)")
    return lex.withColumn("state", F.concat("phones", F.array_repeat(F.lit("∅"), (F.size("letters") - F.size("phones")).cast("int"))))


@query(with_lex("SELECT * FROM vectors", _WINDOW_SQL))
def context_windows(spark, sf_dir):
    return W.aligned_positions(left_aligned(spark, sf_dir), ["word"]).withColumn("pos", F.col("pos").cast("long"))


@query(with_lex("SELECT c0, c1, c2, c3, c4, c5, c6, p, count(*) AS n FROM vectors GROUP BY ALL", _WINDOW_SQL))
def vector_counts(spark, sf_dir):
    return W.vector_counts(left_aligned(spark, sf_dir))


@query(with_lex("SELECT c3 AS letter, p AS phone, count(*) AS n FROM vectors GROUP BY ALL", _WINDOW_SQL))
def letter_phone_counts(spark, sf_dir):
    return W.letter_phone_counts(left_aligned(spark, sf_dir))


_GRAMS_SQL = "padded AS (SELECT list_concat(['<s>'], phones, ['</s>']) AS w FROM lex), grams AS (" + " UNION ALL ".join(f"SELECT {k} AS k, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM padded WHERE len(w) >= {k}" for k in (1, 2, 3)) + ")"


@query(with_lex("SELECT w[i] AS w1, CASE WHEN k > 1 THEN w[i + 1] END AS w2, CASE WHEN k > 2 THEN w[i + 2] END AS w3, k, count(*) AS n FROM grams GROUP BY ALL", _GRAMS_SQL))
def ngram_counts(spark, sf_dir):
    return W.ngram_counts(lexicon(spark, sf_dir), F.col("phones"))


@query(with_lex("SELECT side, a[i] || ' ' || a[i + 1] AS bigram, count(*) AS n FROM (SELECT 'letters' AS side, letters AS a, unnest(range(1, len(letters))) AS i FROM lex UNION ALL SELECT 'phones', phones, unnest(range(1, len(phones))) FROM lex) GROUP BY 1, 2"))
def bigram_counts(spark, sf_dir):
    return W.bigram_counts(lexicon(spark, sf_dir))


@query(with_lex("SELECT word, string_agg(array_to_string(phones, ''), '|' ORDER BY array_to_string(phones, '')) AS gold FROM lex GROUP BY word"))
def gold_variants(spark, sf_dir):
    return E.gold_variants(lexicon(spark, sf_dir)).select("word", F.array_join(F.array_sort(F.transform("gold", lambda g: F.array_join(g, ""))), "|").alias("gold"))


@query(with_lex("SELECT word, variant, h IN (SELECT h FROM (SELECT DISTINCT sha256('42:' || word) AS h FROM lex) ORDER BY h LIMIT (SELECT least(2000, greatest(1, CAST(floor(count(DISTINCT word) * 0.1) AS BIGINT))) FROM lex)) AS is_test FROM (SELECT word, variant, sha256('42:' || word) AS h FROM lex)"))
def split_lexicon(spark, sf_dir):
    return W.split_test(lexicon(spark, sf_dir).select("word", "variant"))


# == lexicon checks


def _spec(spark):
    return spark.createDataFrame([(p,) for p in [*"abcdefgijklmnopqrstuvwyzSTC", "q9", "zh"]], "phone string")


_SPEC_SQL = "spec AS (SELECT unnest(list_concat(string_split('abcdefgijklmnopqrstuvwyzSTC', ''), ['q9', 'zh'])) AS phone), used AS (SELECT DISTINCT unnest(phones) AS phone FROM lex)"


@query(with_lex("SELECT phone, 'missing' AS status FROM used ANTI JOIN spec USING (phone) UNION ALL SELECT phone, 'unused' FROM spec ANTI JOIN used USING (phone)", _SPEC_SQL))
def check_phones(spark, sf_dir):
    return S.check_phones(lexicon(spark, sf_dir), _spec(spark))


@query(with_lex("SELECT phone, count(*) AS n, array_to_string(list_sort(list_distinct(list(word)))[1:3], ' ') AS words FROM (SELECT word, unnest(phones) AS phone FROM lex) GROUP BY phone"))
def phone_usage(spark, sf_dir):
    return S.phone_usage(lexicon(spark, sf_dir)).select("phone", "n", flat("words"))


def _prons(spark, sf_dir):
    return scored(lexicon(spark, sf_dir)).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.array_join("phones", " "), "score"))).alias("prons"))


_BEST_SQL = "best AS (SELECT word, count(*) AS k, max(score) AS best, min(score) AS worst FROM scored GROUP BY word)"


@query(with_lex("SELECT word FROM best WHERE worst = 0", SCORED_SQL, _BEST_SQL))
def find_zeros(spark, sf_dir):
    return S.zero_scored(_prons(spark, sf_dir)).select("word")


@query(with_lex("SELECT word, best FROM best WHERE best < 0.01 AND length(word) >= 5", SCORED_SQL, _BEST_SQL))
def find_low(spark, sf_dir):
    return S.low_scored(_prons(spark, sf_dir)).select("word", "best")


@query(with_lex("SELECT word, CASE WHEN worst > 0 THEN round(best / worst, 6) ELSE 1e300 END AS ratio FROM best WHERE k > 1 AND best > 0.1 AND worst < 0.01", SCORED_SQL, _BEST_SQL))
def find_gaps(spark, sf_dir):
    return S.score_gaps(_prons(spark, sf_dir)).select("word", F.when(F.col("worst") > 0, F.round("ratio", 6)).otherwise(1e300).alias("ratio"))


_TRIAGE_SQL = """CASE WHEN score >= 0.05 THEN 'OK' WHEN score = 0 OR (length(word) <= 4 AND len(phones) > length(word) * 1.5) OR word IN ('mr', 'dr', 'jr', 'sr', 'st') THEN 'ABBREV'
  WHEN word IN ('of', 'the', 'to', 'is', 'was', 'were', 'have', 'has', 'had') THEN 'FUNCTION' WHEN regexp_matches(word, '^(xia|qia|qiu|zh[aeiou]|ma?c[a-z])|iao$') THEN 'FOREIGN' ELSE 'REVIEW' END"""


@query(with_lex(f"SELECT category, count(*) AS n, count(DISTINCT word) AS n_words, round(sum(score), 6) AS total FROM (SELECT word, score, {_TRIAGE_SQL} AS category FROM scored WHERE length(word) > 1) GROUP BY category", SCORED_SQL))
def triage(spark, sf_dir):
    rows = S.triage(scored(lexicon(spark, sf_dir)).select("word", "variant", "phones", "score"))
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_words"), F.round(F.sum("score"), 6).alias("total"))


@query(with_lex("SELECT word, variant, new_rank FROM (SELECT *, bool_or(new_rank <> variant) OVER (PARTITION BY word) AS moved FROM (SELECT word, variant, row_number() OVER (PARTITION BY word ORDER BY score DESC, variant) AS new_rank FROM scored)) WHERE moved", SCORED_SQL))
def rank_changes(spark, sf_dir):
    return S.rank_changes(scored(lexicon(spark, sf_dir)).select("word", "variant", "score")).select("word", "variant", F.col("new_rank").cast("long").alias("new_rank"))


@query(with_lex("SELECT CASE WHEN score < 0.2 THEN '0.0-0.2' WHEN score < 0.4 THEN '0.2-0.4' WHEN score < 0.6 THEN '0.4-0.6' WHEN score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM scored GROUP BY 1", SCORED_SQL))
def score_histogram(spark, sf_dir):
    return S.histogram(scored(lexicon(spark, sf_dir))).withColumn("avg_score", F.round("avg_score", 6))


# == evaluation


def _judged(spark, sf_dir):
    lex = lexicon(spark, sf_dir)
    return lex.where("variant = 1").join(E.gold_variants(lex), "word").withColumn("predicted", naive(F.col("word")))


_PRED_SQL = f"pred AS (SELECT word, lang, variant, phones, array_to_string(phones, '') AS x, {NAIVE_SQL} AS predicted, array_to_string({NAIVE_SQL}, '') AS y FROM lex)"


@query(with_lex("SELECT word, variant, levenshtein(x, y) AS edits FROM pred", _PRED_SQL))
def edit_distance(spark, sf_dir):
    return lexicon(spark, sf_dir).select("word", "variant", A.edit_distance(F.col("phones"), naive(F.col("word"))).cast("long").alias("edits"))


@query(with_lex("SELECT word, variant, levenshtein(translate(x, 'ɛɔ', 'eo'), translate(replace(replace(y, 'e', 'ɛ'), 'o', 'ɔ'), 'ɛɔ', 'eo')) AS edits FROM pred", _PRED_SQL))
def edit_distance_equiv(spark, sf_dir):
    opened = F.transform(naive(F.col("word")), lambda p: F.when(p == "e", "ɛ").when(p == "o", "ɔ").otherwise(p))
    return lexicon(spark, sf_dir).select("word", "variant", A.edit_distance(F.col("phones"), opened, "it_IT").cast("long").alias("edits"))


_SAME = "len(list_filter(range(1, least(len(phones), len(predicted)) + 1), lambda i: phones[i] = predicted[i]))"
_METRICS = f"SELECT {{0}} count(*) AS n_test, round(100.0 * sum(CAST(x <> y AS INT)) / count(*), 4) AS wer, round(100.0 * sum(CAST(NOT list_contains(gold, y) AS INT)) / count(*), 4) AS wer_relaxed, round(100.0 * sum(levenshtein(x, y)) / sum(greatest(len(phones), len(predicted))), 4) AS per, round(100.0 * sum(levenshtein(x, y)) / sum(greatest(len(phones), len(predicted))), 4) AS per_relaxed, round(100.0 * sum({_SAME}) / sum(greatest(len(phones), len(predicted))), 4) AS pos_acc FROM pred JOIN (SELECT word, list(array_to_string(phones, '')) AS gold FROM lex GROUP BY word) USING (word) WHERE variant = 1 {{1}}"


@query(with_lex(_METRICS.format("", ""), _PRED_SQL))
def evaluate(spark, sf_dir):
    return E.metrics(_judged(spark, sf_dir))


@query(with_lex(_METRICS.format("lang,", "GROUP BY lang"), _PRED_SQL))
def evaluate_by_language(spark, sf_dir):
    return E.metrics(_judged(spark, sf_dir), by=["lang"])


@query(with_lex("SELECT gold_phone, pred_phone, count(*) AS n FROM (SELECT phones[i] AS gold_phone, predicted[i] AS pred_phone FROM (SELECT phones, predicted, unnest(range(1, least(len(phones), len(predicted)) + 1)) AS i FROM pred WHERE variant = 1) WHERE phones[i] <> predicted[i] UNION ALL SELECT '__len__', CAST(len(phones) AS VARCHAR) FROM pred WHERE variant = 1 AND len(phones) <> len(predicted)) GROUP BY ALL", _PRED_SQL))
def substitutions(spark, sf_dir):
    return E.substitutions(_judged(spark, sf_dir))


#: Words and phones with what the policies look for.
_OPEN_SQL = "opened AS (SELECT replace(word, 'ee', 'è') AS word, list_transform(phones, lambda p: CASE WHEN variant = 1 AND p = 'e' THEN 'ɛ' WHEN p = 'o' AND variant = 2 THEN 'ʊ' WHEN p = 'a' THEN 'ɔ' ELSE p END) AS phones FROM lex)"
_CHANGES = {
    "collapse_open": "len(list_filter(phones, lambda p: p IN ('ɛ', 'ɔ')))",
    "spelling_gated": "CASE WHEN contains(word, 'è') THEN 0 ELSE len(list_filter(phones, lambda p: p IN ('ɛ', 'ɔ'))) END",
    "surface_final": "CASE WHEN word LIKE '%o' AND phones[-1] IN ('o', 'ʊ') THEN 1 ELSE 0 END",
    "do_du": "CASE WHEN word LIKE '%o' AND phones[-1] IN ('o', 'ʊ') THEN 1 ELSE 0 END",
    "citation_expand": "CASE WHEN word LIKE '%o' AND phones[-1] = 'u' THEN 1 ELSE 0 END",
}


@query(with_lex(" UNION ALL ".join(f"SELECT '{k}' AS policy, count(*) AS entries, CAST(sum(CAST({x} > 0 AS INT)) AS BIGINT) AS changed_entries, CAST(sum({x}) AS BIGINT) AS changed_phones FROM opened" for k, x in _CHANGES.items()), _OPEN_SQL))
def normalize_audit(spark, sf_dir):
    put = lambda p: F.when((F.col("variant") == 1) & (p == "e"), "ɛ").when((F.col("variant") == 2) & (p == "o"), "ʊ").when(p == "a", "ɔ").otherwise(p)
    opened = lexicon(spark, sf_dir).select(F.replace("word", F.lit("ee"), F.lit("è")).alias("word"), F.transform("phones", put).alias("phones"))
    told = [E.audit_policy(opened, k).select(F.lit(k).alias("policy"), "*") for k in _CHANGES]
    return reduce(DataFrame.unionByName, told)


_CLOSE_SQL = f"greatest(-1.0, {_SAME} - 0.5 * abs(len(phones) - len(predicted)))"


@query(with_lex(f"SELECT word, arg_max(array_to_string(phones, ' '), {_CLOSE_SQL} * 10 - variant) AS closest FROM pred GROUP BY word", _PRED_SQL))
def closest_pron(spark, sf_dir):
    return E.closest_variant(lexicon(spark, sf_dir).withColumn("predicted", naive(F.col("word"))))


_EXC_SQL = f"exc AS (SELECT word, arg_max(array_to_string(phones, ' '), {_CLOSE_SQL} * 10 - variant) AS phones FROM pred GROUP BY word HAVING count(*) > 1 OR max(CAST(x = y AS INT)) = 0)"


@query(with_lex("SELECT * FROM exc", _PRED_SQL, _EXC_SQL))
def exceptions(spark, sf_dir):
    return E.exceptions(lexicon(spark, sf_dir).withColumn("predicted", naive(F.col("word")))).select("word", flat("phones"))


@query(with_lex(f"SELECT word, greatest(len(phones), len(predicted)) - {_SAME} AS mismatches FROM pred WHERE variant = 1 AND x <> y ORDER BY mismatches DESC, word LIMIT 50", _PRED_SQL))
def worst_words(spark, sf_dir):
    """The 50 words that the naive model gets wrong most: a report."""
    lex = lexicon(spark, sf_dir).where("variant = 1").withColumn("predicted", naive(F.col("word")))
    return E.worst_words(lex, 50).withColumn("mismatches", F.col("mismatches").cast("long"))


@query(with_lex("SELECT word, coalesce(exc.phones, array_to_string(predicted, ' ')) AS phones FROM pred LEFT JOIN exc USING (word) WHERE variant = 1", _PRED_SQL, _EXC_SQL))
def hybrid_lookup(spark, sf_dir):
    lex = lexicon(spark, sf_dir).withColumn("predicted", naive(F.col("word")))
    return TR.with_exceptions(lex.where("variant = 1").select("word", "predicted"), E.exceptions(lex)).select("word", flat("phones"))


@query(with_lex("SELECT locale, per_one, per_many, CASE WHEN per_one > per_many THEN 'many' WHEN per_one < per_many THEN 'one' ELSE 'tie' END AS winner, round(per_one - per_many, 4) AS delta FROM (SELECT lang AS locale, round(100.0 * sum(levenshtein(x, y)) / sum(greatest(len(phones), len(predicted))), 4) AS per_one, round(100.0 * sum(levenshtein(x, word)) / sum(greatest(len(phones), length(word))), 4) AS per_many FROM pred WHERE variant = 1 GROUP BY lang)", _PRED_SQL))
def compare_summary(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    one = E.metrics(judged, by=["lang"]).select(F.col("lang").alias("locale"), F.lit("one").alias("model"), "per")
    many = E.metrics(judged.withColumn("predicted", F.col("letters")), by=["lang"]).select(F.col("lang").alias("locale"), F.lit("many").alias("model"), "per")
    return E.compare(one.unionByName(many))


# == alignment, units, trees


def alignable(spark, sf_dir) -> DataFrame:
    return L.admissible(lexicon(spark, sf_dir).where("variant = 1")).select("word", "letters", "phones")


_ADM_SQL = "adm AS (SELECT word, letters, phones FROM lex WHERE variant = 1 AND len(letters) >= len(phones))"
_GRID_SQL = "ls AS (SELECT DISTINCT unnest(letters) AS letter FROM adm), ps AS (SELECT DISTINCT unnest(phones) AS phone FROM adm UNION SELECT '∅'), grid AS (SELECT letter, phone, 1.0 + CASE WHEN letter = phone THEN 1 ELSE 0 END AS w FROM ls, ps)"


@query(with_lex("SELECT letter, phone, round(w / sum(w) OVER (PARTITION BY letter), 9) AS prob FROM grid", _ADM_SQL, _GRID_SQL))
def em_init_model(spark, sf_dir):
    return AL.initial_model(alignable(spark, sf_dir)).withColumn("prob", F.round("prob", 9))


@query(with_lex("SELECT letter, phone, round((coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY letter), 9) AS prob FROM (SELECT letter, phone FROM (SELECT DISTINCT c3 AS letter FROM vectors), (SELECT DISTINCT p AS phone FROM vectors)) LEFT JOIN (SELECT c3 AS letter, p AS phone, count(*) AS n FROM vectors GROUP BY ALL) USING (letter, phone)", _WINDOW_SQL))
def em_mstep(spark, sf_dir):
    return AL.estimate_model(left_aligned(spark, sf_dir)).withColumn("prob", F.round("prob", 9))


@query()
def em_align(spark, sf_dir):
    aligned, _ = AL.align(alignable(spark, sf_dir))
    return aligned.select("word", flat("letters"), flat("state"))


@query(with_lex("SELECT DISTINCT array_to_string(letters[i:i + a - 1], '₊') || chr(31) || CASE WHEN b = 0 THEN '∅' ELSE array_to_string(phones[j:j + b - 1], '₊') END AS unit FROM (SELECT letters, phones, i, unnest(range(1, len(phones) + 2)) AS j FROM (SELECT letters, phones, unnest(range(1, len(letters) + 1)) AS i FROM adm)), (VALUES (1), (2)) AS x(a), (VALUES (0), (1), (2)) AS y(b) WHERE i + a - 1 <= len(letters) AND j + b - 1 <= len(phones)", _ADM_SQL))
def unit_init(spark, sf_dir):
    return M.initial_units(alignable(spark, sf_dir)).select("unit")


def _units(spark, sf_dir) -> DataFrame:
    return M.fit_units(alignable(spark, sf_dir))[0]


@query()
def unit_em(spark, sf_dir):
    return _units(spark, sf_dir).select("unit", F.round("prob", 9).alias("prob"))


@query()
def suggest_joins(spark, sf_dir):
    """Join candidates of both sides by their mass: a report of 20 each."""
    q = _units(spark, sf_dir)
    one = lambda side: M.join_report(q, side).select(F.lit(side).alias("side"), "tokens", F.round("total_mass", 6).alias("total_mass"), "modal_match", F.round("modal_confidence", 6).alias("modal_confidence"), F.array_join(F.transform("alternatives", lambda x: x["tokens"]), "|").alias("alternatives"))
    return one("letters").unionByName(one("phones"))


_LM_SQL = """sides AS (SELECT list_concat(['<s>'], phones, ['</s>']) AS w FROM lex), units AS (SELECT DISTINCT unnest(phones) AS unit FROM lex),
seen AS (SELECT prev, count(*) AS d FROM (SELECT unnest(w) AS prev FROM sides) WHERE prev <> '</s>' GROUP BY prev),
pairs AS (SELECT w[i] AS prev, w[i + 1] AS unit, count(*) AS c FROM (SELECT w, unnest(range(1, len(w))) AS i FROM sides) GROUP BY ALL)"""


@query(with_lex("SELECT prev, unit, round(ln((coalesce(c, 0) + 0.01) / (d + 0.01 * (SELECT count(*) FROM units))), 9) AS log_prob FROM (SELECT * FROM seen, units) LEFT JOIN pairs USING (prev, unit)", _LM_SQL))
def lm_log_probs(spark, sf_dir):
    """Log probability of every phone after every other, pairs that were never seen among them."""
    counts = [tuple(r) for r in W.ngram_counts(lexicon(spark, sf_dir), F.col("phones"), 2).select("w1", "w2", "w3", "n").collect()]  # pairs of an alphabet
    lm = M.NgramModel(counts, 2)
    phones = sorted({r[0] for r in counts if r[1] is None} - {"<s>", "</s>"})
    return spark.createDataFrame([(a, b, lm.log_prob((a,), b)) for a in ["<s>", *phones] for b in phones], "prev string, unit string, log_prob double").withColumn("log_prob", F.round("log_prob", 9))


@query(with_lex(f"SELECT count(*) AS entries, sum({_WAYS_SQL}) AS placements, sum({_WAYS_SQL}) * 50 AS bytes, sum({_WAYS_SQL}) * 50 > 8589934592 AS too_many FROM adm WHERE len(letters) <= 20", _ADM_SQL))
def alignment_space(spark, sf_dir):
    """What listing all placements would take, of words up to 20 letters (beyond, doubles of the two engines differ)."""
    return L.alignment_space(alignable(spark, sf_dir).where("size(letters) <= 20"))


@query(with_lex("SELECT word, variant FROM lex ORDER BY sha256('42:' || word || ':' || variant) LIMIT 500"))
def sample_lexicon(spark, sf_dir):
    """500 entries drawn without replacement: a sampling operator."""
    return L.sample_entries(lexicon(spark, sf_dir).select("word", "variant"), 500, ["word", "variant"])


@query(with_lex("SELECT word, CAST(n AS DOUBLE) AS combinations FROM words WHERE length(word) > 8"))
def aligner_log(spark, sf_dir):
    noisy = words(spark, sf_dir).select(F.when(F.length("word") > 8, F.concat(F.lit("12:00 WARN toomany: "), "word", F.lit(" "), F.col("n").cast("string"))).otherwise(F.concat(F.lit("INFO "), "word")).alias("value"))
    return L.parse_aligner_log(noisy)


@query(with_lex("SELECT value, count(*) AS n FROM (SELECT concat_ws(' ', c0, c1, c2, c3, c4, c5, c6, p) AS value FROM vectors UNION ALL SELECT '0 1 2 3 4 5 6 P') GROUP BY value", _WINDOW_SQL))
def vector_lines(spark, sf_dir):
    return L.render_vectors(W.vector_counts(left_aligned(spark, sf_dir))).groupBy("value").agg(F.count("*").alias("n"))


@query()
def multigram_pronounce(spark, sf_dir):
    """Units, Viterbi paths, n-gram model and decoding of the test words, end to end."""
    rows = W.split_test(alignable(spark, sf_dir))
    train = rows.where("not is_test").select("word", "letters", "phones")
    q = _units_of(train)
    paths = M.viterbi(train, q).where("units is not null")
    grams = W.ngram_counts(paths, F.col("units"), 2)
    found = M.decode_words(rows.where("is_test").select("word", "letters", "phones"), q, grams, order=2)
    return found.select("word", flat("phones"), flat("predicted"))


def _units_of(train: DataFrame) -> DataFrame:
    return M.fit_units(train)[0]


@query(with_lex("SELECT feature, value, n, round(h0 - h1 - h2, 6) AS gain FROM (SELECT feature, value, CAST(sum(k) AS BIGINT) AS n, max(h0) AS h0, sum(-k * log2(k / kk)) AS h1 FROM (SELECT *, sum(k) OVER (PARTITION BY feature, value) AS kk FROM tests) GROUP BY feature, value) JOIN (SELECT feature, value, sum(CASE WHEN c > k THEN -(c - k) * log2((c - k) / (total - kk)) ELSE 0 END) AS h2 FROM (SELECT t.feature, t.value, t.kk, t.total, cls.c, coalesce(x.k, 0) AS k FROM (SELECT feature, value, sum(k) AS kk, max(total) AS total FROM tests GROUP BY feature, value) t, cls LEFT JOIN tests x ON x.feature = t.feature AND x.value = t.value AND x.p = cls.p) GROUP BY feature, value) USING (feature, value)", _WINDOW_SQL, "cls AS (SELECT p, CAST(count(*) AS DOUBLE) AS c FROM vectors GROUP BY p), root AS (SELECT sum(c) AS total, sum(-c * log2(c / t)) AS h0 FROM (SELECT c, sum(c) OVER () AS t FROM cls)), tests AS (SELECT feature, value, p, CAST(count(*) AS DOUBLE) AS k, max(total) AS total, max(h0) AS h0 FROM (" + " UNION ALL ".join(f"SELECT {i} AS feature, c{i} AS value, p FROM vectors" for i in range(7)) + "), root GROUP BY feature, value, p)"))
def tree_level_gains(spark, sf_dir):
    rows = W.vector_counts(left_aligned(spark, sf_dir)).withColumn("node", F.lit(1).cast("long"))
    return TR.split_gains(rows, [f"c{i}" for i in range(7)]).select("feature", "value", "n", F.round("gain", 6).alias("gain"))


def _tree(spark, sf_dir, depth=6):
    return TR.train(W.vector_counts(left_aligned(spark, sf_dir)), max_depth=depth, min_samples_leaf=5)


@query()
def tree_train(spark, sf_dir):
    return _tree(spark, sf_dir).select("node", "feature", "value", F.get("dist", 0)["phone"].alias("phone"))


@query()
def tree_pronounce(spark, sf_dir):
    """Best, confidence and n-best pronunciations of every word under a tree."""
    found = TR.distributions(words(spark, sf_dir).select("word", A.letters_of(F.col("word")).alias("letters")), _tree(spark, sf_dir, 4), top=3)
    return found.select("word", F.array_join(TR.predicted(F.col("dists")), " ").alias("phones"), F.round(S.combine(TR.confidences(F.col("dists"))), 6).alias("confidence"), F.to_json(F.transform(TR.nbest(F.col("dists"), 3), lambda b: F.struct(F.array_join(b["phones"], " ").alias("phones"), F.round(b["score"], 6).alias("score")))).alias("nbest"))


@query(with_lex("SELECT word, variant, round(exp(list_sum(list_transform(phones, lambda p: ln((ascii(p) % 10 + 1) / 11.0))) / len(phones)), 6) AS geometric, round(list_sum(list_transform(phones, lambda p: (ascii(p) % 10 + 1) / 11.0)) / len(phones), 6) AS arithmetic, round(len(phones) / list_sum(list_transform(phones, lambda p: 11.0 / (ascii(p) % 10 + 1))), 6) AS harmonic, round(list_min(list_transform(phones, lambda p: (ascii(p) % 10 + 1) / 11.0)), 6) AS least FROM lex"))
def score_combination(spark, sf_dir):
    lex = lexicon(spark, sf_dir).withColumn("s", F.transform("phones", lambda p: (F.ascii(p) % 10 + 1) / 11.0))
    return lex.select("word", "variant", *(F.round(S.combine(F.col("s"), m), 6).alias(n) for m, n in (("geometric", "geometric"), ("arithmetic", "arithmetic"), ("harmonic", "harmonic"), ("min", "least"))))


def letter_dists(spark, sf_dir) -> DataFrame:
    """Entries with ``dists`` by the phones that each letter is aligned with, and ``predicted``."""
    counts = W.letter_phone_counts(left_aligned(spark, sf_dir))
    told: dict[str, list[tuple[int, str]]] = {}
    for r in counts.collect():  # letters by phones of an alphabet
        told.setdefault(r.letter, []).append((-r.n, r.phone))
    of = {c: (sum(-n for n, _ in x), sorted(x)) for c, x in told.items()}
    one = lambda c: F.array(*(F.struct(F.lit(p).alias("phone"), F.lit(-n / of[c][0]).alias("prob")) for n, p in of[c][1]))
    table = lambda c: F.coalesce(*(F.when(c == k, one(k)) for k in sorted(of)))
    held = lexicon(spark, sf_dir).where(~F.exists("letters", lambda c: ~c.isin(sorted(of))))
    rows = held.withColumn("dists", F.transform("letters", table))
    return rows.withColumn("predicted", TR.predicted(F.col("dists")))


_SCORE_SQL = """lp AS (SELECT letter, phone, n / sum(n) OVER (PARTITION BY letter) AS prob, row_number() OVER (PARTITION BY letter ORDER BY n DESC, phone) AS rank FROM (SELECT c3 AS letter, p AS phone, count(*) AS n FROM vectors GROUP BY ALL)),
one AS (SELECT word, variant, j, coalesce(max(prob), 0) AS prob FROM (SELECT word, variant, letters, phones[j] AS phone, j FROM (SELECT *, unnest(range(1, len(phones) + 1)) AS j FROM lex)) s LEFT JOIN lp ON lp.phone = s.phone AND list_contains(s.letters, lp.letter) GROUP BY word, variant, j),
said AS (SELECT word, variant, string_agg(phone, ' ' ORDER BY i) FILTER (phone <> '∅') AS predicted FROM (SELECT word, variant, letters[i] AS letter, i FROM (SELECT *, unnest(range(1, len(letters) + 1)) AS i FROM lex)) JOIN lp USING (letter) WHERE rank = 1 GROUP BY word, variant),
judged AS (SELECT word, variant, array_to_string(phones, ' ') AS phones, coalesce(predicted, '') AS predicted, score FROM lex JOIN (SELECT word, variant, CASE WHEN min(prob) = 0 THEN 0 ELSE exp(avg(ln(greatest(prob, 1e-300)))) END AS score FROM one GROUP BY word, variant) USING (word, variant) JOIN said USING (word, variant))"""
_SCORE_SQL = _SCORE_SQL.replace("said AS", "spelt AS").replace("JOIN said USING", "JOIN spelt USING")


@query(with_lex("SELECT word, variant, phones, predicted, round(score, 6) AS score, CASE WHEN phones = predicted THEN '=' ELSE '!' END AS flag FROM judged", _WINDOW_SQL, _SCORE_SQL))
def score_lexicon(spark, sf_dir):
    """Every entry's score and prediction under a model of one letter at a time."""
    return S.score_lexicon(letter_dists(spark, sf_dir)).select("word", "variant", flat("phones"), flat("predicted"), F.round("score", 6).alias("score"), "flag")


@query(with_lex("SELECT word, string_agg(phones, '|' ORDER BY score DESC, phones) AS prons, round(max(score), 6) AS best FROM (SELECT word, phones, round(score, 9) AS score FROM judged) GROUP BY word", _WINDOW_SQL, _SCORE_SQL))
def score_variants(spark, sf_dir):
    rows = S.score_lexicon(letter_dists(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return S.score_variants(rows).select("word", F.array_join(F.transform("prons", lambda v: v["pron"]), "|").alias("prons"), F.round(F.get("prons", 0)["score"], 6).alias("best"))


@query(with_lex("SELECT word, phones, round(score, 6) AS score FROM (SELECT word, phones, round(score, 9) AS score FROM judged) ORDER BY score, word, phones LIMIT 100", _WINDOW_SQL, _SCORE_SQL))
def lowest_scored(spark, sf_dir):
    """The 100 worst entries: a report."""
    rows = S.score_lexicon(letter_dists(spark, sf_dir)).select("word", F.array_join("phones", " ").alias("phones"), F.round("score", 9).alias("score"))
    return rows.orderBy("score", "word", "phones").limit(100).withColumn("score", F.round("score", 6))


@query()
def compare_locale(spark, sf_dir):
    """Held-out error rates of the tree per language."""
    lex = lexicon(spark, sf_dir)
    rows = W.split_test(left_aligned(spark, sf_dir).drop("variant"))
    tree = TR.train(W.vector_counts(rows.where("not is_test")), max_depth=4, min_samples_leaf=5)
    found = TR.distributions(rows.where("is_test"), tree, top=1).withColumn("predicted", TR.predicted(F.col("dists")))
    return E.metrics(found.join(E.gold_variants(lex), "word"), by=["lang"])


@query()
def query_order(spark, sf_dir):
    """Words by frequency within each language, ranked: the lexicon in training order."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return words(spark, sf_dir).withColumn("rank", rank)


ORACLE["query_order"] = with_lex("SELECT word, lang, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM words")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority phone per centre letter over the aligned lexicon, held against it."""
    vectors = W.vector_counts(left_aligned(spark, sf_dir))
    counts = vectors.groupBy("c3", "p").agg(F.sum("n").alias("n"))
    return counts.groupBy("c3").agg(F.max_by("p", F.struct("n", "p")).alias("phone"), F.max("n").alias("n"), F.sum("n").alias("total"))
