"""A pronouncer: train or load, then pronounce single words or whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.arrays import join_tokens, letters_of
from lexiloom.functions.text import transliterate
from lexiloom.operators import evaluate, score, tree
from lexiloom.operators.harness import TreeModel, train_tree
from lexiloom.sources import lexicon, models
from lexiloom.symbols import EPSILON, JOINER, PRESETS, joins_for


class Pronouncer:
    """Exceptions first, then the tree. Call it with a word, or ``pronounce`` a table of words."""

    def __init__(self, model: TreeModel, exceptions: DataFrame | None = None):
        self.model, self.exceptions = model, exceptions
        self._walker: tree.Walker | None = None
        self._listed: dict[str, list[str]] | None = None

    @classmethod
    def train(cls, entries: DataFrame, locale: str = "default", phoneset: str = "ipa", preset: str | dict = "defaults", with_exceptions: bool = True) -> Pronouncer:
        """From entries (word, phones[, variant]); words that the tree gets wrong, or that have variants, become exceptions."""
        config = PRESETS[preset] if isinstance(preset, str) else preset
        made = cls(train_tree(entries, locale, phoneset, config))
        if with_exceptions:
            rows = entries if "variant" in entries.columns else entries.withColumn("variant", F.lit(1))
            made.exceptions = evaluate.exceptions(made.model.predict(rows.select(F.lower("word").alias("word"), "phones", "variant")))
        return made

    @classmethod
    def from_lexicon(cls, spark: SparkSession, path: str, locale: str = "en_US", phoneset: str = "cmu", preset: str = "pocketsphinx") -> Pronouncer:
        """From a lexicon file, read, cleaned and trained on with a preset."""
        lines = lexicon.read_lines(spark, path).withColumn("seq", F.monotonically_increasing_id())
        entries = lexicon.process_lexicon(lexicon.parse_lexicon(lines), remove_stress=bool(PRESETS[preset].get("remove_stress", True)))
        return cls.train(entries, locale, phoneset, preset)

    def pronounce(self, words: DataFrame) -> DataFrame:
        """``words`` (word) with phones and confidences."""
        found = self.model.predict(words)
        if self.exceptions is None:
            return found.withColumn("phones", F.col("predicted")).select(*words.columns, "phones", "confidences")
        return tree.with_exceptions(found, self.exceptions).select(*words.columns, "phones", "confidences")

    def score(self, entries: DataFrame, method: str = "geometric") -> DataFrame:
        """Entries (word, phones) with score, predicted and flag."""
        return score.score_lexicon(self.model.predict(entries), method=method).drop("dists", "letters", "confidences")

    def nbest(self, words: DataFrame, n: int = 5) -> DataFrame:
        """``words`` with ``nbest``: up to n (phones, score), best first."""
        return self.model.predict(words).select(*words.columns, tree.nbest(F.col("dists"), n).alias("nbest"))

    def _local(self) -> tuple[tree.Walker, dict[str, list[str]]]:
        if self._walker is None:
            self._walker = tree.walker(self.model.nodes, self.model.width)
            rows = self.exceptions.limit(tree.MAX_NODES + 1).collect() if self.exceptions is not None else []
            if len(rows) > tree.MAX_NODES:
                raise ValueError("too many exceptions to hold on the driver; use pronounce()")
            self._listed = {r.word: list(r.phones) for r in rows}
        return self._walker, self._listed or {}

    def _cooked(self, word: str) -> list[str]:
        spark, m = self.model.nodes.sparkSession, self.model
        letters = join_tokens(letters_of(transliterate(F.lower("word"), m.locale)), joins_for(m.locale, "letters", m.joins))
        return list(spark.createDataFrame([(word,)], "word string").select(letters.alias("l")).first()["l"])

    def __call__(self, word: str) -> list[str]:
        walker, listed = self._local()
        if word.lower() in listed:
            return list(listed[word.lower()])
        letters = self._cooked(word)
        best = [d[0][0] if c in self.model.known else EPSILON for c, d in zip(letters, walker.distributions(letters), strict=True)]
        return [p for t in best if t != EPSILON for p in t.split(JOINER)]

    def save(self, path: str) -> None:
        tables = {"tree": self.model.nodes} | ({"exceptions": self.exceptions} if self.exceptions is not None else {})
        m = self.model
        models.save(path, tables, {"known": m.known, "locale": m.locale, "phoneset": m.phoneset, "joins": m.joins, "width": m.width, "settings": m.about})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pronouncer:
        tables, a = models.load(spark, path)
        return cls(TreeModel(tables["tree"], a["known"], a["locale"], a["phoneset"], a["joins"], a["width"], a["settings"]), tables.get("exceptions"))
