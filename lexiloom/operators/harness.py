"""Training, held-out comparison and experiments: chains of the operators, from entries to rates.

Entries are (word, phones). Every chain is: cook, align by EM, count windows,
grow a tree; or for units: fit by EM, Viterbi paths, n-gram counts, decode.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.arrays import POLICIES, cook_phones, join_tokens, letters_of, uncook
from lexiloom.functions.text import transliterate
from lexiloom.operators import align, evaluate, multigram, tree, windows
from lexiloom.sources.lexicon import admissible, cooked
from lexiloom.symbols import LOCALE_SPANS_DEFAULT, PRESETS, SPANS, joins_for


def cook(entries: DataFrame, locale: str = "default", phoneset: str = "ipa", joins: bool = True, remove_stress: bool = False) -> DataFrame:
    """``entries`` (word, phones, ...) with ``letters`` and ``cooked_phones`` as the aligner takes them; those that cook to nothing go."""
    letters = join_tokens(letters_of(transliterate(F.lower("word"), locale)), joins_for(locale, "letters", joins))
    phones = cook_phones(F.col("phones"), locale if joins else "default", phoneset, remove_stress)
    rows = entries.withColumns({"letters": letters, "__cooked": phones})
    return cooked(rows.withColumn("__phones", F.col("phones")).withColumn("phones", F.col("__cooked"))).withColumn("cooked_phones", F.col("phones")).withColumn("phones", F.col("__phones")).drop("__phones", "__cooked")


@dataclass
class TreeModel:
    """A tree, the letters it knows, and what its entries were cooked with."""

    nodes: DataFrame
    known: list[str]
    locale: str = "default"
    phoneset: str = "ipa"
    joins: bool = True
    width: int = 7
    about: dict = field(default_factory=dict)

    def predict(self, words: DataFrame) -> DataFrame:
        """``words`` (word, ...) with letters, dists, predicted and confidences."""
        letters = join_tokens(letters_of(transliterate(F.lower("word"), self.locale)), joins_for(self.locale, "letters", self.joins))
        found = tree.distributions(words.withColumn("letters", letters), self.nodes, self.width)
        return found.withColumns({"predicted": tree.predicted(F.col("dists"), F.col("letters"), self.known), "confidences": tree.confidences(F.col("dists"))})


def train_tree(entries: DataFrame, locale: str = "default", phoneset: str = "ipa", config: dict | None = None, joins: bool = True) -> TreeModel:
    """Entries (word, phones) to a tree: EM alignment, context windows, levels of splits."""
    config = PRESETS["defaults"] | (config or {})
    rows = cook(entries, locale, phoneset, joins, bool(config.get("remove_stress"))).select("word", "letters", F.col("cooked_phones").alias("phones")).distinct()
    rows = admissible(rows, config.get("max_combinations"))
    aligned, _ = align.align(rows, max_iterations=config.get("align_iterations", 100))
    vectors = windows.vector_counts(aligned, config["width"])
    nodes = tree.train(vectors, max_depth=config.get("max_depth", 20), min_samples_split=config["min_samples_split"], min_samples_leaf=config["min_samples_leaf"], criterion=config["criterion"])
    return TreeModel(nodes, tree.vocabulary(vectors, config["width"]), locale, phoneset, joins, config["width"], {k: v for k, v in config.items() if not isinstance(v, DataFrame)})


@dataclass
class UnitModel:
    """Units and n-gram counts of a many-to-many model."""

    units: DataFrame
    grams: DataFrame
    log_likelihoods: list[float]
    skipped: int
    spans: tuple[int, int]
    order: int
    locale: str = "default"
    joins: bool = False

    def predict(self, words: DataFrame, beam: int = 0) -> DataFrame:
        letters = join_tokens(letters_of(transliterate(F.lower("word"), self.locale)), joins_for(self.locale, "letters", self.joins))
        found = multigram.decode_words(words.withColumn("letters", letters), self.units, self.grams, self.spans[0], self.order, beam=beam)
        return found.withColumn("predicted", F.coalesce(uncook(F.col("predicted")), F.expr("cast(array() as array<string>)")))


def train_units(entries: DataFrame, locale: str = "default", phoneset: str = "ipa", spans: tuple[int, int] | None = None, order: int = 3, iterations: int = 15, joins: bool = False, units: DataFrame | None = None) -> UnitModel:
    """Entries (word, phones) to units and n-grams; ``units`` that were fitted before are taken as they are."""
    spans = spans or SPANS.get(locale, LOCALE_SPANS_DEFAULT)
    rows = cook(entries, locale, phoneset, joins).select("word", "letters", F.col("cooked_phones").alias("phones"))
    told: list[float] = []
    if units is None:
        units, told = multigram.fit_units(rows, *spans, iterations=iterations)
    paths = multigram.viterbi(rows, units, *spans)
    grams = windows.ngram_counts(paths.where("units is not null"), F.col("units"), order)
    return UnitModel(units, grams, told, paths.where("units is null").count(), spans, order, locale, joins)


def held_out(entries: DataFrame, policy: str | None = None, **split) -> tuple[DataFrame, DataFrame]:
    """(training entries, test entries with gold): words are split, the training phones pass ``policy``, gold never does."""
    rows = windows.split_test(entries, **split)
    train = rows.where("not is_test").drop("is_test")
    if policy:
        train = train.withColumn("phones", POLICIES[policy](F.col("word"), F.col("phones")))
    return train, rows.where("is_test").drop("is_test").join(evaluate.gold_variants(entries), "word")


def rates(model: TreeModel | UnitModel, test: DataFrame, locale: str | None = None, train_exceptions: DataFrame | None = None) -> DataFrame:
    """Error rates of a model on test entries (word, phones, gold); listed exceptions come first if given."""
    found = model.predict(test)
    if train_exceptions is not None:
        found = tree.with_exceptions(found.withColumnRenamed("phones", "expected"), train_exceptions).withColumnRenamed("phones", "predicted_").drop("predicted").withColumnRenamed("predicted_", "predicted").withColumnRenamed("expected", "phones")
    return evaluate.metrics(found, locale)


def compare_locales(entries: dict[str, DataFrame], config: dict | None = None, order: int = 3, iterations: int = 15, **split) -> DataFrame:
    """(locale, per_one, per_many, winner, delta): a tree and a unit model for the entries of each locale, held out alike."""
    told = None
    for locale, rows in entries.items():
        train, test = held_out(rows, **split)
        for name, model in (("one", train_tree(train, locale, config=config)), ("many", train_units(train, locale, order=order, iterations=iterations))):
            one = rates(model, test, locale).select(F.lit(locale).alias("locale"), F.lit(name).alias("model"), "per")
            told = one if told is None else told.unionByName(one)
    return evaluate.compare(told)


def sweep(entries: DataFrame, spans: Iterable[tuple[int, int]] = ((2, 2), (3, 2)), orders: Iterable[int] = (1, 2, 3), locale: str = "default", iterations: int = 15, **split) -> DataFrame:
    """(span_l, span_p, lm_order, n_test, wer, ...), best first by PER; units are fitted once for each span, as orders don't touch them."""
    train, test = held_out(entries, **split)
    told = None
    for span in spans:
        units = None
        for order in orders:
            model = train_units(train, locale, spans=span, order=order, iterations=iterations, units=units)
            units = model.units
            one = rates(model, test, locale).select(F.lit(span[0]).alias("span_l"), F.lit(span[1]).alias("span_p"), F.lit(order).alias("lm_order"), "*")
            told = one if told is None else told.unionByName(one)
    return told.orderBy("per", "span_l", "span_p", "lm_order")


def policy_experiments(entries: DataFrame, locale: str, policies: Iterable[str], config: dict | None = None, **split) -> DataFrame:
    """(policy, changed_entries, n_test, wer, ...): a tree for each way to normalise the training phones, against untouched gold."""
    told = None
    for policy in policies:
        train, test = held_out(entries, policy, **split)
        changed = evaluate.audit_policy(entries, policy).first()["changed_entries"]
        one = rates(train_tree(train, locale, config=config), test, locale).select(F.lit(policy).alias("policy"), F.lit(changed).alias("changed_entries"), "*")
        told = one if told is None else told.unionByName(one)
    return told


def benchmark(model: TreeModel | UnitModel, words: DataFrame) -> dict[str, float]:
    """Seconds to collect a model for prediction, and words a second over ``words``."""
    began = time.perf_counter()
    found = model.predict(words)
    ready = time.perf_counter()
    n = found.select("predicted").count()
    found.select("predicted").write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - ready
    return {"load_s": ready - began, "words": n, "words_a_s": n / took if took else 0.0}


def markdown(rows: DataFrame, title: str) -> str:
    """A small result table as Markdown."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " - |" * len(names)]
    lines += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows.limit(1000).collect()]
    return "\n".join(lines) + "\n"
