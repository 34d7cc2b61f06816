"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Word counts are summed over cells of source, language and topic. Raking scales
the cells in turn until each margin has its target share of the tokens; a
cell's weight is its raked share over its own share, and a document's chance is
its cell's weight over the largest one, so that chances meet the margins. A document
is sampled if a number from 0 to 1, drawn from the SHA-256 of the seed and its
id, is below its chance.

A target is a power, for shares in proportion to tokens to that power (1 keeps
the shares, 0 makes them equal), or a mapping of values to shares; values that
a mapping leaves out split the rest in proportion to their tokens.

Defined cases: null text has no tokens; null source, language or topic is a
value of its own; a cell without tokens has weight 0 and chance 1 (it costs
nothing); a null id draws by its text; rows with one id draw one number; an
empty table gives an empty table; other columns are ignored (``sample`` passes
them through). Margins that cannot be met together end at the last round, with a
warning that says how far off they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.shared import WORD_PATTERN, checkpointed, written

MARGINS = ("source", "lang", "topic")
TARGETS: dict[str, float | Mapping[str, float]] = {"source": 0.5, "lang": 0.8, "topic": 0.9}
SEED = "mix"
#: Rounds that are always run, and those of each further step while a margin is off by more than TOLERANCE.
ROUNDS, STEP, MAX_ROUNDS, TOLERANCE = 20, 5, 40, 1e-6
#: Cells that one task handles (about 0.1 kB each); beyond, the rounds are shuffled.
MAX_CELLS_IN_TASK = 100_000
#: topic -> what a text of that topic holds; the first that fits counts, else ``OTHER``.
TOPICS = {"legal": ("License", "licensed under"), "contact": ("@",), "table": (" | ",), "technical": (" = ", "{", "://")}
OTHER = "prose"


def topic_of(text: Column) -> Column:
    """The topic of a text, by the strings of ``TOPICS``."""
    found: Column = F.lit(OTHER)
    for topic, marks in reversed(TOPICS.items()):
        held: Column = F.lit(False)
        for mark in marks:
            held = held | F.contains(text, F.lit(mark))
        found = F.when(held, topic).otherwise(found)
    return found


def _key(c: str | Column) -> Column:
    """A value of a margin as a string that is never null: equality joins then keep nulls."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("="), c.cast("string")))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.sha2(text, 256))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(SEED + ":"), name), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return [_key(source_col).alias("__source"), _key(lang_col).alias("__lang"), _key(topic_of(text) if topic is None else topic).alias("__topic"), draw.alias("__draw")]


def _target_shares(cells: DataFrame, margin: str, target: float | Mapping[str, float]) -> DataFrame:
    """(margin, want): the share of all tokens for each value that has tokens."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    if isinstance(target, Mapping):
        named = F.coalesce(*(F.when(F.col(margin) == "=" + str(v), F.lit(float(w))) for v, w in target.items()), F.lit(None).cast("double"))
        left = max(0.0, 1.0 - sum(target.values()))
        rest = sums.withColumn("named", named)
        total = rest.agg(F.sum(F.when(F.col("named").isNull(), F.col("t"))).alias("unnamed"))
        sums = rest.join(F.broadcast(total)).withColumn("raw", F.coalesce("named", left * F.col("t") / F.col("unnamed")))  # one row
    else:
        sums = sums.withColumn("raw", F.pow(F.col("t").cast("double"), float(target)))
    total = sums.agg(F.sum("raw").alias("all"))
    return sums.join(F.broadcast(total)).select(margin, (F.col("raw") / F.col("all")).alias("want"))  # one row


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight`` (raked over own share) and ``chance``."""
    cells = checkpointed(cells)
    small = cells.count() <= MAX_CELLS_IN_TASK
    if small:
        cells = cells.coalesce(1)  # groupings, joins and windows of one partition need no shuffle
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.where("tokens > 0").withColumn("share", F.col("tokens") / float(total))
    for m in MARGINS:
        now = now.join(_target_shares(cells, m, targets[m]).withColumnRenamed("want", f"want_{m}"), m)
    now, done = checkpointed(now), 0
    while done < ROUNDS or (done < MAX_ROUNDS and _off(now, small) > TOLERANCE):
        for _ in range(STEP):
            for m in MARGINS:
                now = _fitted(now, m, small)
        now, done = checkpointed(now), done + STEP
    if done >= MAX_ROUNDS and (off := _off(now, small)) > TOLERANCE:
        warnings.warn(f"after {done} rounds a margin is off its target share by {off:.3g}", stacklevel=2)
    weight = F.col("share") * float(total) / F.col("tokens")
    weighed = now.select(*MARGINS, F.round(weight, 6).alias("weight"))
    largest = weighed.agg(F.max("weight")).first()[0] or 1.0
    full = cells.join(weighed, list(MARGINS), "left")
    return full.select(*MARGINS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(F.round(F.col("weight") / largest, 6), F.lit(1.0)).alias("chance"))


def _fitted(now: DataFrame, margin: str, small: bool) -> DataFrame:
    """``now`` scaled to the target shares of one margin."""
    if small:
        have = F.sum("share").over(Window.partitionBy(margin))
        return now.withColumn("share", F.col("share") * F.col(f"want_{margin}") / have)
    # pre-aggregated, so that a margin's most frequent value doesn't meet in one task; the plan would double with each join
    sums = checkpointed(now.groupBy(margin).agg(F.sum("share").alias("have")))
    return checkpointed(now.join(sums, margin).withColumn("share", F.col("share") * F.col(f"want_{margin}") / F.col("have")).drop("have"))


def _off(now: DataFrame, small: bool) -> float:
    """How far the margins' shares are from their targets, at most."""
    if small:
        off = F.greatest(*(F.abs(F.sum("share").over(Window.partitionBy(m)) - F.col(f"want_{m}")) for m in MARGINS))
        return now.select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0
    worst = [now.groupBy(m).agg(F.abs(F.sum("share") - F.first(f"want_{m}")).alias("off")) for m in MARGINS]
    return max(w.agg(F.max("off")).first()[0] or 0.0 for w in worst)


def _with_chances(rows: DataFrame, raked: DataFrame) -> DataFrame:
    names = {m: f"__{m}" for m in MARGINS} | {"weight": "__weight", "chance": "__chance"}
    raked = checkpointed(raked.select(*names).withColumnsRenamed(names))
    small = raked.count() <= MAX_CELLS_IN_TASK  # at most 10 MB, else the join is shuffled
    return rows.join(F.broadcast(raked) if small else raked, [f"__{m}" for m in MARGINS], "left")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*(F.col(f"__{m}").alias(m) for m in MARGINS)).agg(F.sum("__tokens").alias("tokens"))


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, topic, n_tokens, weight, chance, sampled) of every row of ``docs``."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(id_col).alias("__id"), *_rows(docs, id_col, text_col, source_col, lang_col, topic), tokens.alias("__tokens")), "mix")
    told = _with_chances(rows, rake(_cells(rows), targets))
    topic_name = F.when(F.col("__topic") != "null", F.substring("__topic", 2, 1 << 30))
    return told.select(F.col("__id").alias("doc_id"), topic_name.alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__chance").alias("chance"), (F.col("__draw") < F.col("__chance")).alias("sampled"))


def sample(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows of ``docs``, all columns unchanged."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    keys = _rows(docs, id_col, text_col, source_col, lang_col, topic)
    raked = rake(_cells(docs.select(*keys, tokens.alias("__tokens"))), targets)
    return _with_chances(docs.select("*", *keys), raked).where("__draw < __chance").select(*docs.columns)
