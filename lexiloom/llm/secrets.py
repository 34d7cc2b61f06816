"""Secret scans: fixed patterns, then character Markov models. DataFrame functions only.

Base kinds are regular expressions (leftmost, non-overlapping, each kind by
itself). The method adds spans of kind ``random``: runs of ``MIN_RANDOM`` or more
token characters whose log-likelihood under a first-order character model of
random strings exceeds that under a model of ordinary identifiers by
``MIN_SCORE`` thousandths of a nat, and that no base span overlaps. Both models
are add-``SMOOTHING`` bigram counts of a labelled sample of at most
``MAX_SAMPLES`` rows; the table of 128 x 128 weights is a constant of the plan.

Defined cases: null text has no spans; positions are code points, end exclusive,
in whole texts of any length; repeated rows and null ids are scanned like any
other; an empty table gives an empty table; other columns are ignored
(``redact`` passes them through).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in _ASSIGN_WORDS)
#: kind -> (pattern, group whose length counts, least length), in the order of the kinds.
BASE = {
    "assign": (rf"({_either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What finds the same matches, but for those that are too short; None: the pattern itself.
_LONG_ENOUGH = {"assign": None, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
MIN_RANDOM = 20
RANDOM = rf"[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}"
MIN_SCORE = 3_000
SMOOTHING = 0.5
SYMBOLS = 65
MAX_SAMPLES = 20_000
KINDS = (*BASE, "random")
MASK = "[SECRET]"
#: Matches of one text that are placed in one go.
BLOCK = 256

_WORDS = """
access account action active add address admin agent alert align amount analysis and answer api append application apply area array article
assert async attach audio author available average backup balance base batch begin benchmark between binary block body boolean border
bottom branch browser buffer build button byte cache calculate calendar callback cancel capture card category center change channel
character check child choice class clean client clock clone close cluster code collection color column command comment commit common
compare compile complete component compress compute config connect connection console constant container content context control convert
copy core count create current cursor custom data database date debug decode default define delete delta deploy depth description detail
device dialog directory disable display distance document domain double download draw driver dump duration dynamic edit editor element
email empty enable encode encrypt engine entity entry error event example exception execute exist expand expected export expression
external extract factory failure feature fetch field file filter final find first flag float folder font footer force foreign format forward
frame frequency function gateway general generate global graph group handler hash header height help hidden history host icon identifier
image import include index info init inner input insert instance integer interface internal interval invalid item iterator job join keyboard
label language large layer layout leading level library license limit line link list listener load local location lock log login logger long
machine main manager mapping margin master match matrix maximum measure media member memory menu merge message metadata method metric
middle minimum mode model module monitor mouse move multiple name native network next node normal notification null number object offset
online operation operator option order origin output overflow owner package padding page panel parameter parent parse partition patch path
pattern payload pending percent performance permission person phone pixel platform player plugin point pointer policy pool port position
prefix previous price primary print priority private process product profile progress project property protocol provider proxy public
publish quality query queue quick random range rate reader record redirect reference refresh region register release remote remove render
replace report repository request require reset resize resolve resource response result retry return reverse right role root rotate route row
rule sample save scale schedule schema scope screen script scroll search section segment select send sensor sequence series server service
session setting shadow shape share shell shift show signal simple single size skip snapshot socket sort source space split stack standard
start state static statistics status step stop storage store stream string structure style subject submit success suffix summary support
switch symbol sync system table target task template temporary test text theme thread threshold thumbnail timeout timestamp title toggle tool
total trace track transaction transform tree trigger type unique unit update upload user utility valid validate value variable vector verify
version video view virtual visible volume wait warning watch web weight width window word worker workflow wrapper write year zone
und der die das nicht eine sich werden haben ung heit keit lich schaft verwaltung entwicklung wissenschaft les des que pour dans avec nous
vous gouvernement information organisation los las una para como pero mente ciones desarrollo universidad
""".split()
_TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def default_samples(n: int = 600, seed: int = 7) -> list[tuple[str, str]]:
    """``n`` labelled rows (token, label) each of 'random' and 'ordinary', the same every time."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        chars = (_TOKEN_CHARS, _TOKEN_CHARS[:-2], _TOKEN_CHARS[:26] + _TOKEN_CHARS[52:62], _TOKEN_CHARS[26:62], "0123456789abcdef")[i % 5]
        rows.append(("".join(chars[int(r.random() * len(chars))] for _ in range(20 + int(r.random() * 28))), "random"))
    for i in range(n):
        words = [_WORDS[int(r.random() * len(_WORDS))] for _ in range(2 + int(r.random() * 4))]
        number = str(int(r.random() * 10 ** (1 + int(r.random() * 16))))
        form = i % 10
        token = ("_".join(words), words[0] + "".join(w.capitalize() for w in words[1:]), "-".join(words), "/".join(words), "".join(w.capitalize() for w in words), "_".join(words).upper(), "".join(words), "_".join([*words[:2], number[:4]]), f"{words[0]}={number}", "-".join((number[:4], number[4:6] or "1", number[6:8] or "2", number[8:])))[form]
        rows.append((token, "ordinary"))
    return rows


def fit(samples: DataFrame) -> list[int]:
    """Weights in thousandths of a nat, by 128 * previous + present code (0 begins a token), of labelled rows (token, label).

    ``label`` is 'random' or 'ordinary'; rows with nulls are ignored.
    """
    rows = samples.where("token is not null and label in ('random', 'ordinary')").select("token", "label")
    if rows.limit(MAX_SAMPLES + 1).count() > MAX_SAMPLES:
        raise ValueError(f"the labelled sample is bounded by {MAX_SAMPLES} rows")
    chars = rows.select("label", F.split("token", "").alias("c"))
    pairs = chars.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.when(i > 1, F.ascii(F.get("c", i - 2)) * 128).otherwise(0) + F.ascii(F.get("c", i - 1)))).alias("pair")).where("pair < 16384")
    counted = pairs.groupBy("pair").agg(*(F.count_if(F.col("label") == k).alias(k) for k in ("random", "ordinary")))
    before = counted.groupBy(F.expr("pair div 128").alias("prev")).agg(F.sum("random").alias("all_random"), F.sum("ordinary").alias("all_ordinary"))
    grid = samples.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("pair"), F.expr("id div 128").alias("prev"))
    full = grid.join(counted, "pair", "left").join(before, "prev", "left").na.fill(0)
    log = lambda k: F.log((F.col(k) + SMOOTHING) / (F.col(f"all_{k}") + SMOOTHING * SYMBOLS))
    weights = full.select("pair", F.round(1000 * (log("random") - log("ordinary"))).cast("int").alias("w"))
    return [w for _, w in sorted(weights.collect())]  # 16,384 rows, whatever the sample


def default_weights(spark: SparkSession) -> list[int]:
    return fit(spark.createDataFrame(default_samples(), "token string, label string"))


def _once(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _spans(text: Column, kind: str, pattern: str, counted: Column | None) -> Column:
    """Array of (start, rank, end, text) of the matches of ``pattern``, whose texts have the lengths ``counted`` or the match's."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rank = KINDS.index(kind)
    empty = F.expr(f"struct(0 as at, cast(array() as array<struct<start:int,rank:int,`end`:int,token:string>>) as found)")
    zipped = F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("token")))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

    length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0)))
    spans_of = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty["found"].alias("found")), step, lambda acc: acc["found"])

    def blocked(all_: Column) -> Column:
        # an array grows by copying: in blocks, the work is in proportion to the matches
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

        def placed(parts: Column) -> Column:
            starts = F.aggregate(parts, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + length(block))))
            return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), spans_of))

        return _once(blocks, placed)

    found = _once(zipped, lambda all_: F.when(F.size(all_) <= BLOCK, spans_of(all_, F.lit(0))).otherwise(blocked(all_)))
    if counted is None:
        return found
    return F.filter(F.transform(F.arrays_zip(found.alias("s"), counted.alias("g")), lambda x: F.when(F.length(x["g"]) >= BASE[kind][2], x["s"])), lambda s: s.isNotNull())


_NONE = "cast(array() as array<struct<start:int,rank:int,`end`:int,token:string>>)"


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind."""
    parts = []
    for kind, (pattern, group, _) in BASE.items():
        counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
        spans = _spans(text, kind, _LONG_ENOUGH[kind] or pattern, counted)
        parts.append(F.when(text.rlike(_LONG_ENOUGH[kind] or pattern), spans).otherwise(F.expr(_NONE)))
    return F.array_sort(F.concat(*parts))


#: Weight of a character of a base span: no segment crosses it.
_BARRED = -10_000_000


def _segments(steps: Column) -> Column:
    """Array of (from, to): segments of at least MIN_RANDOM steps whose sums are maximal and reach MIN_SCORE; one ends where the sum falls by as much."""
    lagged = F.slice(F.concat(F.array_repeat(F.lit(0), MIN_RANDOM), steps), F.lit(1), F.size(steps))
    zipped = F.zip_with(steps, lagged, lambda w, back: F.struct(w.alias("w"), back.alias("back")))
    far = 1 << 60
    start = F.expr(f"struct(0 as i, 0L as lead, 0L as lag, 0 as floor, {far}L as low, 0 as low_at, -{far}L as peak, 0 as `from`, 0 as `to`, cast(array() as array<struct<`from`:int,`to`:int>>) as found)")
    of = lambda acc, **new: F.struct(*(new.get(c, acc[c]).alias(c) for c in ("i", "lead", "lag", "floor", "low", "low_at", "peak", "from", "to", "found")))
    closed = lambda acc: F.when(acc["peak"] >= MIN_SCORE, F.concat(acc["found"], F.array(F.struct(acc["from"].alias("from"), acc["to"].alias("to"))))).otherwise(acc["found"])

    def moved(acc: Column, x: Column) -> Column:
        i, lag = acc["i"] + 1, acc["lag"] + x["back"]
        lower = (i - MIN_RANDOM >= acc["floor"]) & (lag < acc["low"])
        return of(acc, i=i, lead=acc["lead"] + x["w"], lag=lag, low=F.when(lower, lag).otherwise(acc["low"]), low_at=F.when(lower, i - MIN_RANDOM).otherwise(acc["low_at"]))

    def raised(acc: Column) -> Column:
        score = acc["lead"] - acc["low"]
        more = score > acc["peak"]
        return of(acc, peak=F.when(more, score).otherwise(acc["peak"]), **{"from": F.when(more, acc["low_at"]).otherwise(acc["from"]), "to": F.when(more, acc["i"]).otherwise(acc["to"])})

    def ended(acc: Column) -> Column:
        over = (acc["peak"] >= MIN_SCORE) & (acc["lead"] - acc["low"] <= acc["peak"] - MIN_SCORE)
        again = of(acc, floor=acc["i"], low=F.lit(far), peak=F.lit(-far), found=closed(acc))
        return F.when(over, again).otherwise(acc)

    return F.aggregate(zipped, start, lambda acc, x: _once(_once(moved(acc, x), raised), ended), closed)


def random_spans(text: Column, base: Column, weights: list[int]) -> Column:
    """Spans of kind ``random``: whole runs that reach MIN_SCORE and that no span of ``base`` overlaps; of other runs
    the segments outside base spans that reach it, up to the next of ``/ _ = -``."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")

    def steps(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), F.ascii)
        return F.zip_with(F.slice(F.concat(F.array(F.lit(0)), codes), F.lit(1), F.size(codes)), codes, lambda a, b: F.get(table, a * 128 + b))

    meets = lambda bases, start, end: F.exists(bases, lambda b: (b["start"] < end) & (start < b["end"]))

    def parts(s: Column, near: Column, weighed: Column) -> Column:
        barred = F.transform(weighed, lambda w, k: F.when(meets(near, s["start"] + k, s["start"] + k + 1), F.lit(_BARRED)).otherwise(w))

        def span(x: Column) -> Column:
            before = F.regexp_extract(F.substring(s["token"], F.lit(1), x["from"]), "(?<![A-Za-z0-9+])[A-Za-z0-9+]*+$", 0)
            after = F.regexp_extract(F.substring(s["token"], x["to"] + 1, F.length(s["token"])), "^[A-Za-z0-9+]*+", 0)
            start, end = s["start"] + x["from"] - F.length(before), s["start"] + x["to"] + F.length(after)
            start = F.when(meets(near, start, s["start"] + x["from"]), s["start"] + x["from"]).otherwise(start)
            end = F.when(meets(near, s["start"] + x["to"], end), s["start"] + x["to"]).otherwise(end)
            token = F.substring(s["token"], start - s["start"] + 1, end - start)
            return F.struct(start.alias("start"), s["rank"].alias("rank"), end.alias("end"), token.alias("token"))

        return F.array_distinct(F.transform(_segments(F.when(F.size(near) > 0, barred).otherwise(weighed)), span))

    def run(s: Column) -> Column:
        held = F.array(F.struct(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).alias("near"), steps(s["token"]).alias("w")))
        one = lambda x: F.when((F.size(x["near"]) == 0) & (F.aggregate(x["w"], F.lit(0).cast("long"), lambda acc, w: acc + w) >= MIN_SCORE), F.array(s)).otherwise(parts(s, x["near"], x["w"]))
        return F.get(F.transform(held, one), 0)

    return F.when(text.rlike(RANDOM), F.flatten(F.transform(_spans(text, "random", RANDOM, None), run))).otherwise(F.expr(_NONE))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_spans(docs: DataFrame, text_col: str, weights: list[int]) -> DataFrame:
    """``docs`` with __text, __base and __random."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn("__base", base_spans(F.col("__text")))
    return rows.withColumn("__random", random_spans(F.col("__text"), F.col("__base"), weights))


def scan(docs: DataFrame, weights: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _with_spans(rows, "text", default_weights(docs.sparkSession) if weights is None else weights)
    both = F.concat("__base", "__random")
    number = lambda k: F.size(F.filter(both, lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(number(k) for k in KINDS), F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.array_sort(both)).alias("spans"))


def redact(docs: DataFrame, weights: list[int] | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of a text replaced by ``MASK`` (one for spans that overlap); ``length_col``, if there, follows."""
    rows = _with_spans(docs, text_col, default_weights(docs.sparkSession) if weights is None else weights)
    text = F.col("__text")
    start = F.expr("struct(0 as at, cast(array() as array<string>) as parts)")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(MASK)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    masked = F.aggregate(F.array_sort(F.concat("__base", "__random")), start, step, lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""))
    clean = F.size("__base") + F.size("__random") == 0
    new = rows.withColumn("__new", F.when(clean, F.col(text_col)).otherwise(masked))
    columns = {text_col: F.col("__new")}
    if length_col and length_col in docs.columns:
        columns[length_col] = F.when(clean, F.col(length_col)).otherwise(F.length("__new").cast(docs.schema[length_col].dataType))
    return new.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))
