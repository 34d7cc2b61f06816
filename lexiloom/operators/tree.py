"""Decision tree over context windows, grown level by level with joins and aggregates.

A node's id is its path in bits (root 1, equal 2k, else 2k + 1). Each level costs
one aggregate over (node, feature, value, phone) for all nodes at once; rows are
weighted distinct vectors. Ties go to the first feature and the first value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.arrays import context_windows, uncook
from lexiloom.session import checkpointed
from lexiloom.symbols import EPSILON, JOINER, PAD

MAX_DEPTH = 60
#: Nodes that a predictor may collect and broadcast (about 0.2 kB each).
MAX_NODES = 1_000_000
MAX_LETTERS = 100_000


def _impurity(n: Column, total: Column, criterion: str) -> Column:
    p = n / total
    return -p * F.log2(p) * total if criterion == "entropy" else p * (1 - p) * total


def split_gains(rows: DataFrame, features: list[str], criterion: str = "entropy") -> DataFrame:
    """(node, feature, value, n, gain): weighted impurity removed by each test feature = value."""
    per_class = rows.groupBy("node", "p").agg(F.sum("n").alias("c"))
    own = Window.partitionBy("node")
    whole = per_class.withColumn("all", F.sum("c").over(own)).groupBy("node").agg(F.first("all").alias("all"), F.sum(_impurity(F.col("c"), F.col("all"), criterion)).alias("before"))
    pairs = rows.select("node", "p", "n", F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(features)))).alias("x"))
    counts = pairs.groupBy("node", "x.feature", "x.value", "p").agg(F.sum("n").alias("k"))
    sums = counts.groupBy("node", "feature", "value").agg(F.sum("k").alias("kk"))
    full = counts.join(sums, ["node", "feature", "value"])
    inside = full.groupBy("node", "feature", "value", "kk").agg(F.sum(_impurity(F.col("k"), F.col("kk"), criterion)).alias("yes"))
    # classes of the other side: all of the node's less those inside; classes not inside keep their count
    both = full.join(per_class, ["node", "p"]).join(whole, "node")
    rest = F.col("all") - F.col("kk")
    term = lambda x: F.when((x > 0) & (rest > 0), _impurity(x, rest, criterion)).otherwise(0.0)
    change = both.groupBy("node", "feature", "value").agg(F.sum(term(F.col("c") - F.col("k")) - term(F.col("c"))).alias("delta"))
    outside = inside.join(whole, "node").join(change, ["node", "feature", "value"])
    per_node = per_class.join(inside.select("node", "feature", "value", "kk"), "node").join(whole.select("node", "all"), "node")
    base = per_node.groupBy("node", "feature", "value").agg(F.sum(term(F.col("c"))).alias("no_base"))
    told = outside.join(base, ["node", "feature", "value"])
    return told.select("node", "feature", "value", F.col("kk").alias("n"), F.round(F.col("before") - F.col("yes") - (F.col("no_base") + F.col("delta")), 9).alias("gain"), "all")


def train(vectors: DataFrame, features: list[str] | None = None, max_depth: int = 20, min_samples_split: int = 2, min_samples_leaf: int = 1, criterion: str = "entropy", min_gain: float = 1e-9) -> DataFrame:
    """(node, feature, value, dist): inner nodes have a test, and every node its phones, likeliest first."""
    features = features or sorted(c for c in vectors.columns if c[0] == "c" and c[1:].isdigit())
    rows = checkpointed(vectors.withColumn("node", F.lit(1).cast("long")))
    levels = []
    for _ in range(min(max_depth, MAX_DEPTH) + 1):
        dist = rows.groupBy("node", "p").agg(F.sum("n").alias("c"))
        total = dist.groupBy("node").agg(F.sum("c").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("neg"), "p"))).alias("d"))
        nodes = total.select("node", F.transform("d", lambda x: F.struct(x["p"].alias("phone"), (-x["neg"] / F.col("all")).alias("prob"), (-x["neg"]).alias("n"))).alias("dist"))
        gains = split_gains(rows, features, criterion).where((F.col("gain") > min_gain) & (F.col("all") >= min_samples_split) & (F.col("n") >= min_samples_leaf) & (F.col("all") - F.col("n") >= min_samples_leaf))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("gain"), "feature", "value"))
        deepest = len(levels) >= min(max_depth, MAX_DEPTH)
        best = gains.where("false").select("node", "feature", "value") if deepest else checkpointed(gains.withColumn("rank", rank).where("rank = 1").select("node", "feature", "value"))
        deepest = deepest or best.isEmpty()
        tests = best.where("false") if deepest else best
        levels.append(checkpointed(nodes.join(tests, "node", "left").select("node", "feature", "value", "dist")))
        if deepest:
            break
        answer = F.coalesce(*(F.when(F.col("feature") == i, F.col(c) == F.col("value")) for i, c in enumerate(features)))
        rows = checkpointed(rows.join(best, "node").withColumn("node", F.col("node") * 2 + F.when(answer, 0).otherwise(1)).drop("feature", "value"))
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    return tree


def prune(tree: DataFrame, validation: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Reduced-error pruning, bottom up: a node whose own majority errs no more than its subtree becomes a leaf."""
    features = features or sorted(c for c in validation.columns if c[0] == "c" and c[1:].isdigit())
    nodes = checkpointed(tree.withColumns({"depth": F.length(F.bin("node")) - 1, "best": F.get("dist", 0)["phone"]}))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    rows = validation.withColumn("node", F.lit(1).cast("long"))
    tests = nodes.select("node", "feature", "value", "best")
    errors = None
    for _ in range(depth + 1):
        here = rows.join(tests, "node")
        wrong = here.groupBy("node").agg(F.sum(F.when(F.col("p") != F.col("best"), F.col("n")).otherwise(0)).alias("wrong"))
        errors = wrong if errors is None else errors.unionByName(wrong)
        answer = F.coalesce(*(F.when(F.col("feature") == i, F.col(c) == F.col("value")) for i, c in enumerate(features)))
        rows = checkpointed(here.where("feature is not null").withColumn("node", F.col("node") * 2 + F.when(answer, 0).otherwise(1)).select(validation.columns + ["node"]))
    told = checkpointed(nodes.join(errors, "node", "left").na.fill(0, ["wrong"]).select("node", "depth", "feature", "wrong"))
    below = told.where("false").select("node", F.col("wrong").alias("subtree"))
    cut = []
    for d in range(depth, -1, -1):
        children = below.groupBy(F.floor(F.col("node") / 2).cast("long").alias("node")).agg(F.sum("subtree").alias("under"))
        level = told.where(F.col("depth") == d).join(children, "node", "left")
        leaf = F.col("feature").isNull() | (F.col("wrong") <= F.col("under"))
        level = checkpointed(level.select("node", leaf.alias("leaf"), F.when(leaf, F.col("wrong")).otherwise(F.col("under")).alias("subtree")))
        cut += [r.node for r in level.where("leaf").select("node").collect()]
        below = level.select("node", "subtree")
    stops = set(cut)
    alive, todo = set(), [1]
    known = {r.node for r in nodes.select("node").limit(MAX_NODES + 1).collect()}
    if len(known) > MAX_NODES:
        raise ValueError(f"a tree of more than {MAX_NODES} nodes can't be pruned on the driver")
    while todo:
        k = todo.pop()
        if k in known:
            alive.add(k)
            if k not in stops:
                todo += [2 * k, 2 * k + 1]
    spark = tree.sparkSession
    kept = spark.createDataFrame([(k, k in stops) for k in sorted(alive)], "node long, stop boolean")
    return tree.join(F.broadcast(kept), "node").select("node", *(F.when(~F.col("stop"), F.col(c)).alias(c) for c in ("feature", "value")), "dist")


class Walker:
    """Prediction from a collected tree; plain Python, so one code path serves batches, streams and calls."""

    def __init__(self, rows: list[tuple], width: int = 7):
        self.nodes = {r[0]: (r[1], r[2], [(d[0], d[1]) for d in r[3]]) for r in rows}
        self.width, self.half = width, width // 2
        self.letters = {v for f, v, _ in self.nodes.values() if f is not None}

    def distributions(self, letters: list[str]) -> list[list[tuple[str, float]]]:
        from lexiloom.symbols import PAD

        padded, out = [PAD] * self.half + letters + [PAD] * self.half, []
        for i in range(len(letters)):
            node = 1
            while node in self.nodes:
                feature, value, dist = self.nodes[node]
                if feature is None:
                    break
                node = 2 * node + (padded[i + feature] != value)
            out.append(dist)
        return out

    def nbest(self, letters: list[str], n: int = 5) -> list[tuple]:
        from lexiloom.symbols import JOINER

        beam: list[tuple] = [((), 1.0)]
        for dist in self.distributions(letters):
            beam = sorted(((path + (p,), s * q) for path, s in beam for p, q in dist[: min(3, n)]), key=lambda x: -x[1])[:n]
        return [([p for t in path if t != EPSILON for p in t.split(JOINER)], s) for path, s in beam] if letters else []


def walker(tree: DataFrame, width: int = 7) -> Walker:
    rows = tree.limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"a tree of more than {MAX_NODES} nodes can't be broadcast")
    return Walker([(r.node, r.feature, r.value, [(d.phone, d.prob) for d in r.dist]) for r in rows], width)


class Paths:
    """A collected tree as arrays: batches of letters go down it together, a level a step."""

    def __init__(self, walker: Walker, top: int | None = None):
        place = {k: i for i, k in enumerate(walker.nodes)}
        self.half, self.root = walker.half, place.get(1)
        self.tokens = {t: c for c, t in enumerate(sorted(walker.letters | {PAD}))}
        inner = [(i, k, f, v) for k, i in place.items() for f, v, _ in [walker.nodes[k]] if f is not None]
        self.feature, self.value = np.full(len(place), -1), np.full(len(place), -1)
        self.to = np.tile(np.arange(len(place))[:, None], (1, 2))  # a node without the child that is asked for keeps the letter
        for i, k, f, v in inner:
            self.feature[i], self.value[i] = f, self.tokens[v]
            self.to[i] = [place.get(2 * k, i), place.get(2 * k + 1, i)]
        dists = [d[:top] for _, _, d in walker.nodes.values()]
        ends = np.cumsum([0] + [len(d) for d in dists]).astype(np.int32)
        flat = [x for d in dists for x in d]
        pairs = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.string()), pa.array([q for _, q in flat], pa.float64())], ["phone", "prob"])
        self.dists = pa.ListArray.from_arrays(pa.array(ends), pairs)

    def leaves(self, letters: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, leaf of each letter)."""
        lengths = pc.list_value_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
        told = letters.flatten().dictionary_encode()
        codes = np.array([self.tokens.get(t, -2) for t in told.dictionary.to_pylist()] + [0])[told.indices.to_numpy(zero_copy_only=False)]
        own = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)) * 2 * self.half, lengths) + self.half
        padded = np.full(len(codes) + 2 * self.half * len(lengths), self.tokens[PAD])
        padded[own] = codes
        node = np.full(len(codes), self.root)
        going = np.arange(len(codes))
        while len(going):
            at = node[going]
            inner = self.feature[at] >= 0
            going, at = going[inner], at[inner]
            further = self.to[at, (padded[own[going] - self.half + self.feature[at]] != self.value[at]).astype(int)]
            node[going] = further
            going = going[further != at]
        return lengths, node

    def distributions(self, letters: pa.ListArray) -> pa.ListArray:
        lengths, node = self.leaves(letters)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), self.dists.take(pa.array(node)))


DISTS = "array<array<struct<phone:string,prob:double>>>"


def distributions(words: DataFrame, tree: DataFrame, width: int = 7, top: int | None = None) -> DataFrame:
    """``words`` (..., letters) with ``dists``: for each letter the leaf's phones, likeliest first, or the ``top`` ones where no more are asked for."""
    held = words.sparkSession.sparkContext.broadcast(Paths(walker(tree, width), top))

    @F.arrow_udf(DISTS)
    def walk(letters: pa.Array) -> pa.Array:
        return held.value.distributions(letters)

    return words.withColumn("dists", walk("letters"))


def vocabulary(vectors: DataFrame, width: int = 7) -> list[str]:
    """The letters that the middle of a training window held; an alphabet, so it is collected."""
    rows = vectors.select(f"c{width // 2}").distinct().limit(MAX_LETTERS + 1).collect()
    if len(rows) > MAX_LETTERS:
        raise ValueError(f"more than {MAX_LETTERS} letters")
    return sorted(r[0] for r in rows)


def predicted(dists: Column, letters: Column | None = None, known: list[str] | None = None) -> Column:
    """The likeliest phone of each position, joined tokens apart; letters that aren't ``known`` are silent."""
    best = F.transform(dists, lambda d: F.get(d, 0)["phone"])
    if known is not None:
        best = F.zip_with(letters, best, lambda c, p: F.when(c.isin(known), p).otherwise(EPSILON))
    return uncook(best)


def confidences(dists: Column) -> Column:
    """The probability of each predicted phone; each phone of a joined token has the token's."""
    spoken = F.filter(F.transform(dists, lambda d: F.get(d, 0)), lambda d: d["phone"] != EPSILON)
    return F.flatten(F.transform(spoken, lambda d: F.array_repeat(d["prob"], F.size(F.split(d["phone"], JOINER)))))


def nbest(dists: Column, n: int = 5) -> Column:
    """Up to n (phones, score), best first: a beam over positions of the three likeliest phones each."""
    k = min(3, n)
    start = F.array(F.struct(F.expr("cast(array() as array<string>)").alias("phones"), F.lit(1.0).alias("score")))

    def step(beam: Column, dist: Column) -> Column:
        grown = F.flatten(F.transform(beam, lambda b: F.transform(F.slice(dist, 1, k), lambda d: F.struct((-(b["score"] * d["prob"])).alias("neg"), F.concat(b["phones"], F.array(d["phone"])).alias("phones")))))
        return F.transform(F.slice(F.array_sort(grown), 1, n), lambda g: F.struct(g["phones"].alias("phones"), (-g["neg"]).alias("score")))

    beam = F.aggregate(dists, start, step)
    return F.when(F.size(dists) > 0, F.transform(beam, lambda b: F.struct(uncook(b["phones"]).alias("phones"), b["score"].alias("score"))))


def with_exceptions(words: DataFrame, exceptions: DataFrame, model_phones: str = "predicted") -> DataFrame:
    """``words`` with ``phones``: a listed pronunciation first, else any model's; ``confidences``, if there, are 1 for listed ones."""
    listed = exceptions.select(F.col("word").alias("__w"), F.col("phones").alias("listed"))
    rows = words.join(listed, F.lower("word") == F.col("__w"), "left").withColumn("phones", F.coalesce("listed", model_phones))
    if "confidences" in words.columns:
        rows = rows.withColumn("confidences", F.when(F.col("listed").isNotNull(), F.transform("listed", lambda _: F.lit(1.0))).otherwise(F.col("confidences")))
    return rows.drop("__w", "listed")


def windows_of(entries: DataFrame, width: int = 7) -> DataFrame:
    return entries.withColumn("windows", context_windows(F.col("letters"), width))
