"""Embedding near-duplicates by a neighbour graph that starts from random hyperplanes.

Equal vectors of one label are one node with a number of members (found by a
digest, so that vectors are shuffled once). Each node falls into one block in
each of several tables, by the sides of random hyperplanes on which it lies; the
bits and tables follow from the size of the label, so that a pair at the
threshold meets in some block but for a chance of ``MISS``, and a block holds
some ``BLOCK`` nodes of a label without structure. Only ids and signatures travel
to the blocks; pairs whose signatures are close are candidates, and these alone
are verified in double precision. A node asks for its ``LIST`` closest candidates;
if it has more, its list is cut and it counts as saturated. A link whose ends are
not both saturated is never cut. For the rest there is an exact way: components
with a saturated node are held against each other, by the triangle inequality
over centres and radii of their tiles, then vector by vector where a bound leaves
room, and those that touch become one; links within them, and within small
components, are counted tile by tile. In other components NN-descent joins the
neighbours of each node until few edges are new. An audit compares link counts of
a bounded sample of nodes with brute force; below ``MIN_RECALL`` further tables
follow, and in the end an exact pass over all pairs of a label.

Defined cases: a vector that is null, empty or zero, that holds null or
non-finite components, or whose label is null, links with nothing; vectors of
different lengths never link; repeated rows are vectors of their own, and a null
id takes part but is never the smallest of a component unless it holds nothing
else; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexiloom.llm.shared import checkpointed, connected_components, written

THRESHOLD = 0.98
#: Chance that a pair at the threshold meets in no block; a tenth of it that its signatures are too far apart.
MISS = 1e-4
#: Nodes of a block, as planned; tables at most (for low thresholds blocks grow instead); words of 64 bits in a signature.
BLOCK, MAX_TABLES, WORDS = 512, 24, 2
#: Candidates of a node that are verified; a node with more is saturated.
LIST = 24
#: Members of one join at a node; more are split into sets.
JOIN_SET = 48
MAX_ROUNDS, SETTLED = 8, 0.005
TILE = 512
AUDIT_NODES, MIN_RECALL, MAX_ATTEMPTS = 512, 0.97, 3

#: What angles (in radians) may be off by.
ANGLE_SLACK = 1e-6

#: Groups, and nodes with candidates, that are broadcast; beyond, a shuffled join.
MAX_BROADCAST = 1_000_000


def _raw(column: pa.Array) -> np.ndarray:
    """The vectors of a column as nodes_of writes them, all of one length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    if there.shape[1] % 2:  # single precision, see nodes_of
        return np.ascontiguousarray(there[:, :-1]).view(np.float32).astype(np.float64)
    return there.view(np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    """The unit vectors of such a column."""
    x = _raw(column)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows with vectors of equal length."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield np.nonzero(lengths == n)[0]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys out of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for x in columns:
            change[1:] |= x[1:] != x[:-1]
        first = tuple(x[0] for x in columns)
        if held and first != last:
            yield _one(held)
            held = []
        cuts = [0, *np.nonzero(change)[0].tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield _one([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-1]))
        last = tuple(x[-1] for x in columns)
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def nodes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, grp, key, n, least, vector), one row per distinct vector of a label, and (vec_id, grp, key) of every row.

    ``key``: a digest of the vector; it and ``grp`` are null where the row is not
    usable. ``vector``: its components as bytes, in double precision, or in single
    precision and one byte more.
    """
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes | None] = [None] * batch.num_rows
            groups: list[str | None] = [None] * batch.num_rows
            labels, column = batch.column(1).to_pylist(), batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0]):
                at = np.nonzero(lengths == n)[0]
                x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)  # a null is not a number here
                x = np.ascontiguousarray(x + x.dtype.type(0))  # -0.0 has the bytes of 0.0 only after this
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                for k, row in zip(at[good].tolist(), x[good], strict=True):
                    if labels[k] is not None:
                        found[k], groups[k] = row.tobytes() + b"1" * single, f"{n}/{labels[k]}"
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, pa.string()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["vec_id", "grp", "key", "vector"])

    told = rows.mapInArrow(run, "vec_id long, grp string, key binary, vector binary")
    groups = told.where("grp is not null").groupBy("grp", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = groups.withColumn("node", F.monotonically_increasing_id())
    return written(nodes.select("node", "grp", "key", "n", "least", "vector"), "vectors"), told.select("vec_id", "grp", "key")


def _plan(size: int, threshold: float) -> tuple[int, int]:
    """Bits and tables of the blocks of a group of ``size`` nodes."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    for bits in range(max(0, math.ceil(math.log2(max(size, 1) / BLOCK))), 0, -1):
        meet = same**bits
        tables = 1 if meet >= 1 else math.ceil(math.log(MISS) / math.log1p(-meet))
        if tables <= MAX_TABLES:
            return bits, tables
    return 0, 1


def _reach(threshold: float) -> int:
    """Bits by which signatures of a pair at the threshold may differ, but for a chance of MISS / 10."""
    n, differ = 64 * WORDS, math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    there = 0.0
    for k in range(n + 1):
        there += math.comb(n, k) * differ**k * (1 - differ) ** (n - k)
        if there >= 1 - MISS / 10:
            return k
    return n


@functools.lru_cache(maxsize=64)
def _planes(seed: int, length: int, bits: int, tables: int) -> np.ndarray:
    """Normals of random hyperplanes: of ``tables`` times ``bits``, then of the signature."""
    return np.random.default_rng([seed, length, bits]).normal(size=(length, bits * tables + 64 * WORDS)).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _close(ids: np.ndarray, signatures: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, far) of the LIST closest others of each node of a block that are within reach, and the nodes that have more."""
    for a in range(0, len(ids), 256):
        rows = np.arange(a, min(a + 256, len(ids)))
        n = np.zeros(len(rows), np.int64)
        for b in range(0, len(ids), 4096):
            if not len(rows):
                break
            far = np.zeros((len(rows), min(4096, len(ids) - b)), np.uint8)
            for w in range(WORDS):
                far += np.bitwise_count(signatures[w, rows][:, None] ^ signatures[w, b : b + 4096][None, :])
            p, q = np.nonzero(far <= reach)
            other = ids[rows[p]] != ids[b + q]
            p, q = p[other], q[other]
            if not len(p):
                continue
            found = far[p, q]
            order = np.lexsort((found, p))
            p, q, found = p[order], q[order], found[order]
            starts = np.searchsorted(p, np.arange(len(rows)))
            best = np.arange(len(p)) - starts[p] < LIST
            n += np.diff(np.append(starts, len(p)))
            cut = n > LIST
            yield ids[rows[p[best]]], ids[b + q[best]], found[best], ids[rows[cut]]
            rows, n = rows[~cut], n[~cut]


def _candidates(nodes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(u, v, far): for each node the others of its blocks with close signatures; v is null for one whose list was cut."""
    sizes = checkpointed(nodes.groupBy("grp").agg(F.count("*").alias("size")))
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes
    reach, names = _reach(threshold), [f"w{k}" for k in range(WORDS)]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = batch.column(0), batch.column(2).to_numpy()
            group = batch.column(1).to_numpy().view(np.uint64)
            known, which = np.unique(size, return_inverse=True)
            plans = np.array([_plan(n, threshold) for n in known.tolist()], np.int64).reshape(-1, 2)[which]
            for at in _by_length(batch.column(3)):
                x = _matrix(batch.column(3).take(pa.array(at))).astype(np.float32)
                for bits, tables in {tuple(p) for p in plans[at].tolist()}:
                    own = np.nonzero((plans[at] == (bits, tables)).all(axis=1))[0]
                    # the signature's planes come last, so what is drawn for them hangs on bits and tables, alike in one group
                    side = x[own] @ _planes(seed, x.shape[1], bits, tables) > 0
                    last = np.packbits(side[:, bits * tables :], axis=1).view(np.uint64)
                    columns = [pa.array(last[:, w].view(np.int64)) for w in range(WORDS)]
                    ids = node.take(pa.array(at[own]))
                    for t in range(tables):
                        place = side[:, t * bits : (t + 1) * bits] @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)) if bits else np.zeros(len(own), np.uint64)
                        code = _mixed(_mixed(group[at[own]] + np.uint64(t)) ^ place)
                        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), ids, *columns], ["code", "node", *names])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def told() -> pa.RecordBatch:
            u, v, far, cut = (np.concatenate([p[k] for p in parts]) for k in range(4))
            v = pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(len(cut), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, cut]), pa.int64()), v, pa.array(np.concatenate([far, np.zeros(len(cut), np.uint8)]).astype(np.int32))], ["u", "v", "far"])

        for group in _groups(batches, ["code"]):
            if group.num_rows < 2:
                continue
            for part in _close(group.column(1).to_numpy(), np.stack([group.column(2 + w).to_numpy().view(np.uint64) for w in range(WORDS)]), reach):
                parts.append(part)
                held += len(part[0])
                if held > 50_000:
                    yield told()
                    parts, held = [], 0
        if parts:
            yield told()

    coded = nodes.join(sizes, "grp").select("node", F.xxhash64("grp").alias("group"), "size", "vector").mapInArrow(block, ", ".join(["code long", "node long", *(f"{w} long" for w in names)]))
    found = coded.repartition("code").sortWithinPartitions("code").mapInArrow(close, "u long, v long, far int")
    return written(found.groupBy("u", "v").agg(F.min("far").alias("far")), "candidates")


def graph(nodes: DataFrame, threshold: float = THRESHOLD, seed: int = 0, before: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (u, v), u < v, among candidates, and saturated nodes (node); ``before``: those of other seeds, to be added."""
    found = _candidates(nodes, threshold, seed)
    rank = F.row_number().over(Window.partitionBy("u").orderBy("far", "v"))
    ranked = found.where("v is not null").withColumn("rank", rank).where(F.col("rank") <= LIST + 1)  # Spark cuts to as many before the shuffle
    ranked = written(ranked.select("u", "v", "rank"), "lists")
    saturated = ranked.where(F.col("rank") > LIST).select(F.col("u").alias("node")).unionByName(found.where("v is null").select(F.col("u").alias("node"))).distinct()
    links = _verified(nodes, ranked.where(F.col("rank") <= LIST), threshold)
    if before is not None:
        links, saturated = links.unionByName(before[0]).distinct(), saturated.unionByName(before[1]).distinct()
    return written(links, "links"), checkpointed(saturated)


def _only(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``nodes`` that ``ids`` (node) name, written: few, so that what follows shuffles no other vectors."""
    ids = checkpointed(ids.distinct())
    return written(nodes.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "node", "left_semi"), "named")


def _verified(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: those of ``pairs`` (u, v) in one group whose cosine in double precision reaches the threshold."""
    near = checkpointed(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    named = _only(nodes, near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))))
    left, right = (named.select(F.col("node").alias(c), F.col("grp").alias(f"{c}_grp"), F.col("vector").alias(f"{c}_vector")) for c in ("u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for at in _by_length(batch.column(2)):
                x, y = (_matrix(batch.column(k).take(pa.array(at))) for k in (2, 3))
                good[at] = np.einsum("ij,ij->i", x, y) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(good))

    both = near.join(left, "u").join(right, "v").where("u_grp = v_grp")
    return both.select("u", "v", "u_vector", "v_vector").mapInArrow(run, "u long, v long")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def descend(nodes: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (u, v), u < v, with those that joining the neighbours of each node adds, round by round; each ``turn`` deals the sets anew."""
    links = written(links.select("u", "v"), "neighbours")
    before = links.count()
    for turn in range(MAX_ROUNDS if before else 0):
        members = _both_ways(links)
        sizes = members.groupBy("u").agg(F.ceil(F.count("*") / JOIN_SET).alias("sets"))
        spread = members.join(sizes, "u").withColumn("part", F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.col("sets")))
        sets = spread.groupBy("u", "part").agg(F.sort_array(F.collect_list("v")).alias("set")).where(F.size("set") > 1)
        pairs = sets.select(F.explode("set").alias("u"), "set").select("u", F.explode("set").alias("v")).where("u < v")
        more = _verified(nodes, pairs.distinct().join(links, ["u", "v"], "left_anti"), threshold)
        links = written(links.unionByName(more).distinct(), "neighbours")
        now = links.count()
        if now - before <= SETTLED * now:
            break
        before = now
    return links


def _tile_pairs(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(component, i, j, tile, node, n, vector): the tiles of each component of members (node, component), once for each pair i <= j."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = members.join(sizes, "component").join(nodes.select("node", "n", "vector"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "n", "vector")


def _tile_counts(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(node, links): vectors linked with each node within its component, members (node, component), by pairs of tiles."""

    def run(table: pa.Table) -> pa.Table:
        x, node, n = _matrix(table["vector"]), table["node"].to_numpy(), table["n"].to_numpy()
        tile, i, j = table["tile"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        a = tile == i
        b = a if i == j else ~a
        linked = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(linked, False)
            out_node, out = node[a], linked @ n[b]
        else:
            out_node, out = np.concatenate([node[a], node[b]]), np.concatenate([linked @ n[b], linked.T @ n[a]])
        return pa.table({"node": pa.array(out_node, pa.int64()), "links": pa.array(out.astype(np.int64))})

    return _tile_pairs(nodes, members).groupBy("component", "i", "j").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the symmetric matrix ``linked`` connects, one less than nodes in each component."""
    left, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            at = todo.pop()
            new = np.nonzero(linked[at] & left)[0].tolist()
            left[new] = False
            todo += new
            edges += [(at, k) for k in new]
    return edges


def _tile_forest(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that connect all that links within each component of members (node, component) connect."""

    def run(table: pa.Table) -> pa.Table:
        x, node = _matrix(table["vector"]), table["node"].to_numpy()
        edges = np.array(_forest(x @ x.T >= threshold), np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(node[edges[:, 0]], pa.int64()), "v": pa.array(node[edges[:, 1]], pa.int64())})

    return _tile_pairs(nodes, members).groupBy("component", "i", "j").applyInArrow(run, "u long, v long")


def _touching(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of the components of members (node, component) that links connect; tiles that are too far apart to touch are not compared."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    placed = written(tiled.join(nodes.select("node", "grp", "vector"), "node").select("grp", "component", "tile", "vector"), "saturated")

    def centre(table: pa.Table) -> pa.Table:
        x = _matrix(table["vector"])
        c = x.mean(axis=0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ c, -1, 1)).max())
        return pa.table({k: table[k].slice(0, 1) for k in ("grp", "component", "tile")} | {"centre": pa.array([c.tobytes()], pa.binary()), "radius": pa.array([radius])})

    cells = written(placed.groupBy("grp", "component", "tile").applyInArrow(centre, "grp string, component long, tile int, centre binary, radius double"), "cells")
    blocks = cells.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = cells.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("component", "tile"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    reach = float(np.arccos(threshold)) + ANGLE_SLACK

    def close(table: pa.Table) -> pa.Table:
        x, radius, block = _raw(table["centre"]), table["radius"].to_numpy(), table["block"].to_numpy()
        component, tile = table["component"].to_numpy(), table["tile"].to_numpy()
        a, b = np.nonzero(block == table["i"][0].as_py())[0], np.nonzero(block == table["j"][0].as_py())[0]
        near = np.arccos(np.clip(x[a] @ x[b].T, -1, 1)) <= radius[a][:, None] + radius[b][None, :] + reach
        near &= component[a][:, None] < component[b][None, :] if table["i"][0] == table["j"][0] else component[a][:, None] != component[b][None, :]
        p, q = np.nonzero(near)
        p, q = a[p], b[q]
        return pa.table({"a": component[p], "a_tile": tile[p], "b": component[q], "b_tile": tile[q]})

    pairs = written(dealt.select("grp", "i", "j", "block", "component", "tile", "centre", "radius").groupBy("grp", "i", "j").applyInArrow(close, "a long, a_tile int, b long, b_tile int"), "pairs")
    side = lambda c: pairs.select("a", "a_tile", "b", "b_tile", F.col(c).alias("component"), F.col(f"{c}_tile").alias("tile"))
    both = side("a").unionByName(side("b")).join(placed.select("component", "tile", "vector"), ["component", "tile"])

    def touch(table: pa.Table) -> pa.Table:
        x, a = _matrix(table["vector"]), table["component"].to_numpy() == table["a"][0].as_py()
        found = bool((x[a] @ x[~a].T >= threshold).any())
        return table.select(["a", "b"]).slice(0, int(found))

    return both.select("a", "a_tile", "b", "b_tile", "component", "vector").groupBy("a", "a_tile", "b", "b_tile").applyInArrow(touch, "a long, b long").distinct()


def _renamed(members: DataFrame, merged: DataFrame) -> DataFrame:
    """members (node, component) with the components that merged (node, component) names."""
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    return checkpointed(members.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component")))


def _small_counts(nodes: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``_tile_counts`` for components of one tile, many in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for group in _groups(batches, ["component"]):
            x = _matrix(group.column(3))
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            out.append((group.column(1).to_numpy(), linked @ group.column(2).to_numpy()))
            held += group.num_rows
            if held > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["node", "links"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["node", "links"])

    placed = members.join(nodes.select("node", "n", "vector"), "node").select("component", "node", "n", "vector")
    return placed.repartition("component").sortWithinPartitions("component").mapInArrow(run, "node long, links long")


def link_counts(nodes: DataFrame, links: DataFrame, saturated: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, component) of the nodes that ``links`` (u, v) connects with others, or that are ``saturated`` (node)."""
    members = connected_components(links, "u", "v")
    alone = saturated.join(members, "node", "left_anti").select("node", F.col("node").alias("component"))
    members = checkpointed(members.unionByName(alone))
    named = _only(nodes, members.select("node"))
    # all that one component's lists hold, before any tile is made: an exact count for saturated components
    grown = checkpointed(members.join(saturated, "node", "left_semi").select("component").distinct())
    if grown.count():
        touching = _touching(named, members.join(grown, "component", "left_semi"), threshold)
        merged = checkpointed(connected_components(touching))
        members = _renamed(members, merged)
        grown = _renamed(grown.withColumn("node", F.col("component")), merged).select("component").distinct()
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).join(grown.withColumn("grown", F.lit(True)), "component", "left")
    kinds = checkpointed(members.join(sizes, "component").select("node", "component", "size", F.coalesce("grown", F.lit(False)).alias("grown")))
    small = _small_counts(named, kinds.where(F.col("size") <= TILE).select("node", "component"), threshold)
    tiled = _tile_counts(named, kinds.where((F.col("size") > TILE) & F.col("grown")).select("node", "component"), threshold)
    rest = checkpointed(kinds.where((F.col("size") > TILE) & ~F.col("grown")).select("node"))
    counts = small.unionByName(tiled)
    if rest.count():
        there = descend(named, links.join(rest.withColumnRenamed("node", "u"), "u", "left_semi"), threshold)
        counts = counts.unionByName(_both_ways(there).join(named.select(F.col("node").alias("v"), "n"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links")))
    return checkpointed(counts), members


def exact_counts(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``link_counts`` without a graph, over all pairs of tiles of each group."""
    all_nodes = nodes.select("node", F.col("grp").alias("component"))
    links = _tile_forest(nodes, all_nodes, threshold)
    return checkpointed(_tile_counts(nodes, all_nodes, threshold)), checkpointed(connected_components(links, "u", "v"))


def audit_recall(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD) -> float:
    """Links found of all links that AUDIT_NODES nodes (least by hash) have, by brute force; 1 if they have none.

    The sample is bounded, so it is collected and sent to all tasks.
    """
    picked = nodes.orderBy(F.xxhash64("node", F.lit(17)), "node").limit(AUDIT_NODES)
    sample = picked.join(counts, "node", "left").select("node", "grp", "vector", F.coalesce("links", F.lit(0)).alias("links")).collect()
    by_group: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g in {r.grp for r in sample}:
        own = [r for r in sample if r.grp == g]
        by_group[g] = np.array([r.node for r in own]), _matrix(pa.array([bytes(r.vector) for r in own], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), object)
            for g, (ids, x) in by_group.items():
                rows = np.nonzero(groups == g)[0]
                if len(rows):
                    y = _matrix(batch.column(3).take(pa.array(rows)))
                    hit = (y @ x.T >= threshold) & (batch.column(0).to_numpy()[rows][:, None] != ids[None, :])
                    total += int((hit * batch.column(2).to_numpy()[rows][:, None]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    there = nodes.select("node", "grp", "n", "vector").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    return sum(r.links for r in sample) / there if there else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall), one row per row of ``vectors``.

    ``audit_recall``: share of the audited nodes' links that were found, the same in every row; 1 after an exact pass.
    """
    nodes, rows = nodes_of(vectors, id_col, vector_col, label_col)
    found = None
    for attempt in range(MAX_ATTEMPTS):
        found = graph(nodes, threshold, attempt, found)
        counts, members = link_counts(nodes, *found, threshold)
        recall = audit_recall(nodes, counts, threshold)
        if recall >= MIN_RECALL:
            break
    else:
        (counts, members), recall = exact_counts(nodes, threshold), 1.0
    ids = nodes.select("node", "grp", "key", "n", "least")
    least = members.join(ids, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "component").select("node", "component_id")
    full = ids.join(counts, "node", "left").join(linked, "node", "left")
    full = full.select("grp", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    used = rows.where("grp is not null").join(full, ["grp", "key"]).select("vec_id", "n_links", "component_id")
    other = rows.where("grp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(other).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
