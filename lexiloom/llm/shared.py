"""Plumbing that the operators of this subpackage share.

* scratch tables and checkpoints (``lexiloom.session``) in the folder that the cluster
  names in ``spark.checkpoint.dir``: all executors see it, so a lost one costs no data;
* contiguous groups out of sorted Arrow batches;
* connected components by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import checkpointed, shared_dir, written  # noqa: F401

#: The words of the contracts: runs of anything but space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows that follow each other with one value of ``key``.

    The batches must be sorted (or at least clustered) by ``key``. Memory: one
    group and one batch.
    """
    held: list[pa.RecordBatch] = []
    value: object = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_pylist()
        begin = 0
        for i in range(n):
            if held or i > begin:
                same = column[i] == value
            else:
                same = False
            if not same:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                    held = []
                begin, value = i, column[i]
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node that it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each a
    pre-aggregated minimum and an equality join, cut by a checkpoint; ends when
    the edges no longer change, in O(log^2 n) rounds. Self loops and nulls are
    ignored; no edges give no rows.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = checkpointed(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
