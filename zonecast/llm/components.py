"""Connected components by alternating star contraction, with a local contraction of each partition between the rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.llm.shared import Scratch, join_by_key

#: Edges that a task holds before it contracts them.
HELD_EDGES = 500_000


def _led(edges: DataFrame, least: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v), each with the node m that u leads to; a node of very many edges fills no task."""
    known = scratch.table(least.withColumnRenamed("u", "own"))
    return join_by_key(edges, known, {"u": "own"}, "n").drop("own", "n")


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _led(both.where("v > u"), least, scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges hold u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _led(edges, least, scratch).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").union(least.select("u", F.col("m").alias("v")))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the same components in which every node but the least leads to the least."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two, label = both[: len(u)], both[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        for side in (one, two):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges to stars; what is held grows only with its nodes, and is sent on where it stays large."""
    u = v = np.empty(0, np.int64)

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        u, v = np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
        if len(u) > HELD_EDGES:
            u, v = stars(u, v)
            if len(u) > HELD_EDGES // 2:
                yield sent()
                u = v = np.empty(0, np.int64)
    u, v = stars(u, v)
    yield sent()


def _contracted(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges in partitions of a good size, few where they are few, each contracted."""
    return scratch.table(edges.hint("rebalance").mapInArrow(_contract, "u long, v long"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node leads to one other at most, and no node that others lead to leads on."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(0).alias("led")).union(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("led"))
    )
    per = ends.groupBy("node").agg(F.min("to").alias("a"), F.max("to").alias("b"), F.max("led").alias("led"))
    return per.where("a != b or (led = 1 and a is not null)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(u, v) long pairs in, (node, component) out for every node of an edge; component is the least node reachable.

    Each round is written to the shared folder, so a lost executor costs one round. Loops are ignored; an empty table
    gives an empty result. The number of rounds grows with the logarithm of the longest path; edges that fit a
    partition take none.
    """
    plain = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    now = _contracted(plain, scratch)
    for _ in range(max_rounds):
        if _settled(now):
            break
        new = _contracted(_small_star(_large_star(now, scratch), scratch), scratch)
        scratch.drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    led = now.distinct()
    roots = led.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return led.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
