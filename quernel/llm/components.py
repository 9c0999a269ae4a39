"""Connected components of edge tables, in Spark: rounds of contraction, no collecting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut, drop, ship


#: Edges that a task joins at once before it deals them out.
HELD = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges u - v connect: one less than nodes a component, each to its least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def thinned(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes, without those that a task's other edges make needless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out():
            if held:
                u, v = forest(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= HELD:
                yield from out()
                size = 0
        yield from out()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that an edge touches; nodes have equal labels if edges connect them.

    First every task joins its own edges, so that a component that one task holds is a star. In each round every
    node moves onto that neighbour (or itself) whose hash is least; edges then join the nodes moved to. A star is done in two rounds; on long chains the hashes make the number of nodes fall by
    a constant factor in expectation. Loops and repeated edges are harmless; without edges the result is
    empty. Each round's edges and moves are written to the shared folder and removed at the end. Joins are never
    broadcast, so that the driver holds nothing of the graph.
    """
    ship(edges.sparkSession)
    edges = cut(thinned(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")).distinct())
    rank = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("to"))
    moves = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        moved = cut(both.groupBy("u").agg(F.min(rank("v")).alias("least")).select(F.col("u").alias("node"), F.least(F.col("least"), rank("u"))["to"].alias("to")))
        moves.append(moved)
        x, y = moved.select(F.col("node").alias("u"), F.col("to").alias("x")), moved.select(F.col("node").alias("v"), F.col("to").alias("y"))
        before, edges = edges, cut(edges.join(x.hint("merge"), "u").join(y.hint("merge"), "v").where("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        drop(before)
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = moves[0].select("node", F.col("to").alias("label"))
    for moved in moves[1:]:
        step = moved.select(F.col("node").alias("label"), "to")
        labels = labels.join(step.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = cut(labels)
    drop(edges, *moves)
    return out
