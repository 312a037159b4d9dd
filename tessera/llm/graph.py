"""Connected components of a graph of any size, by random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that one task contracts by itself.
FEW_EDGES = 100_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the edges, for each the least node of its component)."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):  # roots hook on to roots, so a path of any length takes few rounds
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, to = least_labels(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(to)], ["node", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node (long) of ``edges``; nodes of one component share a root. Edges of a node to itself are ignored.

    In each round every node looks at itself and its neighbours and points to the one with the smallest hash (salted by
    the round, so that long paths shrink by a constant factor); then edges are rewritten to what their ends point to,
    and those that join a node to itself vanish. Once ``few`` edges or less are left, by count, one task contracts them all. The pointers of all rounds
    are composed at the end. Hubs are no bottleneck: the choice is a minimum with partial aggregation, and the rewriting joins are plain inner joins whose
    large partitions Spark splits.
    """
    e = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").distinct())
    pointers: list[DataFrame] = []
    for k in range(max_rounds):
        left = e.count()
        if left <= few:
            if left or not pointers:
                pointers.append(e.coalesce(1).mapInArrow(_contract, "node bigint, to bigint"))
            break
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        p = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        p = cut(p.select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["v"].alias("to")))
        pointers.append(p)
        moved = e.join(p.select(F.col("node").alias("a"), F.col("to").alias("pa")), "a").join(p.select(F.col("node").alias("b"), F.col("to").alias("pb")), "b")
        e = cut(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct())
    else:
        raise RuntimeError(f"contraction did not end after {max_rounds} rounds")
    roots = cut(pointers[-1]).withColumnRenamed("to", "root")
    for p in reversed(pointers[:-1]):
        later = roots.withColumnRenamed("node", "to")
        roots = cut(p.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return roots
