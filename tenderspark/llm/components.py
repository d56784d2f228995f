"""Connected components of an edge table, as alternating star contractions on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges, of 16 bytes, up to which one task joins them; a round then costs more than the whole work.
ONE_TASK_EDGES = 2_000_000


def least_of_trees(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), and the smallest node that each hangs together with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        some = low != high
        if not some.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[some], low[some])
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            node, component = least_of_trees(t.column(0).to_numpy(), t.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], names=["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 50, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """From edges (a, b) of long ids, one row (node, component) per node with an edge; component: its smallest node.

    Large star: each node's larger neighbours are hung on its smallest neighbour; small star: so are the smaller ones
    and itself. Both keep the components and end, in about log2(longest path) rounds, when every node hangs on its
    component's smallest. Each round is a partial minimum and a join, written to the checkpoint folder. Once counted to
    be at most `one_task` edges, they are joined by a single task instead, with the same result.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _fingerprint(now)
    if mark[0] <= one_task:
        return _in_one_task(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialise(small)
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union by smaller root over 0..n-1, for the members that one task holds."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, hub: int, others: np.ndarray) -> None:
        """Put the hub and others, with all that hang together with them, into one tree."""
        roots = np.unique(self.root[np.append(others, hub)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def link_by_hubs(n: int, linked_with, forest: Forest | None = None) -> Forest:
    """The components of n members by comparing as few pairs as their shape allows, yet missing none.

    linked_with(hub, others) gives which of `others` are linked with the hub. A member that has been a hub has met all
    outside its tree. Hubs come from the smallest tree that has members left; when all trees but one are used up, any
    two members of different trees have been compared.
    """
    forest = forest or Forest(n)
    left = np.ones(n, bool)
    while True:
        size = np.bincount(forest.root, minlength=n)
        open_ = np.bincount(forest.root[left], minlength=n)
        roots = np.flatnonzero(open_)
        if len(roots) <= 1:
            return forest
        pick = roots[np.argmin(size[roots])]
        hub = int(np.flatnonzero(left & (forest.root == pick))[0])
        left[hub] = False
        others = np.flatnonzero(forest.root != forest.root[hub])
        found = others[linked_with(hub, others)]
        if len(found):
            forest.join(hub, found)
