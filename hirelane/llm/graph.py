"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise, release


class Forest:
    """Union-find over hashable nodes; the smallest node is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Edges that one task joins at once; more are joined in rounds over all tasks.
ONE_TASK = 200_000
#: Nodes that a task remembers before it gives out what it has joined so far.
HELD = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges only a star for every component within it."""
    f = Forest()

    def stars() -> pa.RecordBatch:
        nodes = [x for x in f.up if f.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([f.find(x) for x in nodes], pa.int64())], ["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f.union(x, y)
        if len(f.up) > HELD:
            yield stars()
            f.up.clear()
    yield stars()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) of every node with an edge to another; edges has two long columns.

    Every task first reduces its edges to stars.  While more than ONE_TASK edges are left, large-star and small-star steps
    alternate: a node's neighbours are hung under the smallest one, which needs a minimum per node (combined before
    the shuffle) and a join, never a list of neighbours.  Every round is written to the shared folder.  component
    is the smallest node.  files: how many the first round is written to, if not one a task.
    """
    a, b = edges.columns[:2]
    kind = "u long, v long"
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).mapInArrow(_contract, kind)
    e, path = materialise(e.repartition(files) if files else e, "edges")
    before, now = None, (e.count(), None)
    while now != before:
        if now[0] <= ONE_TASK:
            new, fresh = materialise(e.coalesce(1).mapInArrow(_contract, kind), "edges")
            release(edges.sparkSession, path)
            return _named(new)
        new, fresh = materialise(_round(e), "edges")
        release(edges.sparkSession, path)
        e, path, before = new, fresh, now
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return _named(e)


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _round(e: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def spread(linked: np.ndarray, root: np.ndarray, i: int) -> list[int]:
    """Join i with the linked positions in root (an array of component numbers); returns one position of each component newly joined."""
    others, first = np.unique(root[linked], return_index=True)
    new = [int(linked[k]) for o, k in zip(others.tolist(), first.tolist(), strict=True) if o != root[i]]
    if new:
        root[np.isin(root, root[new])] = root[i]
    return new
