"""Approximate nearest neighbours by inner product: hierarchical k-means tree, best bin first.

Vectors get one more component, sqrt(M**2 - |x|**2) with M the largest norm, so the largest inner
product is the smallest distance.  The tree is fitted on a bounded sample (``SAMPLE`` rows) and every row is
put into a leaf.  A query walks the tree with a priority queue of nodes by distance to their
centroids, and so gets an order of leaves.  How many leaves it visits is calibrated: the exact
neighbours of ``CALIBRATE`` queries are found by a scan of all rows, and the visits are widened until their mean recall
reaches ``RECALL``.  Leaves and queries are joined by groups of neighbouring leaves, both sides in blocks of bounded
size; a group gives one packed row of k neighbours a query, and these are merged.

Unusable vectors (null, empty, zero, null or non-finite components) take no part; those of another length than
most have leaves of their own length.  An empty table gives no rows; other columns, whatever their names, are ignored.  Repeated rows are candidates of their own; a query never meets its own id and is searched once;
ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import materialise, release
from .vectors import matrix, usable

K = 20
SAMPLE, LEAF_ROWS, MOST_LEAVES, BRANCH = 60_000, 256, 8192, 8
CALIBRATE, RECALL = 200, 0.97
BLOCK_ROWS, BLOCK_QUERIES, SHARED_LEAVES = 4096, 8192, 16
#: Queries of a task that merges what their groups found.
MERGED_QUERIES = 512
SEED = 11


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most k centroids of the rows."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((c**2).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = total[n > 0] / n[n > 0, None]
    return c


class Tree:
    """Nodes with centroids; children are consecutive.  Leaves are numbered."""

    def __init__(self, x: np.ndarray, leaf_rows: float, most: int):
        rng = np.random.default_rng(SEED)
        self.centroid: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        todo = [(self._add(x.mean(0)), x)]
        while todo:
            node, rows = todo.pop(0)
            c = kmeans(rows, BRANCH, rng) if len(rows) > max(leaf_rows, BRANCH) and self.leaves + len(todo) + BRANCH <= most else rows[:1]
            near = ((c**2).sum(1)[None, :] - 2 * (rows @ c.T)).argmin(1)
            if len(c) < 2 or near.min() == near.max():
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            first = len(self.centroid)
            for i in range(len(c)):
                todo.append((self._add(c[i]), rows[near == i] if (near == i).any() else rows[:1]))
            self.children[node] = (first, first + len(c))
        self.c = np.array(self.centroid)
        self.sq = (self.c**2).sum(1)

    def _add(self, c: np.ndarray) -> int:
        self.centroid.append(c)
        self.children.append((0, 0))
        self.leaf.append(-1)
        return len(self.centroid) - 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            a, b = self.children[node]
            near = (self.sq[a:b][None, :] - 2 * (x[rows] @ self.c[a:b].T)).argmin(1)
            todo += [(a + i, rows[near == i]) for i in range(b - a)]
        return out

    def visit(self, q: np.ndarray, most: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """The first leaves in best-bin-first order; more of them while they hold fewer than `least` rows together."""
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < most or (rows is not None and held < least)):
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += rows.get(self.leaf[node], 0) if rows is not None else 0
                continue
            a, b = self.children[node]
            for i, d in enumerate((self.sq[a:b] - 2 * (self.c[a:b] @ q)).tolist()):
                heapq.heappush(heap, (d, a + i))
        return out


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query in a fixed order of summing, so equal rows score equally."""
    return (x * q).sum(axis=1)


def best(q: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k best rows, ties to the smaller id."""
    pool = np.flatnonzero(ids != qid)
    if len(pool) > k:
        cut = np.partition(rough[pool], len(pool) - k)[len(pool) - k]
        pool = pool[rough[pool] >= cut - 1e-9 * max(1.0, abs(cut))]
    s = scores(q, x[pool])
    order = np.lexsort((ids[pool], -s))[:k]
    return pool[order], s[order]


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, top * top - (x**2).sum(1)))[:, None]])


def search(df: DataFrame, every: int = 20, k: int = K, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    spark, vectors = df.sparkSession, df.schema[vector].dataType.simpleString()
    rows = df.select(df[key].cast("long").alias("vec_id"), df[vector].alias("embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = sorted((-r.n, r.dims, r.top) for r in rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy(F.desc("n")).limit(64).collect())
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dims, top = -sizes[0][0], sizes[0][1], float(sizes[0][2])
    main = rows.where(F.size("embedding") == dims)
    part = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(n))
    # The limits hold where one id repeats, whose rows share a hash; without repeats they cut nothing.
    sample = matrix(main.where(part < SAMPLE).select("embedding").limit(2 * SAMPLE).toPandas()["embedding"], dims)
    leaves = min(MOST_LEAVES, max(1, n // LEAF_ROWS))
    tree = Tree(_lift(sample, top), len(sample) / leaves, leaves + BRANCH) if len(sample) else Tree(np.zeros((1, dims + 1)), 1, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy(zero_copy_only=False)
            leaf = -size.astype(np.int64)
            mine = np.flatnonzero(size == dims)
            if len(mine):
                leaf[mine] = tree.assign(_lift(matrix(b.column(1).take(pa.array(mine)), dims), top))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], ["vec_id", "embedding", "leaf"])

    placed, p_leaves = materialise(rows.select("vec_id", "embedding", F.size("embedding").alias("dims")).mapInArrow(place, f"vec_id long, embedding {vectors}, leaf int"), "leaves")
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    nq = max(1, queries.count())
    tries = [(r.vec_id, np.array(r.embedding, np.float64)) for r in queries.where((F.col("leaf") >= 0) & (F.pmod(F.xxhash64("vec_id", F.lit(SEED + 1)), F.lit(nq)) < CALIBRATE)).select("vec_id", "embedding").limit(2 * CALIBRATE).collect()]
    visits = _calibrate(placed.where("leaf >= 0"), tree, tries, dims, k, recall)

    # Copies of a query's own id aren't candidates, so they don't count as rows of a leaf.
    ids = placed.groupBy("leaf").agg(F.count_distinct("vec_id").alias("n"))
    rows_of = {r.leaf: r.n for r in ids.where("leaf >= 0").collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group of neighbouring leaves that a query visits, with the leaves it visits there."""
        for b in batches:
            at, bucket, visited = [], [], []
            for i, (v, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if own < 0:
                    at, bucket, visited = [*at, i], [*bucket, own], [*visited, np.array([own], "<i4").tobytes()]
                    continue
                to = np.sort(np.array(tree.visit(np.append(np.array(v, np.float64), 0.0), visits, rows_of, k + 1), "<i4"))
                for g, lo, n in zip(*np.unique(to // SHARED_LEAVES, return_index=True, return_counts=True), strict=True):
                    at.append(i)
                    bucket.append(int(g))
                    visited.append(to[lo : lo + n].tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(bucket, pa.int32()), pa.array(visited, pa.binary())], ["vec_id", "embedding", "bucket", "visited"])

    routed, p_routes = materialise(queries.select("vec_id", "embedding", "leaf").mapInArrow(route, f"vec_id long, embedding {vectors}, bucket int, visited binary"), "routes")
    # Neighbouring leaves share a group, so a query gives k rows for all of them together.
    placed = placed.withColumn("bucket", F.when(F.col("leaf") < 0, F.col("leaf")).otherwise(F.floor(F.col("leaf") / SHARED_LEAVES).cast("int")))
    blocks = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rb")).join(routed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qb")), "bucket")

    def dealt(side: DataFrame, own: str, other: str, mine: str, theirs: str, leaf: Column, visited: Column) -> DataFrame:
        s = side.join(blocks, "bucket").withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(3)), own).cast("int"))
        return s.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("bucket", "r", "q", leaf.cast("int").alias("leaf"), visited.cast("binary").alias("visited"), "vec_id", "embedding")

    both = dealt(placed, "rb", "qb", "r", "q", F.col("leaf"), F.lit(None)).unionByName(dealt(routed, "qb", "rb", "q", "r", F.lit(None), F.col("visited")))

    def find(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """A row for each query: its k best of this group, packed."""
        asks = g["visited"].notna()
        q, x = g[asks].drop_duplicates("vec_id"), g[~asks]
        found: list[tuple] = []
        if len(q) and len(x):
            d = len(q["embedding"].iloc[0])
            xm, ids, leaf = matrix(x["embedding"], d), x["vec_id"].to_numpy(), x["leaf"].to_numpy(np.int64)
            qm = matrix(q["embedding"], d)
            rough = qm @ xm.T
            for i, (qid, visited) in enumerate(zip(q["vec_id"].tolist(), q["visited"], strict=True)):
                mine = np.flatnonzero(np.isin(leaf, np.frombuffer(visited, "<i4")))
                at, s = best(qm[i], qid, xm[mine], ids[mine], rough[i][mine], k)
                if len(at):
                    found.append((qid, ids[mine][at].astype("<i8").tobytes(), s.astype("<f8").tobytes()))
        return pd.DataFrame(found, columns=["query_id", "ids", "scores"]).astype({"query_id": "int64"})

    def merge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query out of what its groups found."""
        rows = []
        for qid, each in g.groupby("query_id"):
            ids, s = np.frombuffer(b"".join(each["ids"]), "<i8"), np.frombuffer(b"".join(each["scores"]), "<f8")
            order = np.lexsort((ids, -s))[:k]
            rows.append(pd.DataFrame({"query_id": qid, "rank": np.arange(1, len(order) + 1), "vec_id": ids[order], "score": s[order]}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=["query_id", "rank", "vec_id", "score"])

    hits = both.groupBy("bucket", "r", "q").applyInPandas(find, "query_id long, ids binary, scores binary")
    groups = F.pmod(F.xxhash64("query_id"), F.lit(-(-nq // MERGED_QUERIES)))
    out, _ = materialise(hits.groupBy(groups.alias("g")).applyInPandas(merge, "query_id long, rank int, vec_id long, score double"), "neighbours")
    release(spark, p_leaves, p_routes)
    return out


def _calibrate(placed: DataFrame, tree: Tree, tries: list, dims: int, k: int, recall: float) -> int:
    """Leaves to visit so that the tries' mean recall is reached; their exact neighbours come from a scan in batches."""
    if not tries or tree.leaves < 2:
        return max(1, tree.leaves)
    q = np.array([v for _, v in tries])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaf, x = b.column(0).to_numpy(), b.column(2).to_numpy(), matrix(b.column(1), dims)
            rough, rows = q @ x.T, []
            for i, (qid, v) in enumerate(tries):
                at, s = best(v, qid, x, ids, rough[i], k)
                rows += zip([i] * len(at), ids[at].tolist(), leaf[at].tolist(), s.tolist(), strict=True)
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int32(), pa.float64()], strict=True)], ["i", "vec_id", "leaf", "score"])

    near = placed.select("vec_id", "embedding", "leaf").mapInArrow(exact, "i int, vec_id long, leaf int, score double")
    w = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    truth: dict[int, list[int]] = {}
    for r in near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("i", "leaf").collect():
        truth.setdefault(r.i, []).append(r.leaf)
    need = []
    for i, (_, v) in enumerate(tries):
        order = {leaf: p for p, leaf in enumerate(tree.visit(np.append(v, 0.0), tree.leaves))}
        need += [(order[x] + 1, 1 / len(truth[i])) for x in truth.get(i, [])]
    need.sort()
    got, aim = 0.0, recall * len(truth)
    for visits, part in need:
        got += part
        if got >= aim - 1e-9:
            return visits
    return tree.leaves
