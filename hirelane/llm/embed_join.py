"""Exact near-duplicate join of embeddings by a metric range join.

Unit vectors turn cosine >= c into distance <= r with r = sqrt(2 - 2c).  Pivots divide the vectors
of a label into cells by the nearest pivot.  A vector at distance d from its own pivot is also a
member of every cell whose pivot is at most d + 2r away (the triangle inequality: no partner of a
vector of that cell can be missed), unless that cell's radius R shows that it can't have a partner
there (distance over R + r).  Every cell compares its own vectors with all its members, on its own; cells of many
rows are divided into blocks of own vectors by blocks of members.

Equal vectors of a label are one class with a count, so groups of copies are compared once.  A block returns the
number of linked vectors of each class and a spanning forest of the links, never the pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing and are their own component; vectors of different lengths don't link.  Every row is a vector, repeated
rows too.  A null id is never a component's name.  Labels are whole numbers of up to 64 bits.  An empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, spread
from .util import materialise
from .vectors import matrix, usable

COSINE = 0.93
#: Classes of a cell aimed at, pivots in all at most (larger cells are cut into blocks), rows of a block.
CELL, PIVOTS, OWN_ROWS, MEMBER_ROWS = 2000, 4096, 2048, 8192
_SLACK = 1e-9


def _pivots(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivots by (label, length), for groups of over CELL classes; at most about PIVOTS in all."""
    big = {(r.label, r.dims): r.n for r in classes.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > CELL).orderBy(F.desc("n")).limit(PIVOTS).collect()}
    if not big:
        return {}
    share = PIVOTS / max(PIVOTS, sum(n / CELL for n in big.values()))
    spark = classes.sparkSession
    rates = spark.createDataFrame([(k[0], k[1], float(min(1.0, share / CELL))) for k in big], "label long, dims int, rate double")
    chosen = classes.join(F.broadcast(rates), ["label", "dims"]).where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    out: dict = {}
    for r in chosen.select("label", "dims", "embedding").collect():
        v = np.array(r.embedding, np.float64)
        out.setdefault((r.label, r.dims), []).append(v / np.linalg.norm(v))
    return {k: np.array(v) for k, v in out.items()}


def _deal(classes: DataFrame, pivots: dict, radius: dict | None, r: float) -> DataFrame:
    """(cid, label, dims, weight, embedding, cell, own, near) of every class in each cell it belongs to; only the own cell if radius is None."""

    vectors = classes.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dims = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            at, cell, own, near = [], [], [], []
            group: dict = {}
            for i, k in enumerate(zip(label.tolist(), dims.tolist(), strict=True)):
                group.setdefault(k, []).append(i)
            for k, rows in group.items():
                rows = np.array(rows)
                if k not in pivots:
                    at.append(rows)
                    cell.append(np.zeros(len(rows), np.int64))
                    own.append(np.ones(len(rows), bool))
                    near.append(np.zeros(len(rows)))
                    continue
                p = pivots[k]
                v = matrix(b.column(4).take(pa.array(rows)), k[1])
                v /= np.linalg.norm(v, axis=1)[:, None]
                d = np.sqrt(np.maximum(0, 2 - 2 * (v @ p.T)))
                home = d.argmin(axis=1)
                mine = np.zeros(d.shape, bool)
                mine[np.arange(len(rows)), home] = True
                member = mine if radius is None else mine | ((d <= d.min(axis=1)[:, None] + 2 * r + _SLACK) & (d <= radius[k][None, :] + r + _SLACK))
                x, y = np.nonzero(member)
                at.append(rows[x])
                cell.append(y)
                own.append(mine[x, y])
                near.append(d[x, y])
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(5)] + [pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(own)), pa.array(np.concatenate(near))], ["cid", "label", "dims", "weight", "embedding", "cell", "own", "near"])

    return classes.select("cid", "label", "dims", "weight", "embedding").mapInArrow(run, f"cid long, label long, dims int, weight long, embedding {vectors}, cell int, own boolean, near double")


def _compare(cosine: float):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cid", kind="stable")
        own, member = g[g["as_own"]], g[~g["as_own"]]
        dims = int(key[1])
        a, b = matrix(own["embedding"], dims), matrix(member["embedding"], dims)
        a /= np.linalg.norm(a, axis=1)[:, None]
        b /= np.linalg.norm(b, axis=1)[:, None]
        ida, idb, weight = own["cid"].to_numpy(), member["cid"].to_numpy(), member["weight"].to_numpy()
        # Own rows that are members of the block too are one node.
        every, number = np.unique(np.concatenate([ida, idb]), return_inverse=True)
        na, nb = number[: len(ida)], number[len(ida) :]
        root = np.arange(len(every))
        out_a, out_b, out_n = [], [], []
        for at in range(0, len(a), 512):
            linked = a[at : at + 512] @ b.T >= cosine
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                js = np.flatnonzero(linked[i])
                js = js[idb[js] != ida[at + i]]
                if len(js):
                    out_a.append(ida[at + i])
                    out_b.append(None)
                    out_n.append(int(weight[js].sum()))
                    for x in spread(nb[js], root, int(na[at + i])):
                        out_a.append(ida[at + i])
                        out_b.append(every[x])
                        out_n.append(0)
        return pd.DataFrame({"a": pd.array(out_a, "Int64"), "b": pd.array(out_b, "Int64"), "n": pd.array(out_n, "Int64")})

    return run


def join(df: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    r = float(np.sqrt(2 - 2 * cosine))
    rows = df.select(df[key].cast("long").alias("vec_id"), df[label].cast("long").alias("label"), df[vector].alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull()).withColumn("cid", F.when(F.col("ok"), F.xxhash64("label", "embedding")))
    classes = rows.where("ok").groupBy("cid", "label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first")).withColumn("dims", F.size("embedding"))
    classes, _ = materialise(classes, "classes")
    pivots = _pivots(classes)
    radius: dict = {k: np.full(len(p), -1.0) for k, p in pivots.items()}
    if pivots:
        for x in _deal(classes, pivots, None, r).groupBy("label", "dims", "cell").agg(F.max("near").alias("far")).collect():
            if (x.label, x.dims) in radius:
                radius[x.label, x.dims][x.cell] = x.far
    dealt, _ = materialise(_deal(classes, pivots, radius, r), "cells")
    # Blocks of a cell follow from its size.
    sizes = dealt.groupBy("label", "dims", "cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / OWN_ROWS).cast("int").alias("hb"), F.ceil(F.count("*") / MEMBER_ROWS).cast("int").alias("mb")).where("hb > 0")
    placed = dealt.join(sizes, ["label", "dims", "cell"])
    mine = placed.where("own").withColumn("h", F.pmod(F.xxhash64("cid", F.lit(1)), "hb").cast("long")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("as_own", F.lit(True))
    theirs = placed.withColumn("m", F.pmod(F.xxhash64("cid", F.lit(2)), "mb").cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hb").cast("long") - 1))).withColumn("as_own", F.lit(False))
    cols = ["label", "dims", "cell", "h", "m", "as_own", "cid", "weight", "embedding"]
    found, _ = materialise(mine.select(cols).unionByName(theirs.select(cols)).groupBy("label", "dims", "cell", "h", "m").applyInPandas(_compare(cosine), "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    comps = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("cid"), "component")
    named = classes.select("cid", "weight", "first").join(comps, "cid", "left").join(links, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("cid", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
