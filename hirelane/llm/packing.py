"""Sum-of-squares packing of token sequences.

``pieces`` cuts documents, ``pack`` puts the pieces into sequences.  The heuristic keeps N(g), the
number of open sequences with g places left, and puts each piece where the sum of N(g)**2 becomes
smallest: into an open sequence with gap g (N(g) falls, N(g - length) rises), or into a new one.

Pieces are dealt to shards of about ``SHARD`` rows by a hash of their key, and every shard packs
on its own.  Sequences that are full to within ``CLOSED`` places are final; the pieces of all others are
dealt again to fewer shards, until one shard of bounded size takes the rest.  So no task ever holds
more than a shard, and the waste of many shards isn't added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise
from .wordtok import word_table

CAPACITY = 2048
END_ID = 0
#: Rows packed by one task, and places that a final sequence may leave free before the last round.
SHARD = 6000
CLOSED = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document's ids plus end_id.

    A null or empty text is one piece that holds end_id alone.  Only documents over the capacity are cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end, size = word_table(path), np.uint32(end_id).tobytes(), 4 * capacity
        for b in batches:
            keys = b.column(0).to_pylist()
            rows: list[tuple] = []
            for i, raw in table.encode_all(b.column(1).to_pylist()):
                raw += end
                for k, at in enumerate(range(0, len(raw), size)):
                    part = raw[at : at + size]
                    rows.append((keys[i], k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(df[key].cast("long"), df[text]).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the gap left in each bin.  Longest first; equal costs go to the smallest gap."""
    count = np.zeros(capacity + 1, np.float64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    cost = np.empty(capacity + 1, np.float64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        part = cost[s : capacity + 1]
        # A full bin has gap 0, which isn't counted; so a perfect fit costs half a step less.
        np.subtract(count[: capacity + 1 - s], count[s:], out=part)
        part[0] = -count[s] - 0.5
        part[count[s:] == 0] = np.inf
        fresh = count[capacity - s] if s < capacity else -0.5
        best = int(np.argmin(part))
        if part[best] <= fresh - 0.5:
            g = s + best
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            b, g = len(gaps), capacity
            gaps.append(capacity)
        where[i], offset[i] = b, capacity - g
        gaps[b] = g - s
        if g > s:
            count[g - s] += 1
            open_bins[g - s].append(b)
    return where, offset, np.array(gaps, np.int64)


def _shard(capacity: int, first: int, last: bool):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        where, offset, gaps = sum_of_squares(g["length"].to_numpy(), capacity)
        # first + key numbers the shards of all rounds; the sequences of one differ in the bits above.
        g["sequence_id"] = (where << 40) + first + int(key[0])
        g["offset"] = offset
        g["final"] = last | (gaps[where] <= CLOSED)
        return g.drop(columns="shard")

    return run


def pack(df: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """df of PIECES with sequence_id and offset.

    Lengths must lie between 1 and the capacity.  Repeated rows are pieces of their own; a null doc_id
    is packed like any other.  An empty table gives an empty result.  A round that leaves over 0.9 of its pieces open ends the
    work; its sequences stay as they are.
    """
    spark = df.sparkSession
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean"
    left, _ = materialise(df, "pieces")
    whole = F.col("length") == capacity
    done: list[DataFrame] = [left.where(whole).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    todo, level, first = left.where(~whole), 0, 0
    n = todo.count()
    while n:
        shards = -(-n // shard)
        last = shards == 1

        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(shards)))
        packed, _ = materialise(dealt.groupBy("shard").applyInPandas(_shard(capacity, first, last), out), "packed")
        done.append(packed.where("final").drop("final"))
        todo = packed.where("not final").select(df.columns)
        first += shards
        level, before, n = level + 1, n, 0 if last else todo.count()
        if n > 0.9 * before:  # nothing more to win: lengths that don't complement each other
            done[-1] = packed.drop("final")
            n = 0
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result
