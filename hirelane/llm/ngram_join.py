"""Exact word-n-gram Jaccard join by T-occurrence search.

Documents with equal shingle sets are one class.  A partner of a set of n shingles shares at least
T = ceil(0.8 n) of them, so:

1. ``_first_filter``: every document sends the smallest n - T + k hashes of its set (k = n/20 + 1) to buckets of the hash space;
   partners share k of them.  A bucket returns how many of a document's hashes occur in other sets too; documents with fewer
   than the least possible k drop out.  All documents take part in the count.
2. ``_rare``: the whole sets of those left are counted the same way; a document needs T shared hashes.  The counts
   also order its hashes from rare to common: partners share one of the n - T + 1 rarest, so the components of
   "has a rare hash in common" hold all links.
3. ``_links``: a component's documents are dealt to blocks.  Within a block a document searches the earlier ones for T occurrences as
   DivideSkip does: its short inverted lists are merged by a heap, its long lists are only probed by binary
   search for the candidates of the merge.  Documents that are already known to be connected aren't probed.
4. Some documents of a component of several blocks, its pivots, take part in each of them, so most blocks are connected by
   now.  Every document outside its component's largest part is searched for in each block that holds one of its rare
   hashes.

To count, a hash goes to its bucket with its low 32 bits, so a bucket may take two hashes for one: a count is then too high and
a document too many is left, never one too few, and step 3 compares all 64 bits.  The texts and names that steps 1 and 2 need from
all documents are told by bit sets of bounded size, which may say yes too often; what follows is exact.

Nothing is sampled and no list is cut.  Null, empty and blank texts have no shingles and link with nothing; a very long text
is one set like any other.  Repeated rows are documents of their own; a null id names no component.  An empty table gives
no rows; other columns, whatever their names, are ignored.  Hashes and the names of sets have 64 bits.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graph import Forest, components
from .shingles import WORDS, set_digest, shingle_sets
from .util import fan_out, materialise, release

SIMILARITY = (80, 100)
#: Documents of a packed batch, and of a block of a large component.
BATCH, BLOCK = 250, 500
#: Hashes of a packed row, more only if one set has more.
ROW_HASHES = 1 << 14
#: Rows of a file of few numbers.
ROWS_A_FILE = 1_000_000
#: Documents of a component that take part in each of its blocks.
PIVOTS = 8
#: Hashes that a bucket counts at once.
BUCKET_HASHES = 1 << 22
#: Documents of a batch of step 1 (at most 65,536), and hashes after which it ends; the more, the fewer bytes of a row are no hashes.
DEAL_DOCS, DEAL_HASHES = 1000, 1 << 17
#: Bits of a bit set at most; a fuller one lets more through.
MOST_BITS = 1 << 25
#: A class that has copies, by its place in a batch.
COPIED = np.dtype([("own", "<u2"), ("cls", "<i8")])
#: The cost of probing a list against merging it, as DivideSkip's authors found it.
MU = 0.0085
SETS = "batch long, classes binary, sizes binary, hashes binary"


def least_overlap(n: int) -> int:
    """T of a set of n."""
    return -(-SIMILARITY[0] * n // SIMILARITY[1])


def linked(a: int, b: int, both: int) -> bool:
    return SIMILARITY[1] * both >= SIMILARITY[0] * (a + b - both)


def _class(s: np.ndarray) -> int:
    return int.from_bytes(set_digest(s)[:8], "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that keep a worker's memory small."""
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            yield b.slice(lo, BATCH)


def _digests(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, cls) of every row; cls names the set, null if it's empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "cls"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls long")


def _requests(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its hashes in order)."""
    # Another mix than the one that orders a set, whose smallest hashes would all fall into the lowest buckets.
    bucket = (((hashes * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for k in range(buckets):
        if at[k] < at[k + 1]:
            yield k, order[at[k] : at[k + 1]]


def _slot(hash: Column, bits: int) -> Column:
    return hash.bitwiseAND(F.lit(bits - 1)).alias("slot")


def _bit_set(slots: DataFrame) -> DataFrame:
    """(word, bits) of (slot)."""
    return slots.selectExpr("slot >> 6 as word", "1L << cast(slot & 63 as int) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _bits_for(rows: int) -> int:
    """Bits of a bit set for some of so many rows, a power of two."""
    return min(MOST_BITS, max(1 << 10, 1 << (4 * rows).bit_length()))


def _copied(per_class: DataFrame, bits: int) -> np.ndarray:
    """The bit set of classes with copies."""
    table = _bit_set(per_class.where("copies > 1").select(_slot(F.col("cls"), bits))).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return words


def _first_filter(docs: DataFrame, words: int, buckets: int, copied: np.ndarray) -> DataFrame:
    """Classes that pass step 1.

    A batch's names and sizes go with its first row alone, so that a hash takes as many bytes with many buckets as with few; only
    classes that may have copies elsewhere are named wherever they send hashes.
    """
    spread = "bucket int, batch long, h binary, owner binary, copied binary, classes binary, sizes binary"
    back = "batch long, own binary, times binary, classes binary, sizes binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_batch = TaskContext.get().partitionId() << 32
        parts: dict[int, np.ndarray] = {}
        n: list[int] = []
        sent = 0

        def rows() -> pa.RecordBatch:
            cls, size = np.array(list(parts)), [len(x) for x in parts.values()]
            several = (copied[(cls & (64 * len(copied) - 1)) >> 6] >> (cls & 63)) & 1 == 1
            owner, h = np.repeat(np.arange(len(size)), size), np.concatenate(list(parts.values()))
            out, head = [], [cls.astype("<i8").tobytes(), np.array(n, "<i4").tobytes()]
            for k, at in _requests(h, buckets):
                own = np.unique(owner[at])
                own = own[several[own]]
                named = np.empty(len(own), COPIED)
                named["own"], named["cls"] = own, cls[own]
                out.append((k, at_batch, h[at].astype("<u4").tobytes(), owner[at].astype("<u2").tobytes(), named.tobytes(), *head))
                head = [None, None]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], ["bucket", "batch", "h", "owner", "copied", "classes", "sizes"])

        for b in _slices(batches):
            for s in shingle_sets(b.column(0).to_pylist(), words):
                # Copies of a class send their hashes once a batch.
                if not len(s) or (cls := _class(s)) in parts:
                    continue
                parts[cls] = s[: min(len(s), len(s) - least_overlap(len(s)) + len(s) // 20 + 1)].copy()
                n.append(len(s))
                sent += len(parts[cls])
                if len(n) >= DEAL_DOCS or sent >= DEAL_HASHES:
                    yield rows()
                    at_batch += 1
                    parts.clear()
                    n.clear()
                    sent = 0
        if n:
            yield rows()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch: how many hashes of each class occur in another class too."""
        rows = [r for g in batches for r in g.to_pylist()]
        owners = [np.frombuffer(r["owner"], "<u2") for r in rows]
        named = [np.frombuffer(r["copied"], COPIED) for r in rows]
        h = np.concatenate([np.frombuffer(r["h"], "<u4") for r in rows])
        # A class without copies is in one batch; the others are told by their names.
        _, number = np.unique(np.concatenate([x["cls"] for x in named]), return_inverse=True)
        c, at = [], 0
        for i, (own, x) in enumerate(zip(owners, named, strict=True)):
            ids = np.arange(DEAL_DOCS) + (i << 16)
            ids[x["own"]] = -1 - number[at : at + len(x)]
            c.append(ids[own])
            at += len(x)
        c = np.concatenate(c)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
        c = c[order]
        # Hashes of one class alone are copies of one set.
        both = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
        shared = np.empty(len(h), bool)
        shared[order] = np.repeat(both, np.diff(start, append=len(h)))
        at, out = 0, []
        for r, own in zip(rows, owners, strict=True):
            own, times = np.unique(own[shared[at : at + len(own)]], return_counts=True)
            at += len(r["owner"]) // 2
            if len(own) or r["classes"] is not None:
                out.append((r["batch"], own.astype("<u2").tobytes(), times.astype("<i4").tobytes(), r["classes"], r["sizes"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)], ["batch", "own", "times", "classes", "sizes"])

    def passing(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of a batch that have k shared hashes or more."""
        rows = [r for g in batches for r in g.to_pylist()]
        head = next(r for r in rows if r["classes"] is not None)
        cls, n = np.frombuffer(head["classes"], "<i8"), np.frombuffer(head["sizes"], "<i4").astype(np.int64)
        own, times = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in (("own", "<u2"), ("times", "<i4")))
        times = np.bincount(own, times, minlength=len(cls))
        # k of a partner with at least 0.8 n shingles, and of this set itself; a set too small to have k hashes sends them all.
        yield pa.RecordBatch.from_arrays([pa.array(cls[times >= np.minimum(n * 4 // 5 // 20 + 1, n)])], ["cls"])

    counted = docs.select("text").mapInArrow(deal, spread).groupBy("bucket").applyInArrow(count, back)
    return counted.groupBy("batch").applyInArrow(passing, "cls long").distinct()


def _named_texts(docs: DataFrame, words: int) -> DataFrame:
    """(cls, text) of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column(0).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) if len(s) else None for s in sets], pa.int64()), b.column(0)], ["cls", "text"])

    return docs.select("text").mapInArrow(run, "cls long, text string")


def _texts_of(docs: DataFrame, one: DataFrame, bits: int) -> DataFrame:
    """docs with the columns of their row in one (cls, its).

    Most other texts are left out by a bit set before they would be shuffled.
    """
    known = _bit_set(one.where("its is not null").select(_slot(F.xxhash64("its"), bits)))
    slots = docs.where("doc_id is not null").select("doc_id", "text", _slot(F.xxhash64("doc_id"), bits))
    may = slots.withColumn("word", F.expr("slot >> 6")).join(F.broadcast(known), "word").where("getbit(bits, cast(slot & 63 as int)) = 1")
    return may.select("doc_id", "text").join(one.hint("shuffle_hash"), F.col("doc_id") == F.col("its"))


def _pack_sets(docs: DataFrame, words: int) -> DataFrame:
    """SETS of (cls, text), whole sets in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for b in _slices(batches):
            cls, sets = b.column(0).to_numpy(), shingle_sets(b.column(1).to_pylist(), words)
            mine = [i for i, s in enumerate(sets) if _class(s) == cls[i]]
            # Rows of moderate size, which the JVM handles best.
            parts = np.cumsum([len(sets[i]) for i in mine]) // ROW_HASHES
            for k in np.unique(parts).tolist():
                own = [i for i, p in zip(mine, parts.tolist(), strict=True) if p == k]
                row = [at, cls[own].tobytes(), np.array([len(sets[i]) for i in own], "<i4").tobytes(), np.concatenate([sets[i] for i in own]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["batch", "classes", "sizes", "hashes"])
                at += 1

    return docs.select("cls", "text").mapInArrow(run, SETS)


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["classes"], np.int64), np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["hashes"], np.uint64)


def _rare(sets: DataFrame, buckets: int) -> DataFrame:
    """(cls, s, rare): step 2; each class with T shared hashes, its set and those of its rarest that are shared."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                cls, size, h = _unpack(r)
                rows = [(k, r["batch"], h[at].astype("<u4").tobytes()) for k, at in _requests(h, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary()], strict=True)], ["bucket", "batch", "h"])

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["batch"], np.frombuffer(r["h"], "<u4")) for g in batches for r in g.to_pylist()]
        h = np.concatenate([x for _, x in rows])
        _, where, times = np.unique(h, return_inverse=True, return_counts=True)
        times, at, out = np.minimum(times, 65535).astype("<u2")[where], 0, []
        for _, x in rows:
            out.append(times[at : at + len(x)].tobytes())
            at += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(out, pa.binary())], ["batch", "bucket", "times"])

    def choose(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.to_dict("records"):
            cls, size, h = _unpack(r)
            times = np.zeros(len(h), np.int64)
            came = dict(zip(right["bucket"], right["times"], strict=True))
            for k, at in _requests(h, buckets):
                times[at] = np.frombuffer(came[k], "<u2")
            for c, a, b in zip(cls.tolist(), (np.cumsum(size) - size).tolist(), np.cumsum(size).tolist(), strict=True):
                s, t = h[a:b], times[a:b]
                need = least_overlap(b - a)
                if (t > 1).sum() >= need:
                    first = np.lexsort((s, t))[: b - a - need + 1]
                    first = first[t[first] > 1]
                    if len(first):
                        out.append((c, s.tobytes(), s[first].view(np.int64)))
        return pd.DataFrame(out, columns=["cls", "s", "rare"])

    counted = sets.mapInArrow(deal, "bucket int, batch long, h binary").groupBy("bucket").applyInArrow(count, "batch long, bucket int, times binary")
    return sets.groupBy("batch").cogroup(counted.groupBy("batch")).applyInPandas(choose, "cls long, s binary, rare array<long>")


class TOccurrence:
    """Sets so far, as inverted lists of ascending positions; finds those with enough shingles in common."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.lists: dict[int, list[int]] = {}

    def search(self, s: np.ndarray, skip: Callable[[int], bool] = lambda i: False) -> Iterator[int]:
        """Positions of earlier sets that link with s, by DivideSkip."""
        need = least_overlap(len(s))
        lists = sorted((x for x in map(self.lists.get, s.tolist()) if x), key=len)
        if len(lists) < need:
            return
        # The longer the longest list, the fewer are set aside; a set in `need` lists is in need - aside of the others.
        aside = min(need - 1, int(need / (MU * math.log2(len(lists[-1])) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        last, times = -1, 0
        for i in [*short[0], 1 << 62] if len(short) == 1 else _ended(heapq.merge(*short)):
            if i == last:
                times += 1
                continue
            if last >= 0 and times >= need - aside and not skip(last) and self._probe(len(s), last, times, long):
                yield last
            last, times = i, 1

    def _probe(self, n: int, i: int, times: int, long: list[list[int]]) -> bool:
        """Whether set i, in `times` short lists, is in enough long ones."""
        need = -(-SIMILARITY[0] * (n + self.sizes[i]) // (SIMILARITY[0] + SIMILARITY[1]))
        for left, x in zip(range(len(long), 0, -1), long, strict=True):
            if times >= need or times + left < need:
                break
            at = bisect_left(x, i)
            times += at < len(x) and x[at] == i
        return times >= need

    def add(self, s: np.ndarray) -> None:
        i = len(self.sizes)
        self.sizes.append(len(s))
        for x in s.tolist():
            self.lists.setdefault(x, []).append(i)


def _ended(positions: Iterator[int]) -> Iterator[int]:
    yield from positions
    yield 1 << 62


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for g in batches:
        for r in g.to_pylist():
            yield r | {"s": np.frombuffer(r["s"], np.uint64)}


def _by_comp(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Each component's rows, small sets first."""
    comps: dict[int, dict[int, dict]] = {}
    for r in _rows(batches):
        docs = comps.setdefault(r["comp"], {})
        if r.get("again") or r["cls"] not in docs:
            docs[r["cls"]] = r
    for docs in comps.values():
        yield sorted(docs.values(), key=lambda r: (len(r["s"]), r["cls"]))


def _within(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that join different parts of a block; and as (a, null, s) the sets that step 4 needs again."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.binary())])
    for docs in _by_comp(batches):
        a, b = [], []
        forest, index, names = Forest(), TOccurrence(), []
        parts = 0  # of those added so far
        for r in docs:
            cls, joined = r["cls"], 0
            for i in index.search(r["s"], lambda i, cls=cls: forest.find(names[i]) == forest.find(cls)):
                forest.union(names[i], cls)
                a.append(cls)
                b.append(names[i])
                joined += 1
                if joined == parts:  # connected with all of them
                    break
            parts += 1 - joined
            index.add(r["s"])
            names.append(cls)
        kept = [r for r in docs if r["again"]]
        rows = [[*a, *(r["cls"] for r in kept)], [*b, *[None] * len(kept)], [*[None] * len(a), *(r["s"].tobytes() for r in kept)]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, kind, strict=True)], schema=kind)


def _across(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the asking documents and a block's that join different parts."""
    forest, index, names, asks = Forest(), TOccurrence(), [], []
    for r in _rows(batches):
        forest.union(r["cls"], r["part"])
        if r["asks"]:
            asks.append(r)
        else:
            index.add(r["s"])
            names.append(r["cls"])
    a, b = [], []
    for r in asks:
        cls = r["cls"]
        for i in index.search(r["s"], lambda i, cls=cls: forest.find(names[i]) == forest.find(cls)):
            forest.union(names[i], cls)
            a.append(cls)
            b.append(names[i])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _count_within(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, documents of other classes that link with it) in components of one block."""
    found: dict[int, int] = {}
    for docs in _by_comp(batches):
        index = TOccurrence()
        for r in docs:
            for i in index.search(r["s"]):
                found[r["cls"]] = found.get(r["cls"], 0) + docs[i]["copies"]
                found[docs[i]["cls"]] = found.get(docs[i]["cls"], 0) + r["copies"]
            index.add(r["s"])
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["cls", "n"])


def _count_across(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, documents of a block that link with it) of the asking documents."""
    index, of, asks = TOccurrence(), [], []
    for r in _rows(batches):
        if r["asks"]:
            asks.append(r)
        else:
            index.add(r["s"])
            of.append((r["cls"], r["copies"]))
    n = [sum(of[i][1] for i in index.search(r["s"], lambda i, cls=r["cls"]: of[i][0] == cls)) for r in asks]
    yield pa.RecordBatch.from_arrays([pa.array([r["cls"] for r in asks], pa.int64()), pa.array(n, pa.int64())], ["cls", "n"])


def _blocks(comps: DataFrame, rows: int) -> DataFrame:
    """comps (cls, comp) of so many rows with the number of their component's blocks, their own, and `pair`, which names a task's group: a block, or several components of one block."""
    n = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    few = F.pmod(F.xxhash64("comp"), F.lit(-(-rows // BLOCK) or 1))
    blocked = comps.join(n, "comp").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    return blocked.withColumn("pair", F.when(F.col("blocks") == 1, few).otherwise(F.xxhash64("comp", "block")))


def _meet(each: DataFrame, blocked: DataFrame, asking: Column, rare: DataFrame, files: int, *more: str) -> DataFrame:
    """(pair, asks, cls, s) and more columns: every block with the asking documents that have a rare hash in common with it.

    The asking documents of a block are dealt to as many groups as keep them bounded; its own go to each.
    """
    hashes = blocked.select("cls", "comp", "block", asking.alias("asks")).join(rare, "cls")
    at = hashes.select("h", "comp", "block").distinct()
    asks = hashes.where("asks").select("cls", "h", "comp").join(at, ["h", "comp"]).select("cls", "comp", "block").distinct()
    asks, _ = materialise(asks.coalesce(files), "asks")
    chunks = asks.groupBy("comp", "block").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("chunks"))
    asks = asks.join(chunks, ["comp", "block"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks").cast("int"))
    asks = asks.join(blocked.select("cls", *more), "cls").withColumn("asks", F.lit(True))
    own = blocked.join(chunks, ["comp", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
    cols = [F.xxhash64("comp", "block", "chunk").alias("pair"), "asks", "cls", *more]
    return asks.select(cols).unionByName(own.select(cols)).join(each, "cls")


def _links(each: DataFrame, comps: DataFrame, rare: DataFrame) -> DataFrame:
    """Steps 3 and 4, written: (a, b), enough links to connect all documents that are connected."""
    spark = each.sparkSession
    n = comps.count()
    blocked = _blocks(comps, n)
    large = blocked.where("blocks > 1")
    # The pivots of a component take part in each of its blocks.
    pivots = large.groupBy("comp", "blocks", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(PIVOTS))).agg(F.min("cls").alias("cls"))
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("comp", "block").alias("pair"), "comp", "cls", F.lit(False).alias("again"))
    dealt = blocked.select("pair", "comp", "cls", (F.col("blocks") > 1).alias("again")).unionByName(pivots).join(each, "cls")
    found, _ = materialise(dealt.groupBy("pair").applyInArrow(_within, "a long, b long, s binary"), "links")
    links = found.where("s is null").select("a", "b")
    if large.isEmpty():
        return links
    # Parts of the large components by the links so far.
    of = components(links).select(F.col("node").alias("cls"), F.col("component").alias("part"))
    parts, p_parts = materialise(large.join(of, "cls", "left").select("cls", "comp", "block", F.coalesce("part", "cls").alias("part")).coalesce(_files(n)), "parts")
    sizes = parts.groupBy("comp", "part").agg(F.count("*").alias("n"))
    several = sizes.groupBy("comp").agg(F.count("*").alias("parts"), F.max(F.struct("n", F.col("part").alias("home"))).alias("top")).where("parts > 1").select("comp", "top.home")
    asks = _meet(found.where("s is not null").select(F.col("a").alias("cls"), "s"), parts.join(several, "comp"), F.col("part") != F.col("home"), rare, _files(n), "part")
    more, _ = materialise(asks.groupBy("pair").applyInArrow(_across, "a long, b long").repartition(_files(n)), "links")
    release(spark, p_parts)
    return links.unionByName(more)


def _files(rows: int) -> int:
    """Files for a table of at most so many rows of a few numbers."""
    return -(-rows // ROWS_A_FILE) or 1


def _candidates(docs: DataFrame, words: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, list[str]]:
    """Steps 1 and 2: (doc_id, n_shingles, cls) of every row, (cls, first, copies), (cls, s), (cls, h) and (cls, comp) of what may link; paths to release."""
    d = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    least = max(8, fan_out(docs.sparkSession))
    named, _ = materialise(_digests(d, words), "digests")
    total, rows = named.agg(F.sum("n_shingles"), F.count("*")).first()
    total, files = total or 0, _files(rows)
    per_class = named.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    bits = _bits_for(rows)
    passed = _first_filter(d, words, max(least, total // BUCKET_HASHES), _copied(per_class, bits))
    # One document stands for a class; its text is read again.
    one, p1 = materialise(per_class.join(passed, "cls").select("cls", F.col("first").alias("its")).coalesce(files), "passed")
    texts = _texts_of(d, one, bits).select("cls", "text")
    # Rows without an id stand for the classes that have no other; they are found by their sets.
    nameless = _named_texts(d.where("doc_id is null"), words).join(one.where("its is null").select("cls").hint("shuffle_hash"), "cls", "left_semi")
    texts = texts.unionByName(nameless.dropDuplicates(["cls"]))
    sets, p2 = materialise(_pack_sets(texts, words), "sets")
    total = (sets.agg(F.sum(F.length("hashes"))).first()[0] or 0) // 8
    kept, p3 = materialise(_rare(sets, max(least, total // BUCKET_HASHES)), "rare")
    release(docs.sparkSession, p2)
    each, rare = kept.select("cls", "s"), kept.select("cls", F.explode("rare").alias("h"))
    hubs = rare.groupBy("h").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = components(rare.join(hubs, "h").where("cls != hub").select("cls", "hub"), _files(total // 4))
    comps, p4 = materialise(near.select(F.col("node").alias("cls"), F.col("component").alias("comp")).coalesce(files), "near")
    return named, per_class, each, rare, comps, [p1, p3, p4]


def classes(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _grouped(docs, words, key, text).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """classes() with cls, which names a row's set, and root, which names its component; both null for an empty set."""
    named, per_class, each, rare, comps, paths = _candidates(docs, words, key, text)
    root = components(_links(each, comps, rare)).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    ids = per_class.join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = ids.join(ids.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("cls", "root", "component_id")
    out = named.join(ids, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "cls", "root")
    release(docs.sparkSession, *paths)
    return out


def link_counts(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_links) of every row: how many other rows link with it, all links and copies counted.

    This searches for every link, which classes() doesn't need; its work grows with their number.
    """
    named, per_class, each, rare, comps, paths = _candidates(docs, words, key, text)
    n = comps.count()
    blocked, p_blocked = materialise(_blocks(comps, n).join(per_class.select("cls", "copies"), "cls").coalesce(_files(n)), "blocked")
    small, large = blocked.where("blocks = 1"), blocked.where("blocks > 1")
    counted = small.select("pair", "comp", "cls", "copies").join(each, "cls").groupBy("pair").applyInArrow(_count_within, "cls long, n long")
    if not large.isEmpty():
        counted = counted.unionByName(_meet(each, large, F.lit(True), rare, _files(n), "copies").groupBy("pair").applyInArrow(_count_across, "cls long, n long"))
    found, _ = materialise(counted.groupBy("cls").agg(F.sum("n").alias("n")), "counts")
    release(docs.sparkSession, *paths, p_blocked)
    links = per_class.join(found, "cls", "left").select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return named.join(links, "cls", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _with_class(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with cls, which names the set of a row's text."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in _slices(batches):
            sets = shingle_sets(b.column(at).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_class(s) if len(s) else None for s in sets], pa.int64())], [*names, "cls"])

    return docs.mapInArrow(run, StructType([*schema.fields, StructField("cls", LongType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, all columns unchanged; of a group's rows of that id one stays.

    Rows of one id with different texts are judged each by its own group.  Rows without an id stay.
    """
    groups = _grouped(docs).where("doc_id is not null")
    # Of each id: whether its rows are all of one set, and whether that one stays.
    sets = groups.groupBy("doc_id").agg(((F.count("cls") == 0) | ((F.count("cls") == F.count("*")) & (F.min("cls") == F.max("cls")))).alias("one"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    ids, _ = materialise(sets.where("stays"), "ids")
    known = docs.where("doc_id is not null")
    once = known.join(ids.where("one").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    several = ids.where("not one").select("doc_id")
    if not several.isEmpty():
        stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("its"), F.col("cls").alias("its_cls"), "root").distinct()
        rows = _with_class(known.join(several.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns))
        rows = rows.join(stay, (F.col("doc_id") == F.col("its")) & F.col("cls").eqNullSafe(F.col("its_cls")))
        once = once.unionByName(rows.dropDuplicates(["doc_id", "root"]).select(docs.columns))
    return once.unionByName(docs.where("doc_id is null"))
