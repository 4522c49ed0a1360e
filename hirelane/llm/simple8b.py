"""Simple-8b word-aligned coding of token ids, and a file format over it.

A 64-bit word has a 4-bit selector and 60 bits for 120 zeros or 60 down to 1 values of equal
width.  Values of over 60 bits escape into two words of selector 0 (low 60 bits, then the rest).
Ids are coded in blocks of ``BLOCK``; every block starts at a word of its own, whose place is kept, so
encoder and decoder work on all blocks at once.

A file is a Parquet table that Spark writes (any file system, atomic commit), a row per segment:
``shard`` and ``segment`` order them, ``start`` counts the ids before it in its shard, ``docs`` holds the
documents' keys (64-bit) and ``sizes`` their numbers of ids (64-bit), ``offsets`` the first word of each block
(32-bit), ``words`` the words; all little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fan_out, scratch_path
from .wordtok import word_table

#: Fixed values of the format: values and bits of selectors 1 to 15.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 256
#: Ids of a segment at least, before it is closed at a document's end.
SEGMENT_IDS = 1 << 18
SEGMENTS = "shard int, segment int, start long, n_ids long, null_keys binary, docs binary, sizes binary, offsets binary, words binary"


def _bits(v: np.ndarray) -> np.ndarray:
    high = (v >> np.uint64(32)).astype(np.float64)
    low = (v & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit values."""
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    v = np.zeros((blocks, BLOCK + 120), np.uint64)
    v[:, :BLOCK].reshape(-1)  # a view isn't contiguous; filled through a padded copy below
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    v[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _bits(v.ravel()).reshape(v.shape)
    tops, size = {1: width}, 1
    while size < 64:
        top = tops[size].copy()
        np.maximum(tops[size][:, :-size], tops[size][:, size:], out=top[:, :-size])
        size *= 2
        tops[size] = top
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(15, 0, -1):
        k, p = int(COUNTS[s]), 1 << (int(COUNTS[s]).bit_length() - 1)
        top = np.maximum(tops[p][:, :BLOCK], tops[p][:, k - p : k - p + BLOCK])
        choice[top <= WIDTHS[s]] = s
    step = COUNTS.copy()
    limit = np.full(blocks, BLOCK)
    limit[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    rows, places, chosen = [], [], []
    while len(live):
        s = choice[live, at[live]]
        rows.append(live)
        places.append(at[live])
        chosen.append(s)
        at[live] += step[s]
        live = live[at[live] < limit[live]]
    row, place, sel = np.concatenate(rows), np.concatenate(places), np.concatenate(chosen)
    order = np.lexsort((place, row))
    row, place, sel = row[order], place[order], sel[order]
    length = 1 + (sel == 0)
    first = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    for s in range(16):
        m = np.flatnonzero(sel == s)
        if not len(m):
            continue
        if s == 0:
            x = v[row[m], place[m]]
            words[first[m]] = x & np.uint64((1 << 60) - 1)
            words[first[m] + 1] = x >> np.uint64(60)
            continue
        word = np.full(len(m), s << 60, np.uint64)
        if WIDTHS[s]:
            for j in range(int(COUNTS[s])):
                word |= v[row[m], place[m] + j] << np.uint64(j * int(WIDTHS[s]))
        words[first[m]] = word
    offsets = first[np.searchsorted(row, np.arange(blocks))]
    return words, offsets.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    escaped = np.flatnonzero(sel == 0)
    count = COUNTS[sel]
    count[escaped[1::2]] = 0
    before = np.cumsum(count) - count
    block = np.zeros(len(words), np.int64)
    block[offsets[1:]] = 1
    block = np.cumsum(block)
    place = before - before[offsets.astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(2, 16):
        m = np.flatnonzero(sel == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s]) if len(m) else 0):
            keep = m[place[m] + j < end[m]] if j else m
            out[place[keep] + j] = (words[keep] >> np.uint64(j * int(WIDTHS[s]))) & mask
    low, high = escaped[::2], escaped[1::2]
    out[place[low]] = words[low] | (words[high] << np.uint64(60))
    return out


def write(df: DataFrame, tokenizer: str, end_id: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Tokenise every text, append end_id and write the ids in ascending key order; returns the place.

    Shards are ranges of keys; null keys come first, rows of equal keys in any order.  A null or empty text is end_id alone, a very long
    one is written like any other.  An empty table gives an empty file; other columns, whatever their names, are ignored.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = word_table(tokenizer), np.uint32(end_id).tobytes()
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        raws: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, start, held
            ids = np.frombuffer(b"".join(raws), "<u4").astype(np.uint64)
            words, offsets = encode(ids)
            row = [shard, segment, start, len(ids), np.array([k is None for k in keys], np.uint8).tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([len(r) // 4 for r in raws], "<i8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            segment, start, held = segment + 1, start + len(ids), 0
            keys.clear()
            raws.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")])

        for b in batches:
            names = b.column(0).to_pylist()
            for i, raw in table.encode_all(b.column(1).to_pylist()):
                keys.append(names[i])
                raws.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield close()
        if keys:
            yield close()

    dealt = df.select(df[key].cast("long").alias("k"), df[text]).repartitionByRange(fan_out(spark), "k").sortWithinPartitions("k")
    dealt.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the file.

    The totals of the shards, one number per written partition, are summed on the driver.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    base, total = {}, 0
    for shard, n in sorted(files.groupBy("shard").agg(F.sum("n_ids")).collect()):
        base[shard], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = decode(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4"), r["n_ids"]).astype("<u4").tobytes()
                size = np.frombuffer(r["sizes"], "<i8")
                at = np.cumsum(size) - size
                crc = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                nulls = np.frombuffer(r["null_keys"], np.uint8).astype(bool)
                docs = pa.array(np.frombuffer(r["docs"], "<i8"), mask=nulls)
                yield pa.RecordBatch.from_arrays([docs, pa.array(at + r["start"] + base[r["shard"]]), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
