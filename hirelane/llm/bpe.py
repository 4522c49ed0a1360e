"""BPE encoding by forced-boundary splitting, and decoding.

Two neighbouring bytes that stand next to each other inside no vocabulary token can never end up
in one token, so every such place is a certain cut: no merge crosses it, and the merges on its
two sides don't influence each other.  A word is cut there, every fragment is merged on its own
(and remembered, fragments repeat far more than words do), and the results are concatenated.

Rows: null and empty texts have no ids and decode to the empty text; ids outside the vocabulary
are an error; every input row gives one output row, repeated rows included; only the named
columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordtok import WordTable, byte_alphabet, load_model

#: Fragments remembered by a worker.
FRAGMENTS = 200_000


class ForcedBoundaryBPE:
    """Encoder of single words, given as strings."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): (i, a + b) for i, (a, b) in enumerate(merges)}
        self.letters = byte_alphabet()
        #: Neighbouring bytes inside some token, as two-letter strings.
        self.joined: set[str] = set()
        for token in self.vocab:
            t = token.removesuffix(self.end)
            self.joined.update(t[i : i + 2] for i in range(len(t) - 1))
        self.known: dict[str, list[int]] = {}

    def fragments(self, word: str) -> list[str]:
        """The word in byte letters, cut at every forced boundary; the last one carries the end mark."""
        s = "".join([self.letters[b] for b in word.encode("utf-8")])
        out, at, joined = [], 0, self.joined
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in joined:
                out.append(s[at:i])
                at = i
        return [*out, s[at:] + self.end]

    def merge(self, fragment: str) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        ended = fragment.endswith(self.end) and len(fragment) > len(self.end)
        symbols = list(fragment[: -len(self.end)] if ended else fragment)
        if ended:
            symbols[-1] += self.end
        rank, none = self.rank, (1 << 60, "")
        ranks = [rank.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [best[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((symbols[i - 1], symbols[i]), none)
        return [self.vocab[s] for s in symbols]

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for f in self.fragments(word):
            ids = self.known.get(f)
            if ids is None:
                if len(self.known) >= FRAGMENTS:
                    self.known.clear()
                ids = self.known[f] = self.merge(f)
            out += ids
        return out


class Codec:
    """Encodes whole texts with ForcedBoundaryBPE and decodes ids."""

    def __init__(self, path: str):
        spec = load_model(path)
        self.bpe = ForcedBoundaryBPE(spec)
        self.table = WordTable(path, encode=lambda words: [self.bpe.encode_word(w) for w in words])
        self.tokens = [b""] * (max(self.bpe.vocab.values()) + 1)
        for t, i in self.bpe.vocab.items():
            self.tokens[i] = t.encode("utf-8")
        for t, i in self.table.special.items():
            self.tokens += [b""] * (i + 1 - len(self.tokens))
            self.tokens[i] = t.encode("utf-8")
        self.decimal = [str(i).encode() for i in range(len(self.tokens))]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        for i, raw in self.table.encode_all(texts):
            yield i, np.frombuffer(raw, "<u4")

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 text: the file names no decoder, so the tokens are joined by one space."""
        return b" ".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for a tokenizer's file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [x.astype(np.int32) for _, x in c.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text]).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every row of ids; null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [c.decode(x or []).decode("utf-8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[ids]).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode, decode those ids and digest both in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, a, z = [], [], []
            for _, x in c.encode(b.column(1).to_pylist()):
                ids = x.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(b" ".join(map(c.decimal.__getitem__, ids))).hexdigest())
                z.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text]).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
