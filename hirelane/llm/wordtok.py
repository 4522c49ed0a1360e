"""Word-wise view of a tokenizer with word ends.

Such a tokenizer lower-cases, drops white space and cuts the text into words before it merges
bytes, so the ids of a text are the ids of its words one after another.  ``WordTable`` splits
whole batches with NumPy, gives every distinct word a number, and asks for the ids of a word only
when it first meets it: from the tokenizers library, or from an encoder given by the caller.

The supported configuration is the one in the file itself: NFC, white space and lower-case
normalisers, a word pattern of contractions, letters, single digits and other runs, and a BPE
with a word-end suffix.  Any other file is refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

#: Fixed values of the tokenizer's file format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE_CODES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTED = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}

#: Characters handled at once, and words remembered by a worker; both bound its memory.
CHUNK_CHARS = 1 << 20
TABLE_WORDS = 300_000
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 1 << 20
_ANY_SPACE = re.compile(r"\s")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _classes() -> np.ndarray:
    """0 space, 1 letter, 2 number, 3 other, for every code point."""
    kind = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = 1
        elif major == "N":
            kind[c] = 2
    kind[SPACE_CODES] = 0
    return kind


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def load_model(path: str) -> dict:
    """The tokenizer's file, checked to be of the supported kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]["pretokenizers"]
    norms = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if (
        spec["model"]["type"] != "BPE"
        or not spec["model"]["end_of_word_suffix"]
        or pre[0]["pattern"].get("Regex") != WORD_PATTERN
        or norms != ["NFC", "Replace", "Lowercase"]
        or spec["decoder"] is not None
    ):
        raise ValueError(f"{path}: only a BPE with word ends and this word pattern is supported")
    return spec


def library_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of single words by the tokenizers library's own model."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path).model
    letters = byte_alphabet()

    def encode(words: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize("".join([letters[b] for b in w.encode("utf-8")]))] for w in words]

    return encode


class WordTable:
    """Numbers of words, and their ids.

    Between groups of texts, and between the pieces of a long text, it forgets all when it holds more than `most` words, so it
    holds at most these and the words of one piece.
    """

    def __init__(self, path: str, encode: Callable[[list[str]], list[list[int]]] | None = None, most: int = TABLE_WORDS):
        self.spec = load_model(path)
        self.encode = encode or library_encoder(path)
        self.most = most
        self.kind = _classes()
        self.codes = _mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_BASE))
        self.powers = np.full(1024, _BASE | 1, np.uint64)
        self.powers[0] = 1
        self.powers = np.multiply.accumulate(self.powers)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.mask = _SLOTS - 1
        #: Little-endian 32-bit ids of each numbered word.
        self.ids: list[bytes] = []
        for i in self.special.values():
            self.ids.append(np.uint32(i).tobytes())
        self.special_number = {s: k for k, s in enumerate(self.special)}

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        at = (h & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            got, key = self.slots[at[todo]], self.keys[at[todo]]
            hit = (key == h[todo]) & (got >= 0)
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def _place(self, key: int, number: int) -> None:
        at = key & self.mask
        while self.slots[at] >= 0:
            at = (at + 1) & self.mask
        self.slots[at], self.keys[at] = number, key

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        size = self.mask + 1
        while len(self.ids) + len(words) > size // 2:
            size *= 2
        if size > self.mask + 1:
            known = np.flatnonzero(self.slots >= 0)
            keys, numbers = self.keys[known].tolist(), self.slots[known].tolist()
            self.keys, self.slots, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), size - 1
            for key, number in zip(keys, numbers, strict=True):
                self._place(key, number)
        for key, ids in zip(h.tolist(), self.encode(words), strict=True):
            self._place(key, len(self.ids))
            self.ids.append(np.array(ids, "<u4").tobytes())

    def _words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(start, number) of each word of a normalised text."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[raw]
        start = np.empty(len(raw), bool)
        start[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == 2
        tick = np.flatnonzero((raw == 39) & start)
        for p in tick[(tick + 1 < len(raw))].tolist():
            if kind[p + 1] == 1:
                n = CONTRACTED.get(text[p + 1]) or CONTRACTED.get(text[p + 1 : p + 3])
                if n:
                    start[p + 1] = False
                    if p + 1 + n < len(raw):
                        start[p + 1 + n] = True
        at = np.flatnonzero(start)
        size = np.diff(at, append=len(raw))
        value = self.codes[raw]
        first = np.zeros(len(raw), np.int32)
        first[at] = at
        np.maximum.accumulate(first, out=first)
        place = np.arange(len(raw), dtype=np.int32) - first
        longest = int(size.max(initial=1))
        if longest > len(self.powers):
            more = np.full(longest, _BASE | 1, np.uint64)
            more[0] = 1
            self.powers = np.multiply.accumulate(more)
        value *= self.powers[place]
        h = _mix(np.add.reduceat(value, at) + size.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
        keep = kind[at] != 0
        at, size, h = at[keep], size[keep], h[keep]
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            u, where = np.unique(h[new], return_index=True)
            where = new[where]
            self._learn(u, [text[a : a + s] for a, s in zip(at[where].tolist(), size[where].tolist(), strict=True)])
            number[new] = self._find(h[new])
        return at, number

    def normalise(self, text: str) -> str:
        """NFC and lower case by code point (no final sigma), as the tokenizer does."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def _pieces(self, text: str) -> Iterator[str | int]:
        """The text in normalised pieces of bounded size that no word crosses, and special numbers."""
        at = 0
        found = self.split_special.finditer(text) if "<|" in text else ()
        parts: list[str | int] = []
        for m in found:
            parts += [text[at : m.start()], self.special_number[m[0]]]
            at = m.end()
        for x in [*parts, text[at:]]:
            if isinstance(x, int):
                yield x
                continue
            lo = 0
            while len(x) - lo > CHUNK_CHARS:
                cut = max(x.rfind(" ", lo, lo + CHUNK_CHARS), x.rfind("\n", lo, lo + CHUNK_CHARS))
                if cut <= lo:
                    m = _ANY_SPACE.search(x, lo + CHUNK_CHARS)
                    cut = m.start() if m else len(x)
                yield self.normalise(x[lo:cut])
                lo = cut
            yield self.normalise(x[lo:])

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
        """(index, little-endian 32-bit ids) of each text in order; null counts as empty."""
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> Iterator[tuple[int, bytes]]:
            if not group:
                return
            self._forget()
            at, number = self._words("\n".join([t for _, t in group]))
            limits = np.cumsum([0, *(len(t) + 1 for _, t in group)])
            cut = np.searchsorted(at, limits).tolist()
            listed = number.tolist()
            for k, (i, _) in enumerate(group):
                yield i, b"".join(map(self.ids.__getitem__, listed[cut[k] : cut[k + 1]]))
            group.clear()

        for i, text in enumerate(texts):
            text = text or ""
            if len(text) > CHUNK_CHARS or "<|" in text:
                yield from flush()
                size = 0
                yield i, self._long(text)
                continue
            t = self.normalise(text)
            if size + len(t) > CHUNK_CHARS:
                yield from flush()
                size = 0
            group.append((i, t))
            size += len(t) + 1
        yield from flush()

    def _long(self, text: str) -> bytes:
        """Ids of a text, piece by piece; the words of one piece may be forgotten before the next."""
        out: list[bytes] = []
        for x in self._pieces(text):
            if isinstance(x, int):
                out.append(self.ids[x])
                continue
            self._forget()
            out.append(b"".join(map(self.ids.__getitem__, self._words(x)[1].tolist())))
        return b"".join(out)

    def _forget(self) -> None:
        if len(self.ids) > self.most:
            self.clear()


_TABLES: dict[tuple, WordTable] = {}


def word_table(path: str) -> WordTable:
    """This worker's table for a tokenizer's file."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
