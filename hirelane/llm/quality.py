"""Quality classifier by positive-unlabelled learning.

A logistic model over text statistics minimises the non-negative PU risk (Kiryo et al., 2017): with trusted
positives P, unlabelled web text U and class prior p,

    p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)]),

where a step that would make the second part negative is taken back.  The prior is estimated on the unlabelled texts: the share of
positives is at most the ratio of U to P above any threshold of a first model's score (best bin estimation, Garg et al.,
2021), and the threshold with the least upper bound names it.  Slope and shift of the score minimise the unbiased PU risk with
the logistic loss, so rows labelled 0 take no part anywhere.

The fit reads a bounded sample (``LABELLED`` rows labelled 1, ``UNLABELLED`` others, chosen by hash; of a repeated id's rows as many as twice these together); every
text is scored whole.  Labels, language, source and id are no inputs.  Null and empty texts have all statistics
zero and a score like any other; rows without an id are never learned from; repeated rows are scored each.
Without rows labelled 1 or without texts the score is 0.5.  An empty table gives no rows, a very long text one row like any
other; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import CHUNK_BYTES, _combine, word_hashes

LABELLED, UNLABELLED = 5000, 5000
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
#: Bytes with a share of their own.
MARKS = [ord(c) for c in "|!#$%&*.,\n<>{}@/\\_=;:-\"'"]
STATISTICS = 16 + len(MARKS)


def _one(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(STATISTICS)
    if not len(data):
        return out
    count = np.bincount(data, minlength=256)
    size, words = len(data), len(h)
    letters = count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum()
    out[0] = 1
    out[1] = np.log1p(words) / 10
    out[2] = count[_UPPER].sum() / max(1, letters)
    out[3] = count[_DIGIT].sum() / size
    out[4] = letters / size
    out[5] = (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / size
    out[6] = count[:32].sum() / size
    if words:
        kinds, times = np.unique(h, return_counts=True)
        out[7] = len(kinds) / words
        out[8] = times.max() / words
        out[9] = min(1.0, size / words / 20)
        # Few kinds for the number of words, by Herdan's measure.
        out[10] = np.log1p(len(kinds)) / np.log1p(words)
        if words > 1:
            out[11] = (h[1:] == h[:-1]).mean()
        if words > 4:
            out[12] = 1 - len(np.unique(_combine(h, 4))) / (words - 3)
        share = times / words
        out[13] = -(share * np.log(share)).sum() / 10
        out[14] = (times[times > 1].sum()) / words
        out[15] = 1 / words
    out[16:] = np.sqrt(count[MARKS] / size)
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS numbers for every text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    out, i = np.zeros((len(raw), STATISTICS)), 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < CHUNK_BYTES):
            size += len(raw[j]) + 1
            j += 1
        data = np.frombuffer(b" ".join(raw[i:j]), np.uint8)
        starts, h = word_hashes(data)
        at = np.cumsum([0, *(len(x) + 1 for x in raw[i:j])])
        cut = np.searchsorted(starts, at)
        for k in range(j - i):
            out[i + k] = _one(data[at[k] : at[k] + len(raw[i + k])], h[cut[k] : cut[k + 1]])
        i = j
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x[:, 1:] ** 2])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expand(x) - self.mean) / self.scale, -8, 8) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Weights of least nnPU risk with the sigmoid loss, by Adam."""
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        # Sigmoid loss: loss(z, +) = s(-z), loss(z, -) = s(z).
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        up, uu = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
        negative = su.mean() - prior * sp.mean()
        g = -prior * up + (uu - prior * up) if negative >= 0 else -(uu - prior * up)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(zp: np.ndarray, zu: np.ndarray, confidence: float = 0.9) -> float:
    """Share of positives among the unlabelled, from scores of both."""
    at = np.unique(np.concatenate([zp, zu]))
    above = lambda z: 1 - np.searchsorted(np.sort(z), at) / len(z)
    qp, qu = above(zp), above(zu)
    # So few positives above a threshold that their share says nothing.
    at_least = qp > 0.05
    slack = np.sqrt(np.log(4 / (1 - confidence)) / 2) * (len(zu) ** -0.5 + len(zp) ** -0.5)
    best = np.argmin((qu[at_least] + slack) / qp[at_least])
    return float(np.clip(qu[at_least][best] / qp[at_least][best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 500, rate: float = 0.05, decay: float = 1e-2) -> Model:
    """The model of these rows of statistics; without a prior, one is estimated from a first fit that takes it as 0.5."""
    width = 2 * STATISTICS - 1
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0)
    every = _expand(np.vstack([positive, unlabelled]))
    mean, scale = every.mean(0), every.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    p, u = (np.clip((_expand(x) - mean) / scale, -8, 8) for x in (positive, unlabelled))
    if prior is None:
        first = _minimise(p, u, 0.5, rounds, rate, decay)
        prior = estimate_prior(p @ first, u @ first)
    w = _minimise(p, u, prior, rounds, rate, decay)
    return Model(mean, scale, w, *_scale(p @ w, u @ w, prior))


def _scale(zp: np.ndarray, zu: np.ndarray, prior: float, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and shift of least PU risk with the logistic loss, E_U[log(1 + e^f)] - prior * E_P[f], by Newton steps with a slight ridge."""
    unit = zu.std() + 1e-9
    x, aim = np.column_stack([zu / unit, np.ones(len(zu))]), prior * np.array([zp.mean() / unit, 1.0])
    w = np.array([1.0, 0.0])
    for _ in range(60):
        s = _sigmoid(x @ w)
        g = x.T @ s / len(x) - aim + ridge * w
        h = (x * (s * (1 - s))[:, None]).T @ x / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    return float(w[0] / unit), float(w[1])


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from; a null id isn't one of them."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(df: DataFrame, carry: list[str], text: str) -> DataFrame:
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(len(carry)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(list(x), pa.list_(pa.float64()))], [*carry, "x"])

    return df.select(*carry, text).mapInArrow(run, f"{kinds}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a bounded sample of the rows labelled 1 outside the held-out third and of the documents."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("k")).where((F.col(label).cast("int") == 1) & F.col("k").isNotNull() & ~held_out(F.col("k"))).distinct()
    n, total = known.count(), docs.count()
    chosen = known.where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(max(1, n))) < LABELLED).limit(2 * LABELLED).toPandas()
    small = spark.createDataFrame([(int(a), 1) for a in chosen["k"]], "k long, y int")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(F.broadcast(small), F.col("doc") == F.col("k"), "left")
    rows = rows.withColumn("web", F.coalesce(F.pmod(F.xxhash64("doc", F.lit(6)), F.lit(max(1, total))) < UNLABELLED, F.lit(False))).where("y is not null or web")
    rows = rows.limit(2 * (LABELLED + UNLABELLED))
    got = _features(rows.withColumn("y", F.coalesce("y", F.lit(-1))), ["y", "web"], "text").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, STATISTICS)
    return fit(x[got["y"].to_numpy() == 1], x[got["web"].to_numpy().astype(bool)])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(statistics(b.column(1).to_pylist())), pa.float64())], ["doc_id", "score"])

    s = docs.select(docs[key].cast("long"), docs[text]).mapInArrow(run, "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that aren't rejected, all columns unchanged."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column(at).to_pylist())) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
