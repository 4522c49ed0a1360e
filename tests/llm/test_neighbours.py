"""Searches whose groups are many: trees of many leaves, components of many blocks."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelane.llm import ann, ngram_join


def exact(x, q, k=20):
    s = (x * x[q]).sum(axis=1)
    order = np.lexsort((np.arange(len(x)), -s))
    return [int(i) for i in order if i != q][:k], s


@pytest.mark.parametrize("shape", ["clustered", "isotropic"])
def test_recall_with_many_leaves(spark, monkeypatch, shape):
    monkeypatch.setattr(ann, "LEAF_ROWS", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    if shape == "clustered":
        x += 6 * rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)]
    x = x.astype(np.float32).astype(np.float64)
    seen = {}
    calibrate = ann._calibrate
    monkeypatch.setattr(ann, "_calibrate", lambda placed, tree, *a: seen.setdefault("visits", (calibrate(placed, tree, *a), tree.leaves))[0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").withColumn("bucket", F.lit(1))
    out = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    hits = 0
    for q in range(0, 6000, 20):
        want, s = exact(x, q)
        assert len(out[q]) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in out[q])
        hits += len(set(want) & {i for i, _ in out[q]})
    assert hits / (300 * 20) >= 0.9
    visits, leaves = seen["visits"]
    assert leaves > 100
    if shape == "clustered":
        assert visits < leaves / 4


def test_repeated_ids_stay_bounded_and_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    monkeypatch.setattr(ann, "CALIBRATE", 5)
    rows = [(0, [1.0, 0.5])] * 300 + [(i, [1.0, float(i % 7)]) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, recall=1.0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(r.query_id != r.vec_id for r in got)
    assert [r.rank for r in got if r.query_id == 0] == list(range(1, 21))


@pytest.mark.parametrize("block", [4, 7])
def test_ngram_components_that_chain(spark, monkeypatch, block):
    """Texts that slide over one long sequence: neighbours link, distant ones don't, and gaps cut the chain."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    words = [f"w{i}" for i in range(900)]
    starts = [i * 6 for i in range(40)] + [400 + i * 6 for i in range(20)] + [600, 640, 680]
    rows = [(i, " ".join(words[at : at + 120])) for i, at in enumerate(starts)]
    sets = [set(range(at, at + 116)) for at in starts]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = {r.doc_id: r.component_id for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and 3 < len(set(root)) < 10
