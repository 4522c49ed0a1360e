"""Findings of the second review."""

from __future__ import annotations

import random

import pytest

from hirelane.llm import ngram_join


def exchanged(plan) -> int:
    """Bytes of the rows that an executed plan shuffled."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return exchanged(plan.executedPlan())
    if "QueryStage" in name:
        return exchanged(plan.plan())
    kids = plan.children()
    own = plan.metrics().apply("dataSize").value() if name == "Exchange" else 0
    return own + sum(exchanged(kids.apply(i)) for i in range(kids.size()))


@pytest.mark.parametrize("most", [64, 1 << 25])
def test_ngram_join_shuffles_little_but_what_may_link(spark, monkeypatch, most):
    """all texts were shuffled, and each hash took the more bytes the more buckets there were."""
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(1 << 40)) for _ in range(120))) for i in range(1500)]
    want = {i: i for i, _ in rows}
    for i in range(20):
        rows += [(2000 + i, rows[i][1] + " more"), (3000 + i, rows[100 + i][1])]
        want |= {2000 + i: i, 3000 + i: 100 + i}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    sizes = []
    write = ngram_join.materialise

    def measured(df, tag):
        df.collect()
        sizes.append(exchanged(df._jdf.queryExecution().executedPlan()))
        return write(df, tag)

    monkeypatch.setattr(ngram_join, "materialise", measured)
    monkeypatch.setattr(ngram_join, "MOST_BITS", most, raising=False)
    monkeypatch.setattr(ngram_join, "fan_out", lambda spark: 300)
    got = {r.doc_id: r.component_id for r in ngram_join.classes(docs).collect()}
    assert got == want
    if most > 64:
        assert sum(sizes) < 0.5 * sum(len(t) for _, t in rows), sizes
