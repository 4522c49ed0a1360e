"""Pluggable models: pair scorers and line classifiers behind Arrow-batched functions.

A model is given as a factory of no arguments, so workers build it once and nothing large is sent with the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class PairModel(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class LineModel(Protocol):
    classes: list[str]

    def encode(self, texts: list[str]) -> np.ndarray: ...

    def predict_proba(self, features: np.ndarray) -> np.ndarray: ...


def pair_scores(left: Column, right: Column, factory: Callable[[], PairModel], batch: int = 32) -> Column:
    """Scores of 0 to 100 (clipped, two digits) of text pairs; null where the model gives none or fails on a batch."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for a, b in parts:
            pairs, out = list(zip(a.fillna(""), b.fillna(""), strict=True)), []
            for at in range(0, len(pairs), batch):
                piece = pairs[at : at + batch]
                try:
                    out += [None if x is None or not np.isfinite(x) else round(min(max(float(x), 0.0), 1.0) * 100, 2) for x in model.predict(piece)]
                except (ValueError, RuntimeError):  # the rule score stands in for it
                    out += [None] * len(piece)
            yield pd.Series(out, dtype="float64")

    return run(left, right)


def line_probabilities(df: DataFrame, text: str, factory: Callable[[], LineModel], features: Column | None = None) -> DataFrame:
    """Rows with `proba`, the class probabilities of each line from its embedding and structural features."""
    if features is None:
        features = F.array().cast("array<double>")

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for texts, more in parts:
            x = np.asarray(model.encode(texts.fillna("").tolist()), np.float64)
            if len(x):
                x = np.hstack([x, np.array(more.tolist(), np.float64).reshape(len(x), -1)])
            yield pd.Series([list(map(float, p)) for p in model.predict_proba(x)])

    return df.withColumn("proba", run(F.col(text), features))


def train_line_classifier(df: DataFrame, features: str, label: str, rounds: int = 2000):
    """Multinomial logistic regression over feature arrays; returns (indexer, model)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc").fit(df)
    rows = index.transform(df).withColumn("features", array_to_vector(F.col(features)))
    return index, LogisticRegression(featuresCol="features", labelCol="label_index", family="multinomial", maxIter=rounds).fit(rows)
