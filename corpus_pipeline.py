"""Corpus pipeline: quality classifier, n-gram Jaccard join, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs.

Rows with a null text are empty texts: the classifier scores them like any other, they link with nothing, hold no secret and
pack as one end id.  A null id is never learned from, names no group and is packed like any other.  Of rows of one id each text is
judged by its own group.  Very long texts are handled whole, an empty table gives no pieces, and other columns, whatever
their names, pass all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelane.llm import ngram_join, packing, quality, secrets
from hirelane.llm.queries import tokenizer
from hirelane.llm.util import materialise, release, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return ngram_join.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("secret scan", hide_secrets), ("best-fit packing", pack)]

#: A fitted classifier and a packing heuristic can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            release(spark, before)
        before = path
    return docs
