"""All registered queries and their SQL."""

from __future__ import annotations

from . import corpus_queries, dataset_queries, scoring_queries

_ALL = (scoring_queries, dataset_queries, corpus_queries)


def queries() -> dict:
    return {name: q for m in _ALL for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _ALL for name, q in m.SQL.items()}
