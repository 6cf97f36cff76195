"""All queries of the retrieval and evaluation engine, with DuckDB SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import corpus, evaluate, ingestion, layout, question_sets, search

FLAGSHIP = "retrieval_by_language"
_EVERY = search.QUERIES | evaluate.QUERIES | question_sets.QUERIES | corpus.QUERIES | layout.QUERIES | ingestion.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _EVERY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _EVERY.items() if sql}
