"""All registered queries of the relational and corpus-analysis operators, with their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from quarryflow.plans import analysis, relational, retrieval, sequences, tables
from quarryflow.sources.tables import plain_sql, run_sql


def _of(text: str) -> Callable:
    return lambda spark, folder: run_sql(spark, folder, text)


def queries() -> dict[str, Callable]:
    return {name: _of(text) for name, text in relational.SQL.items()} | analysis.QUERIES | sequences.QUERIES | tables.QUERIES | retrieval.QUERIES


def oracle_sql() -> dict[str, str]:
    texts = {name: plain_sql(relational.OTHER.get(name, text)) for name, text in relational.SQL.items()}
    return texts | analysis.ORACLES | sequences.ORACLES | tables.ORACLES | retrieval.ORACLES
