"""All named queries outside the optional subpackage."""

from __future__ import annotations

from corpuskit.plans import assembly_queries, corpus_queries, skew_queries, training_queries
from corpuskit.plans.registry import Query

_REGISTRIES = (skew_queries.registry, corpus_queries.registry, training_queries.registry, assembly_queries.registry)


def queries() -> dict[str, Query]:
    return {name: q for r in _REGISTRIES for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for r in _REGISTRIES for name, q in r.sql.items()}
