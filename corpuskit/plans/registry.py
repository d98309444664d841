"""A register of named queries, each with an optional SQL text that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            key = name or function.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = function
            if sql is not None:
                self.sql[key] = sql
            return function

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL for the normal form of ``speaker_id``, null where it names nobody.
KNOWN_SPEAKER_SQL = r"""CASE WHEN {n} IN ('', '__null_ref__', '__null__') OR regexp_full_match({n}, '[0-9a-f]{{4}}_none') THEN NULL ELSE {n} END"""


def known_speaker_sql(column: str) -> str:
    form = f"regexp_replace(lower(trim({column}, ' ' || chr(9))), '[ \\t-]+', '_', 'g')"
    return KNOWN_SPEAKER_SQL.format(n=form)
