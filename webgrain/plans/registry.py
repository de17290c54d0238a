"""All queries of the library outside its training-data subpackage, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bm25_scores"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


#: Rules held against literal rows: tests run them, but they read no table and so are no queries.
_GOLDEN: dict[str, tuple[Query, str]] = {}


def golden(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _GOLDEN[name] = f, sql
        return f

    return add


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    # Each module registers its queries when it is first imported.
    from webgrain.plans import answers, articles, documents, logs, made, pages, parts, reading, streams, tables  # noqa: F401

    return dict(_QUERIES)


def goldens() -> dict[str, tuple[Query, str]]:
    queries()
    return dict(_GOLDEN)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
