"""All registered queries of the library, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    from .plans import arrivals, audit, documents, evaluation, extraction, ledger, more, reading, reversals, scoring  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per company: names, history, look-ups, detectors, checks and decisions in one plan."""
    from pyspark.sql import functions as F

    from .plans.ledger import dec_outcome

    rows = dec_outcome(spark, sf_dir)
    return rows.groupBy("company_key").agg(F.count("*").alias("entries"), *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("VALID", "UNCLEAR", "NOT_VALID")])
