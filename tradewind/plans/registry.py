"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewind.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of the named views' DataFrames as a query, and its oracle, which
    sees the same views as common table expressions. A plain table name is a view too."""

    def keep(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda v: (adapters.view if v in adapters.VIEWS else adapters.table)(spark, sf_dir, v)
            return function(*map(read, views))

        QUERIES[name] = run
        if sql:
            defined = [f"{v} AS ({adapters.as_sql(v)})" for v in views if v in adapters.VIEWS]
            body = sql.strip()
            if defined and body[:5].upper() == "WITH ":
                body = ", " + body[5:]
                ORACLE_SQL[name] = "WITH " + ", ".join(defined) + body
            else:
                ORACLE_SQL[name] = ("WITH " + ", ".join(defined) + " " if defined else "") + body
        return function

    return keep


from tradewind.plans import catalogue, demand, extraction, intake, lifecycle, normalisation, publication, scalars, search, site  # noqa: E402, F401
