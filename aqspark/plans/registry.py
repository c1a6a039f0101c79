"""Query registry: a Spark builder and, where SQL can say it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from aqspark.plans.tables import SQL_PREFIX, Tables


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; ``sql`` starts with SELECT or with further CTEs."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            body = sql.strip()
            text = SQL_PREFIX + ("\n" if body[:6].upper() == "SELECT" else ",\n") + body
        REGISTRY[name] = Query(build, text)
        return build

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return REGISTRY[name].build(Tables(spark, sf_dir))

    return run


def load_all() -> dict[str, Query]:
    from aqspark.plans import catalogue  # noqa: F401  (fills the registry)

    return REGISTRY
