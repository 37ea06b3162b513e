"""Registered queries: each has a Spark callable and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.views import ORACLE_VIEWS, Views

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Views], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(Views(spark, sf_dir))
        return df.withColumns({c: F.round(c, DIGITS) for c in self.doubles}) if self.doubles else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        fixes = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}" for c in self.doubles)
        replace = f" REPLACE ({fixes})" if fixes else ""
        return f"{ORACLE_VIEWS} SELECT *{replace} FROM ({self.sql}) AS q"


QUERIES: dict[str, Query] = {}


def register(
    name: str,
    run: Callable[[Views], DataFrame],
    sql: str | None = None,
    doubles: str = "",
) -> None:
    """Add a query; ``doubles`` names the floating point columns compared to 6 decimals."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = Query(name, run, sql, tuple(doubles.split()))


def load() -> dict[str, Query]:
    from workload import (  # noqa: F401 - importing registers the queries
        alert_queries,
        candle_queries,
        catalyst_queries,
        correlation_queries,
        detection_queries,
        feed_queries,
        health_queries,
        market_queries,
        quality_queries,
        topic_queries,
    )

    return QUERIES
