"""The registry of the engine's queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.bridge import duck_sql, shared_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(name: str, *uses: str, oracle: str | None = None):
    """Register a query: ``f`` gets the named views as DataFrames, in order.

    ``oracle`` is DuckDB SQL over tables and views written ``{name}``.
    """

    def add(f: Callable[..., DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            held = shared_views(spark, sf_dir, uses)
            return f(*(view(spark, sf_dir, u, held) for u in uses)) if uses else f(spark)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck_sql(oracle)
        return f

    return add


def load_all() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    from ledgerlens.plans import aggregates, decoders, evaluation, projections, relations, scalar_queries, streams, validation, windows  # noqa: F401

    return QUERIES, ORACLES
