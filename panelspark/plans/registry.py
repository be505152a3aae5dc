"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
plus, where the semantics are SQL-expressible, a DuckDB-runnable oracle SQL
string over the driver tables.  ``__spark_entry__`` exposes both maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.session import apply_sql_defaults
from panelspark.sources.tables import Tables, load_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_sql_defaults(spark)
            return fn(load_tables(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so its queries register."""
    from panelspark.plans import (  # noqa: F401
        catalog_rows, catalog_joins, catalog_rollups, catalog_history, catalog_quality,
        catalog_features, catalog_metrics, catalog_explain, catalog_serve, catalog_models,
        catalog_sources,
    )
    from panelspark.plans import catalog_streams  # noqa: F401  (reuses oracles registered above)
