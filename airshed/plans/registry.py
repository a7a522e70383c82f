"""Query registry: name -> Spark builder, and name -> DuckDB oracle SQL.

A query module registers with ``@query(name, sql=..., doubles=[...])``.  The
Spark result is normalised by ``finish`` (doubles rounded at 4 dp); ``doubles``
names the double columns the oracle rounds the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airshed.plans.finish import finish
from airshed.plans.oracle_views import r4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOUBLES: dict[str, list[str]] = {}


def query(name: str, sql: str | None = None, doubles: list[str] | tuple = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return finish(_fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = r4(sql, list(doubles))
            DOUBLES[name] = list(doubles)
        return fn

    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from airshed.plans import q_core, q_merge, q_series, q_eda, q_models, q_stream, q_io  # noqa: F401,E401
