"""The query catalogue exposed through ``__spark_entry__``.

Each entry maps a query name to a Spark callable ``(spark, sf_dir) ->
DataFrame`` and, where the query is SQL-expressible, to its DuckDB oracle.
Every query reads the driver tables of ``sf_dir`` in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tidewater.plans  # noqa: F401  (registers the models)
from tidewater.plans.core import MODELS, Warehouse
from tidewater.session import apply_result_conf
from tidewater.sources.adapters import DriverRaw
from tidewater.verify import oracle

Query = Callable[[SparkSession, str], DataFrame]


def warehouse(spark: SparkSession, sf_dir: str, **kw) -> Warehouse:
    apply_result_conf(spark)
    return Warehouse(spark, DriverRaw(spark, sf_dir), **kw)


def _model_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return warehouse(spark, sf_dir).ref(name)

    run.__name__ = f"q_{name}"
    return run


# Models whose oracle block has the same name.
def model_queries() -> dict[str, Query]:
    return {n: _model_query(n) for n in MODELS if n in oracle.BLOCKS}


def extra_queries() -> dict[str, Query]:
    """Operator-level queries beyond the model catalogue (metrics, checks, ops)."""
    from tidewater import catalog_extra, catalog_feeds, catalog_ingest, catalog_layers, catalog_runs

    return {
        **catalog_extra.queries(), **catalog_ingest.QUERIES, **catalog_layers.QUERIES, **catalog_feeds.QUERIES, **catalog_runs.QUERIES}


def extra_oracles() -> dict[str, str]:
    from tidewater import catalog_extra, catalog_feeds, catalog_ingest, catalog_layers, catalog_runs

    return {
        **catalog_extra.oracles(), **catalog_ingest.ORACLES, **catalog_layers.ORACLES, **catalog_feeds.ORACLES, **catalog_runs.ORACLES}


def all_queries() -> dict[str, Query]:
    q = model_queries()
    q.update(extra_queries())
    return q


def all_oracles() -> dict[str, str]:
    o = {n: oracle.oracle_query(n) for n in model_queries()}
    o.update(extra_oracles())
    return o
