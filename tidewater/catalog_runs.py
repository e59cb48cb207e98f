"""Queries that go the whole way: sources landed flat, stamped and audited, models built over them, checks run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidewater.catalog_extra import CHECKS, SOURCES
from tidewater.catalog_ingest import nested_orders
from tidewater.pipeline import Reader, land_sources, run_all
from tidewater.quality import oracle_sql as dq_oracle_sql
from tidewater.session import apply_result_conf, checkpoint_dir
from tidewater.sources.adapters import DriverRaw
from tidewater.sources.sinks import table_path
from tidewater.verify.oracle import with_blocks

#: Source of every raw table.
SOURCE_OF = {table: source for source, tables in SOURCES.items() for table in tables}
SAAS = ["github", "slack", "notion"]
BUILD_THREADS = 4


def driver_readers(spark: SparkSession, sf_dir: str, names: Sequence[str] = tuple(SOURCES)) -> dict[str, Reader]:
    """A reader per source over the driver tables of ``sf_dir``."""
    raw = DriverRaw(spark, sf_dir)
    return {name: (lambda _, tables=tuple(SOURCES[name]): {t: raw(t) for t in tables}) for name in names}


def _root(spark: SparkSession) -> str:
    apply_result_conf(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"


def full_run_saas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPS-8: three sources landed, all their models built and published, the report of their checks."""
    checks = CHECKS["saas"]
    return run_all(
        spark, _root(spark), driver_readers(spark, sf_dir, SAAS), SOURCE_OF, [c.model for c in checks], checks, threads=BUILD_THREADS)


def land_nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-1..3: nested orders landed as two flat, stamped tables, put together again by their ids."""
    root = _root(spark)
    land_sources(spark, root, {"shop": lambda _: {"shop.orders": nested_orders(spark, sf_dir)}}, normalise=True)
    orders, lines = (spark.read.parquet(table_path(root, "shop", n)) for n in ("orders", "orders__lines"))
    whole = orders.join(lines.drop("_dlt_id"), orders["_dlt_id"] == lines["_dlt_parent_id"], "left")
    return whole.select(
        "o_orderkey", "customer__id", "customer__last_state__o_orderstatus", "_dlt_list_idx", "l_linenumber", "l_partkey",
        "amount__qty", "amount__off")



QUERIES = {f.__name__: f for f in (full_run_saas, land_nested_orders)}

ORACLES = {
    "full_run_saas": with_blocks([c.model for c in CHECKS["saas"]], dq_oracle_sql(CHECKS["saas"])),
    "land_nested_orders": """
        select o_orderkey, o_custkey as customer__id, o_orderstatus as customer__last_state__o_orderstatus,
          cast(row_number() over (
            partition by o_orderkey, o_custkey, o_orderdate order by l_linenumber, l_partkey, l_quantity, l_discount) - 1 as integer) as _dlt_list_idx,
          l_linenumber, l_partkey, l_quantity as amount__qty, l_discount as amount__off
        from lineitem join orders on o_orderkey = l_orderkey""",
}
