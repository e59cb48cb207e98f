"""Full run (OPS-8): land every source, build the models, run the checks.

A plain driver function: it calls readers, writers and model builders in
order and stops at the first failing source; all data work is Spark jobs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import dedup_latest
from tidewater.plans.core import LAYERS, Warehouse
from tidewater.quality import ModelChecks, run_checks
from tidewater.session import warehouse_dir
from tidewater.sources.nested import normalised
from tidewater.sources.publish import vacuum
from tidewater.sources.sinks import TABLES, land_table, record_load, record_tables, table_path, write_table

Reader = Callable[[SparkSession], Mapping[str, DataFrame]]


def land_sources(
    spark: SparkSession,
    raw_root: str,
    sources: Mapping[str, Reader],
    keys: Mapping[str, Sequence[str]] | None = None,
    inserted_at: Mapping[str, str] | None = None,
    normalise: bool = False,
    threads: int = 1,
) -> dict[str, str]:
    """Run each source reader and replace its raw tables; one audit row per
    load, and one per table with the rows and null ``keys`` (columns as landed)
    its write observed.  With ``normalise`` nested records land flat: structs as
    columns, lists as child tables, rows stamped.  ``threads`` tables of a
    source are written side by side.  Stops at the first failing source (its
    audit row says so).  ``inserted_at`` sets the time of a source's load (now
    by default)."""
    landed: dict[str, str] = {}
    for name, reader in sources.items():
        load_id = uuid.uuid4().hex

        def land(table: str, df: DataFrame) -> list[tuple[str, str, tuple[str, int, int]]]:
            short = table.split(".")[-1]
            out = []
            for part, rows in (normalised(df, short, load_id) if normalise else {short: df}).items():
                full = table + part[len(short):]
                out.append((full, part, land_table(rows, raw_root, name, part, (keys or {}).get(full, ()))))
            return out

        try:
            with ThreadPoolExecutor(max_workers=threads) as pool:
                writes = [pool.submit(land, *item) for item in reader(spark).items()]
                done = [part for w in writes for part in w.result()]
            record_tables(spark, raw_root, name, load_id, [(part, rows, nulls) for _, part, (_, rows, nulls) in done])
            landed.update({full: path for full, _, (path, _, _) in done})
        except Exception:
            record_load(spark, raw_root, name, status=1, load_id=load_id)
            raise
        record_load(spark, raw_root, name, status=0, load_id=load_id, inserted_at=(inserted_at or {}).get(name))
    return landed


def landed_raw(spark: SparkSession, raw_root: str, source_of: Mapping[str, str]) -> Callable[[str], DataFrame]:
    """Raw resolver over landed tables: ``raw('github.commits')``."""

    def raw(name: str) -> DataFrame:
        return spark.read.parquet(table_path(raw_root, source_of[name], name.split(".")[-1]))

    return raw


def append_then_dedup(
    spark: SparkSession,
    root: str,
    layer: str,
    name: str,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence,
) -> DataFrame:
    """Append a batch (SNK-2), then read the table back keeping the latest
    row per key (WIN-1): repeated deliveries of a record collapse to one."""
    write_table(batch, root, layer, name, mode="append")
    full = spark.read.parquet(table_path(root, layer, name))
    return dedup_latest(full, list(keys), list(order))


def run_all(
    spark: SparkSession,
    raw_root: str,
    sources: Mapping[str, Reader],
    source_of: Mapping[str, str],
    models: Sequence[str],
    checks: Sequence[ModelChecks] = (),
    skip_ingest: bool = False,
    skip_transform: bool = False,
    threads: int = 1,
    keep_versions: int | None = None,
    normalise: bool = True,
    written: Sequence[str] = (),
) -> DataFrame | None:
    """Ingest -> build -> check, ``threads`` tables or models side by side.  Returns the check report (or None).

    Sources land flat and stamped (``normalise``), each write audited.
    Table-layer models, and the views named in ``written``, are published under
    their names in the warehouse folder; of each, the newest ``keep_versions``
    versions stay (all by default).
    """
    if not skip_ingest:
        land_sources(spark, raw_root, sources, normalise=normalise, threads=threads)
    if skip_transform:
        return None
    tables = [m for m in models if LAYERS.get(m) == "table" or m in written]
    w = Warehouse(spark, landed_raw(spark, raw_root, source_of), materialize=tables)
    w.build(models, threads)
    if keep_versions is not None:
        for m in tables:
            vacuum(spark, warehouse_dir(spark), TABLES, m, keep_versions)
    if not checks:
        return None
    return run_checks(w.ref, list(checks)).orderBy(F.col("status"), "model", "column_name")
