"""Table writers (SNK-1..5) and the load audit (SNK-3)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.session import warehouse_dir
from tidewater.sources.publish import publish, published


def table_path(root: str, layer: str, name: str) -> str:
    """``<root>/<layer>/<name>``; ``root`` may be any Hadoop URI (SNK-5)."""
    return f"{root.rstrip('/')}/{layer}/{name}"


def write_table(
    df: DataFrame,
    root: str,
    layer: str,
    name: str,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> str:
    """Replace (``overwrite``) or extend (``append``) a Parquet table (SNK-1, SNK-2)."""
    path = table_path(root, layer, name)
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


#: Layer folder of the models that a warehouse writes.
TABLES = "tables"


def materialize_table(
    spark: SparkSession,
    df: DataFrame,
    name: str,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Publish a model once under the warehouse folder and read that version back (SNK-4).

    The written table is the lineage cut: downstream stages restart from it.
    Other sessions find its newest version with ``published_table``.
    """
    return publish(df, warehouse_dir(spark), TABLES, name, partition_by or ())


def published_table(spark: SparkSession, name: str) -> DataFrame:
    """The newest published version of a model, built by this or another session."""
    return published(spark, warehouse_dir(spark), TABLES, name)


def view(df: DataFrame, name: str) -> DataFrame:
    """View layer: register the plan under a name, nothing is computed."""
    df.createOrReplaceTempView(name)
    return df


def alias_views(spark: SparkSession, mapping: dict[str, str]) -> None:
    """Expose table ``a`` under name ``b`` for every ``a -> b`` (SNK-6)."""
    for src, dst in mapping.items():
        spark.table(src).createOrReplaceTempView(dst)


LOADS_SCHEMA = "load_id string, schema_name string, status int, inserted_at timestamp_ntz"


def record_load(
    spark: SparkSession,
    root: str,
    schema_name: str,
    status: int = 0,
    load_id: str | None = None,
    inserted_at: str | None = None,
) -> str:
    """Append one audit row to ``<root>/<schema>/_loads`` (status 0 = ok)."""
    load_id = load_id or uuid.uuid4().hex
    row = spark.createDataFrame([(load_id, schema_name, status, None)], LOADS_SCHEMA)
    ts = F.lit(inserted_at).cast("timestamp_ntz") if inserted_at else F.localtimestamp()
    row = row.withColumn("inserted_at", ts)
    return write_table(row, root, schema_name, "_loads", mode="append")


def record_loads(loads: DataFrame, root: str, folder: str) -> str:
    """Append many audit rows (the columns of ``LOADS_SCHEMA``), computed by Spark, to ``<root>/<folder>/_loads``."""
    kinds = [c.strip().split(" ") for c in LOADS_SCHEMA.split(",")]
    return write_table(loads.select(*[F.col(c).cast(t).alias(c) for c, t in kinds]), root, folder, "_loads", mode="append")


#: What a landing write observes of each table, one row a table and load (``<root>/<schema>/_load_tables``).
LOAD_TABLES_SCHEMA = "load_id string, table_name string, row_count long, null_keys long"


def land_table(df: DataFrame, root: str, schema_name: str, name: str, keys: Sequence[str] = ()) -> tuple[str, int, int]:
    """Replace a raw table; its path, its rows, and its rows with a null in ``keys``.

    The figures are observed by the write itself, so the table is not read a
    second time, and a task that runs again counts once.
    """
    seen = Observation()
    null_key = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys], F.lit(False))
    path = write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(null_key).alias("nulls")), root, schema_name, name)
    return path, seen.get["rows"], seen.get["nulls"]


def record_tables(spark: SparkSession, root: str, schema_name: str, load_id: str, figures: Sequence[tuple[str, int, int]]) -> None:
    """Append what a load wrote, ``(table, rows, null keys)`` each, in one write: two writes that append
    to one folder at a time would take each other's temporary files."""
    rows = spark.createDataFrame([(load_id, *f) for f in figures], LOAD_TABLES_SCHEMA)
    write_table(rows.coalesce(1), root, schema_name, "_load_tables", mode="append")


def landed_status(spark: SparkSession, root: str, schemas: Sequence[str]) -> DataFrame:
    """Per source the tables, rows and null keys of its last finished load, from the audit alone (OPS-5).

    A source that never finished a load has no tables and a NULL time.
    """
    parts = []
    for name in schemas:
        loads = spark.read.schema(LOADS_SCHEMA).parquet(table_path(root, name, "_loads")).where("status = 0 and schema_name is not null")
        newest = loads.groupBy("schema_name").agg(F.max(F.struct("inserted_at", "load_id")).alias("last"))
        tables = spark.read.schema(LOAD_TABLES_SCHEMA).parquet(table_path(root, name, "_load_tables"))
        of_last = tables.join(newest.select(F.col("last.load_id").alias("load_id"), F.col("last.inserted_at").alias("at")), "load_id")
        parts.append(of_last.agg(
            F.lit(name).alias("source"), F.count(F.lit(1)).alias("table_count"), F.sum("row_count").alias("total_rows"),
            F.sum("null_keys").alias("null_keys"), F.max("at").alias("last_sync")))
    return reduce(DataFrame.unionByName, parts)
