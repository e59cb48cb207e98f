"""Profiling, freshness and table introspection (OPS-1..10, PRJ-13).

Everything returns a DataFrame computed by Spark; only scalar settings
(table names, thresholds, ``as_of``) live on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
INTERNAL_TABLES = {"_dlt_loads", "_dlt_pipeline_state", "_dlt_version"}
INTERNAL_COLUMNS = {"_dlt_load_id", "_dlt_id", "_dlt_parent_id", "_dlt_list_idx"}
FRESH_GREEN_HOURS = 24
FRESH_YELLOW_HOURS = 24 * 7
# ---------------------------------------------------------------------------


def clean_column_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def stageable_tables(names: Sequence[str]) -> list[str]:
    """Tables auto staging applies to: not internal, not nested (no ``__``)."""
    return [n for n in names if n not in INTERNAL_TABLES and "__" not in n]


def auto_stage(df: DataFrame) -> DataFrame:
    """Clean column names (lower case, spaces -> '_') and drop internal
    load columns (PRJ-13)."""
    return df.select(
        *[F.col(f"`{c}`").alias(clean_column_name(c)) for c in df.columns if c not in INTERNAL_COLUMNS]
    )


def table_counts(tables: Mapping[str, Callable[[], DataFrame] | DataFrame | None]) -> DataFrame:
    """One row per table: (table_name, row_count); a missing table -> NULL (OPS-1).

    The per-table counts are unioned into one plan (one job, a stage per
    table), instead of a driver loop of ``count()`` actions.
    """
    parts = []
    spark = None
    for name in sorted(tables):
        src = tables[name]
        df = src() if callable(src) else src
        if df is None:
            continue
        spark = df.sparkSession
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count"))
    missing = [n for n in sorted(tables) if (tables[n] is None)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if missing and spark is not None:
        out = out.unionByName(
            spark.createDataFrame([(n, None) for n in missing], "table_name string, row_count long")
        )
    return out


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(database, table_name) of the catalog, internal tables excluded (OPS-2)."""
    rows = [(t.database or "", t.name) for t in spark.catalog.listTables(database) if t.name not in INTERNAL_TABLES]
    return spark.createDataFrame(rows, "database string, table_name string")


def describe_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, kind) for stageable tables (OPS-7)."""
    from tidewater.metrics.views import classify_type

    rows = []
    for name in stageable_tables(sorted(tables)):
        for f in tables[name].schema.fields:
            if f.name in INTERNAL_COLUMNS or isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                continue
            rows.append((name, clean_column_name(f.name), f.dataType.simpleString(), classify_type(f.dataType)))
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, kind string")


def last_sync(loads: DataFrame, by: Sequence[str] = ("schema_name",)) -> DataFrame:
    """``max(inserted_at) where status = 0`` per source (OPS-3)."""
    return loads.where(F.col("status") == 0).groupBy(*by).agg(F.max("inserted_at").alias("last_sync"))


def freshness_label(last: Column, as_of: Column) -> tuple[Column, Column]:
    """(label, colour) from the age ``as_of - last`` (OPS-4).

    < 1 h: 'Nm ago' green; < 24 h: 'Nh ago' green; < 7 d: 'Nd ago' yellow;
    otherwise 'Nd ago' red; never synced: 'never' red.
    """
    secs = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))
    hours = secs / F.lit(3600.0)
    mins = F.floor(secs / F.lit(60)).cast("long").cast("string")
    hrs = F.floor(hours).cast("long").cast("string")
    days = F.floor(hours / F.lit(24.0)).cast("long").cast("string")
    label = (
        F.when(last.isNull(), F.lit("never"))
        .when(hours < 1, F.concat(mins, F.lit("m ago")))
        .when(hours < FRESH_GREEN_HOURS, F.concat(hrs, F.lit("h ago")))
        .otherwise(F.concat(days, F.lit("d ago")))
    )
    colour = (
        F.when(last.isNull(), F.lit("red"))
        .when(hours < FRESH_GREEN_HOURS, F.lit("green"))
        .when(hours < FRESH_YELLOW_HOURS, F.lit("yellow"))
        .otherwise(F.lit("red"))
    )
    return label, colour


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, exact distinct count, min, max (OPS-10).

    Nulls, min and max of all columns come from one pass; each distinct
    count is a ``groupBy`` over that column alone (pruned to it by the scan,
    combined before its shuffle), so no row is ever copied per column.
    Min/max are shown as text; doubles as they are.
    """
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))]

    def column(f: T.StructField) -> Column:
        return F.col(f"`{f.name}`")

    one_pass = df.agg(F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count_if(column(f).isNull()).alias("null_count"),
            F.min(column(f)).cast("string").alias("min_value"),
            F.max(column(f)).cast("string").alias("max_value"),
        )
        for f in fields
    ]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    distinct = None
    for f in fields:
        values = df.select(column(f).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.lit(1).alias("one"))
        part = values.agg(F.count("one").alias("distinct_count")).select(F.lit(f.name).alias("column_name"), "distinct_count")
        distinct = part if distinct is None else distinct.unionByName(part)
    return one_pass.join(F.broadcast(distinct), "column_name").select(  # one row per column
        "column_name", "data_type", "null_count", "distinct_count", "min_value", "max_value"
    )


def bucket_checksums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int, side: str) -> DataFrame:
    """Per bucket of keys: rows and checksums that do not depend on the order of the rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in [*keys, *columns]])
    return df.select(_bucket(keys, buckets).alias("_bucket"), h.alias("h")).groupBy("_bucket").agg(
        F.count(F.lit(1)).alias(f"rows_{side}"), F.bit_xor("h").alias(f"xor_{side}"), F.sum(F.col("h").cast("decimal(20,0)")).alias(f"sum_{side}"))


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), *[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def unequal_buckets(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """All buckets of keys with their row counts and whether the two sides differ (``buckets`` rows at most)."""
    both = bucket_checksums(a, keys, columns, buckets, "a").join(bucket_checksums(b, keys, columns, buckets, "b"), "_bucket", "full_outer")
    equal = reduce(Column.__and__, [F.col(f"{x}_a").eqNullSafe(F.col(f"{x}_b")) for x in ("rows", "xor", "sum")])
    return both.select("_bucket", F.coalesce("rows_a", F.lit(0)).alias("rows_a"), F.coalesce("rows_b", F.lit(0)).alias("rows_b"), (~equal).alias("differs"))


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], buckets: int = 1 << 16) -> DataFrame:
    """Row-count / schema / content comparison of two builds (OPS-9).

    Each side is read once for the checksums of its key buckets; only rows of
    buckets that differ are shuffled, to a full outer join on the keys, where a
    row is 'changed' when a non-key column differs (null-safe).  Equal builds
    shuffle ``buckets`` rows a task at most.  Two checksums of 64-bit hashes and
    the row count must agree for a bucket to be taken as equal.
    """
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    compared = unequal_buckets(a, b, keys, shared, buckets)
    differing = compared.where("differs").select("_bucket")

    def rows(df: DataFrame, side: str) -> DataFrame:
        # at most ``buckets`` rows of one number each
        some = df.withColumn("_bucket", _bucket(keys, buckets)).join(F.broadcast(differing), "_bucket", "left_semi")
        return some.select(*keys, F.struct(*shared).alias(f"_{side}"), F.lit(True).alias(f"_in_{side}"))

    j = rows(a, "a").join(rows(b, "b"), list(keys), "full_outer")
    names = ["rows_a", "rows_b", "only_in_a", "only_in_b", "changed"]
    counts = compared.agg(F.sum("rows_a").alias("rows_a"), F.sum("rows_b").alias("rows_b"))
    found = j.agg(
        F.count_if(F.col("_in_b").isNull()).alias("only_in_a"),
        F.count_if(F.col("_in_a").isNull()).alias("only_in_b"),
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b")))
        .alias("changed"),
    )
    # one row each, added up
    return counts.unionByName(found, allowMissingColumns=True).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).select(
        "*",
        F.lit(",".join(sorted(set(a.columns) - set(b.columns)))).alias("columns_only_in_a"),
        F.lit(",".join(sorted(set(b.columns) - set(a.columns)))).alias("columns_only_in_b"),
    )


def register_views(w, names: Sequence[str]) -> None:
    """Expose models as temp views for ad-hoc SQL (OPS-6, MET-7)."""
    for n in names:
        w.ref(n).createOrReplaceTempView(n)


def sql(w, text: str, models: Sequence[str] = ()) -> DataFrame:
    """Ad-hoc read-only SQL over the named models (OPS-6)."""
    register_views(w, models)
    return w.spark.sql(text)
