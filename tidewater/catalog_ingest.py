"""Queries that put the readers, sinks and normalisers to work on whole driver tables.

Each writes a driver table in full to a new folder under the shared
checkpoint folder in the format of a feed, reads it back with the library's
reader and returns rows that DuckDB computes from the original table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.casts import try_cast_int, try_cast_long
from tidewater.functions.dates import day_of_week_sunday0, iso_year_week
from tidewater.ops import diff_tables, last_sync
from tidewater.pipeline import append_then_dedup
from tidewater.plans.calendar import FISCAL_START_MONTH
from tidewater.session import apply_result_conf, checkpoint_dir
from tidewater.sources.files import list_files, read_csv_dir, read_json_pages, read_parquet_dir, stack, text_schema
from tidewater.sources.nested import explode_child, flatten_structs, stamp_load
from tidewater.sources.sinks import alias_views, record_load, record_loads, write_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_result_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: supplier written as CSV files, read as text, cast back."""
    path = _folder(spark)
    _table(spark, sf_dir, "supplier").repartition(3).write.option("header", True).csv(f"{path}/a")
    back = read_csv_dir(spark, path)
    return back.select(
        try_cast_long("s_suppkey").alias("s_suppkey"), "s_name", try_cast_int("s_nationkey").alias("s_nationkey"),
        F.col("s_acctbal").try_cast("double").alias("s_acctbal"),
    )


def ingest_parquet_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SET-2: customers in two folders of unlike schemas, merged by the reader."""
    path, customers = _folder(spark), _table(spark, sf_dir, "customer")
    customers.filter("c_custkey % 2 = 0").write.parquet(f"{path}/even")
    customers.filter("c_custkey % 2 = 1").drop("c_acctbal").write.parquet(f"{path}/odd")
    return read_parquet_dir(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def ingest_json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: parts as JSON lines, read as text columns, cast back."""
    path, parts = _folder(spark), _table(spark, sf_dir, "part")
    parts.repartition(4).write.json(path)
    back = read_json_pages(spark, path, text_schema(parts.columns), multiline=False)
    return back.select(
        try_cast_long("p_partkey").alias("p_partkey"), "p_name", "p_brand", "p_type", try_cast_int("p_size").alias("p_size"),
        F.col("p_retailprice").try_cast("double").alias("p_retailprice"),
    )


def ingest_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: one file per nation; the listing's count meets the table's."""
    path = _folder(spark)
    _table(spark, sf_dir, "supplier").write.partitionBy("s_nationkey").json(path)
    listed = list_files(spark, path, "*.json").select(F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int").alias("s_nationkey"), "length")
    return listed.groupBy("s_nationkey").agg((F.min("length") > 0).alias("has_bytes"))


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of records, landed as Parquet."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.struct(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("off")).alias("amount"))))
        .alias("lines"))
    orders = _table(spark, sf_dir, "orders")
    path = _folder(spark)
    orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("id"), F.struct("o_orderstatus").alias("lastState")).alias("Customer"), "lines"
    ).write.parquet(path)
    return spark.read.parquet(path)


def normalize_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-1: structs of nested orders as ``parent__child`` columns."""
    return flatten_structs(nested_orders(spark, sf_dir), keep_arrays=False)


def normalize_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-2: the lines of nested orders as a child table."""
    return explode_child(nested_orders(spark, sf_dir), "o_orderkey", "lines")


def stamp_load_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-3: row ids are unique over all of lineitem, equal rows included."""
    doubled = stack(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "lineitem"))
    stamped = stamp_load(doubled, "load-1")
    ids = stamped.groupBy("_dlt_load_id", "_dlt_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy(F.col("_dlt_load_id").alias("load_id")).agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("id_count"), F.min(F.length(F.split("_dlt_id", "-")[0])).alias("hash_digits"))


def append_dedup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SNK-2, WIN-1: orders written, a changed half appended, the latest version kept."""
    path, orders = _folder(spark), _table(spark, sf_dir, "orders").withColumn("version", F.lit(1))
    write_table(orders, path, "sales", "orders")
    changed = orders.filter("o_orderkey % 2 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(2)})
    out = append_then_dedup(spark, path, "sales", "orders", changed, ["o_orderkey"], [F.desc("version"), F.desc("o_orderdate"), F.desc("o_custkey")])
    return out.select("o_orderkey", "version")


def diff_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPS-9: orders against a build with rows gone, changed and a column dropped."""
    orders = _table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    other = orders.filter("o_orderkey % 7 <> 0").withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lit("?")).otherwise(F.col("o_orderstatus"))).drop("o_orderpriority")
    return diff_tables(orders, other, ["o_orderkey"])


def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, OPS-3: three audit rows of one source, one of them failed; the last finished one (``load_audit_orders`` has the whole tables' loads)."""
    path = _folder(spark)
    regions = _table(spark, sf_dir, "region")
    write_table(regions, path, "geo", "region")
    for status, at in ((0, "2024-01-02 03:04:05"), (1, "2024-02-02 00:00:00"), (0, "2024-01-01 00:00:00")):
        record_load(spark, path, "geo", status=status, inserted_at=at)
    synced = last_sync(spark.read.parquet(f"{path}/geo/_loads"))
    rows = spark.read.parquet(f"{path}/geo/region").select(F.lit("geo").alias("schema_name"), F.lit(None).cast("timestamp_ntz").alias("last_sync"), F.lit(1).alias("n"))
    both = synced.select("schema_name", "last_sync", F.lit(0).alias("n")).unionByName(rows)
    return both.groupBy("schema_name").agg(F.max("last_sync").alias("last_sync"), F.sum("n").alias("row_count"))


def load_audit_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, OPS-3: one audit row for each priority's month of orders (failed where its count is a multiple of four), the last finished one per priority."""
    path = _folder(spark)
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    loads = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("schema_name"), month.alias("month")).agg(
        (F.count(F.lit(1)) % 4 == 0).cast("int").alias("status"), F.max("o_orderdate").alias("inserted_at"))
    record_loads(loads.withColumn("load_id", F.concat_ws("/", "schema_name", "month")), path, "orders")
    written = spark.read.parquet(f"{path}/orders/_loads")
    synced = last_sync(written).select("schema_name", "last_sync", F.lit(0).alias("n"), F.lit(0).alias("failed"))
    rows = written.select("schema_name", F.lit(None).cast("timestamp_ntz").alias("last_sync"), F.lit(1).alias("n"), F.col("status").alias("failed"))
    return synced.unionByName(rows).groupBy("schema_name").agg(
        F.max("last_sync").alias("last_sync"), F.sum("n").alias("load_count"), F.sum("failed").alias("failed_count"))


def alias_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: alias views over the sales tables, counted through their new names."""
    names = {"customer": "stg_customer", "orders": "stg_order", "lineitem": "stg_order_line", "part": "stg_product", "supplier": "stg_vendor"}
    for name in names:
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    alias_views(spark, names)
    out = None
    for new in names.values():
        part = spark.table(new).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(new).alias("model"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


def calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-18..25, FN-40: calendar functions over every order's date."""
    d = F.col("o_orderdate").cast("date")
    m = F.month(d)
    late = m >= FISCAL_START_MONTH
    return _table(spark, sf_dir, "orders").groupBy(
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), m.alias("month"), F.weekofyear(d).alias("week"), iso_year_week(d).alias("year_week"),
        F.dayofmonth(d).alias("day_of_month"), day_of_week_sunday0(d).alias("day_of_week"), F.dayofyear(d).alias("day_of_year"),
        F.when(late, F.year(d) + 1).otherwise(F.year(d)).alias("fiscal_year"),
        F.when(late, m - (FISCAL_START_MONTH - 1)).otherwise(m + (13 - FISCAL_START_MONTH)).alias("fiscal_month"),
    ).agg(F.count(F.lit(1)).alias("order_count"))


def try_cast_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3, FN-15: bigint text near 2^53 and 2^63, with fractions and garbage, built from every order key."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 5 == 0, (F.lit(2**53) + k).cast("string"))
        .when(k % 5 == 1, (F.lit(2**63 - 1) - k).cast("string"))
        .when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".5")))
        .when(k % 5 == 3, F.concat(F.lit("-"), (F.lit(2**62) + k).cast("string")))
        .otherwise(F.concat(F.lit("x"), k.cast("string")))
    )
    typed = _table(spark, sf_dir, "orders").select(k, text.alias("t"))
    return typed.select("o_orderkey", "t", try_cast_long("t").alias("as_long"), try_cast_int("t").alias("as_int"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_csv, ingest_parquet_glob, ingest_json_pages, ingest_list_files, normalize_flatten, normalize_child, stamp_load_lineitem,
        append_dedup_orders, diff_orders, load_audit, load_audit_orders, alias_all, calendar_parts, try_cast_clean,
    )
}

ORACLES = {
    "ingest_csv": "select * from supplier",
    "ingest_parquet_glob": "select c_custkey, c_name, c_nationkey, case when c_custkey % 2 = 0 then c_acctbal end as c_acctbal, c_mktsegment from customer",
    "ingest_json_pages": "select * from part",
    "ingest_list_files": "select distinct s_nationkey, true as has_bytes from supplier",
    "normalize_flatten": """
        select o_orderkey, o_custkey as customer__id, o_orderstatus as customer__last_state__o_orderstatus
        from orders where o_orderkey in (select l_orderkey from lineitem)""",
    "normalize_child": """
        select o.o_orderkey as _dlt_parent_id,
          (row_number() over (partition by o.o_orderkey, o.o_custkey, o.o_orderdate order by l_linenumber, l_partkey, l_quantity, l_discount) - 1)::integer as _dlt_list_idx,
          l_linenumber, l_partkey, l_quantity as amount__qty, l_discount as amount__off
        from orders o join lineitem on l_orderkey = o.o_orderkey""",
    "stamp_load_lineitem": "select 'load-1' as load_id, 2 * count(*) as row_count, 2 * count(*) as id_count, 64 as hash_digits from lineitem",
    "append_dedup_orders": "select distinct o_orderkey, case when o_orderkey % 2 = 0 then 2 else 1 end as version from orders",
    "diff_orders": """
        with o as (select distinct on (o_orderkey) * from orders)
        select count(*) as rows_a, count(*) filter (where o_orderkey % 7 <> 0) as rows_b, count(*) filter (where o_orderkey % 7 = 0) as only_in_a,
          0::bigint as only_in_b, count(*) filter (where o_orderkey % 7 <> 0 and o_orderkey % 5 = 0) as changed,
          'o_orderpriority' as columns_only_in_a, '' as columns_only_in_b from o""",
    "load_audit_orders": """
        with loads as (
          select o_orderpriority as schema_name, date_trunc('month', o_orderdate) as month, count(*) % 4 = 0 as failed, max(o_orderdate)::timestamp as loaded_at
          from orders group by 1, 2)
        select schema_name, max(loaded_at) filter (where not failed) as last_sync, count(*) as load_count, count(*) filter (where failed) as failed_count
        from loads group by 1""",
    "load_audit": "select 'geo' as schema_name, timestamp '2024-01-02 03:04:05' as last_sync, count(*) as row_count from region",
    "alias_all": """
        select 'stg_customer' as model, count(*) as row_count from customer union all select 'stg_order', count(*) from orders
        union all select 'stg_order_line', count(*) from lineitem union all select 'stg_product', count(*) from part
        union all select 'stg_vendor', count(*) from supplier""",
    "calendar_parts": """
        with d as (select o_orderdate::date as d from orders)
        select date_part('year', d)::integer as year, date_part('quarter', d)::integer as quarter, date_part('month', d)::integer as month,
          date_part('week', d)::integer as week, date_part('yearweek', d)::integer as year_week, date_part('day', d)::integer as day_of_month,
          date_part('dow', d)::integer as day_of_week, date_part('doy', d)::integer as day_of_year,
          date_part('year', d + interval 6 month)::integer as fiscal_year, date_part('month', d::timestamp - interval 6 month)::integer as fiscal_month,
          count(*) as order_count
        from d group by all""",
    "try_cast_clean": """
        with t as (
          select o_orderkey, case o_orderkey % 5 when 0 then (9007199254740992 + o_orderkey)::varchar when 1 then (9223372036854775807 - o_orderkey)::varchar
            when 2 then o_orderkey::varchar || '.5' when 3 then '-' || (4611686018427387904 + o_orderkey)::varchar else 'x' || o_orderkey end as t
          from orders)
        select o_orderkey, t, case when t like 'x%' then null when t like '%.5' then o_orderkey + 1 else try_cast(t as bigint) end as as_long,
          case when t like '%.5' then (o_orderkey + 1)::integer end as as_int
        from t""",
}
