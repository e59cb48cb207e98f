"""Queries for published tables, upserts, global order, exact percentiles and fraction casts over whole driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.casts import try_cast_int, try_cast_long
from tidewater.operators import order_statistics, with_positions
from tidewater.session import apply_result_conf, checkpoint_dir
from tidewater.sources.files import read_json_pages, text_schema
from tidewater.sources.nested import stamp_load
from tidewater.sources.publish import publish, published, upsert

LINE_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_result_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/layers-{uuid.uuid4().hex}"


def publish_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4: orders published twice, partitioned by priority; another session finds the second version."""
    root, orders = _root(spark), _table(spark, sf_dir, "orders")
    publish(orders.withColumn("o_totalprice", F.lit(0.0)), root, "sales", "orders", ["o_orderpriority"])
    publish(orders, root, "sales", "orders", ["o_orderpriority"])
    return published(spark.newSession(), root, "sales", "orders")


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, WIN-1: orders published by month; every tenth month delivered again with other prices, a few
    orders of it moved to the month after; only those months are rewritten."""
    root, month = _root(spark), F.date_format("o_orderdate", "yyyy-MM")
    orders = _table(spark, sf_dir, "orders").withColumns({"month": month, "version": F.lit(1)})
    publish(orders, root, "sales", "orders", ["month"])
    number = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    moved = F.when(F.col("o_orderkey") % 50 == 0, F.add_months("o_orderdate", 1).cast(orders.schema["o_orderdate"].dataType)).otherwise(F.col("o_orderdate"))
    batch = orders.where(number % 10 == 0).withColumns(
        {"o_totalprice": F.col("o_totalprice") + 1, "version": F.lit(2), "o_orderdate": moved}).withColumn("month", month)
    upsert(batch, root, "sales", "orders", ["o_orderkey"], [F.desc("version"), F.desc("o_orderdate")])
    return published(spark, root, "sales", "orders").select("o_orderkey", "o_totalprice", "month", "version")


def lineitem_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4, WIN-7: rank by ship date and running quantity over all of lineitem."""
    lines = _table(spark, sf_dir, "lineitem")
    exact = lines.withColumn("quantity", F.col("l_quantity").cast("decimal(18,2)"))
    placed = with_positions(exact, [F.asc_nulls_last(c) for c in LINE_ORDER], "position", {"running_quantity": "quantity"})
    return placed.select("l_orderkey", "l_linenumber", "l_shipdate", "position", F.col("running_quantity").cast("double").alias("running_quantity"))


def lineitem_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11: exact quartiles and the 99th percentile of the price by return flag and line status."""
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    return order_statistics(_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", shares)


def stamp_load_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NRM-3: lineitem's ids, all rows twice, are the same when the rows lie otherwise."""
    lines = _table(spark, sf_dir, "lineitem")

    def twice(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__copy")

    # ids of 66 characters meet by the 16 bytes of their MD5
    met = F.unhex(F.md5("_dlt_id"))
    again = stamp_load(twice(lines.repartition(7, "l_partkey")), "b", copies_at_once=1).select(met.alias("other"))
    both = stamp_load(twice(lines), "a").select("l_returnflag", met.alias("id")).join(again, F.col("id") == F.col("other"), "left")
    return both.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("other").alias("same_count"), F.countDistinct("id").alias("id_count"))


def ingest_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5: supplier as pages, one file a page and one array of records a file, read as text."""
    path, suppliers = f"{_root(spark)}/pages", _table(spark, sf_dir, "supplier")
    page = F.floor(F.col("s_suppkey") / 50)
    pages = suppliers.groupBy(page.alias("page")).agg(F.to_json(F.collect_list(F.struct(*suppliers.columns))).alias("value"))
    # one file a page: each page number is a folder
    pages.repartition("page").write.partitionBy("page").text(path)
    back = read_json_pages(spark, path, text_schema(suppliers.columns), multiline=True)
    return back.select(
        try_cast_long("s_suppkey").alias("s_suppkey"), "s_name", try_cast_int("s_nationkey").alias("s_nationkey"),
        F.col("s_acctbal").try_cast("double").alias("s_acctbal"))


def try_cast_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3, FN-15: whole numbers from texts with long fractions, built from every order key."""
    k = F.col("o_orderkey")
    tails = ["0.49999999999", ".5", ".50000000000000001", "0.4999999999999999999999", ".", ".999999999999", "0.5x", " "]
    text = F.concat(F.when(k % 3 == 0, F.lit("-")).otherwise(F.lit("")), k.cast("string"), F.element_at(F.array(*map(F.lit, tails)), (k % 8 + 1).cast("int")))
    typed = _table(spark, sf_dir, "orders").select(k, text.alias("t"))
    return typed.select("o_orderkey", "t", try_cast_long("t").alias("as_long"), try_cast_int("t").alias("as_int"))


QUERIES = {
    f.__name__: f
    for f in (publish_orders, upsert_orders, lineitem_positions, lineitem_quartiles, stamp_load_stable, ingest_json_arrays, try_cast_fractions)
}

_LINES = ", ".join(f"{c} nulls last" for c in LINE_ORDER)

ORACLES = {
    "publish_orders": "select * from orders",
    "upsert_orders": """
        with o as (select *, (year(o_orderdate) * 12 + month(o_orderdate)) % 10 = 0 as again from orders)
        select o_orderkey, case when again then o_totalprice + 1 else o_totalprice end as o_totalprice,
          strftime(case when again and o_orderkey % 50 = 0 then o_orderdate::date + interval 1 month else o_orderdate end, '%Y-%m') as month,
          case when again then 2 else 1 end as version
        from o""",
    "lineitem_positions": f"""
        select l_orderkey, l_linenumber, l_shipdate, row_number() over w as position,
          (sum(l_quantity::decimal(18,2)) over (w rows unbounded preceding))::double as running_quantity
        from lineitem window w as (order by {_LINES})""",
    "lineitem_quartiles": """
        select l_returnflag, l_linestatus, count(l_extendedprice) as n, quantile_cont(l_extendedprice, 0.25) as q1,
          quantile_cont(l_extendedprice, 0.5) as median, quantile_cont(l_extendedprice, 0.75) as q3, quantile_cont(l_extendedprice, 0.99) as p99
        from lineitem group by all""",
    "stamp_load_stable": "select l_returnflag, 2 * count(*) as row_count, 2 * count(*) as same_count, 2 * count(*) as id_count from lineitem group by all",
    "ingest_json_arrays": "select * from supplier",
    "try_cast_fractions": """
        with t as (
          select o_orderkey, (case when o_orderkey % 3 = 0 then '-' else '' end) || o_orderkey || (['0.49999999999', '.5', '.50000000000000001',
            '0.4999999999999999999999', '.', '.999999999999', '0.5x', ' '])[o_orderkey % 8 + 1] as t
          from orders)
        select o_orderkey, t, try_cast(t as bigint) as as_long, try_cast(t as integer) as as_int from t""",
}
