"""SQL database source (SRC-4).

Partitioned reads: with ``partition_col`` Spark issues ``num_partitions``
range queries in parallel instead of one full-table cursor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict | None = None,
    partition_col: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    num_partitions: int = 8,
) -> DataFrame:
    props = dict(properties or {})
    if partition_col is not None:
        if lower is None or upper is None:
            raise ValueError("partitioned JDBC reads need lower and upper bounds")
        return spark.read.jdbc(
            url, table, column=partition_col, lowerBound=lower, upperBound=upper,
            numPartitions=num_partitions, properties=props,
        )
    return spark.read.jdbc(url, table, properties=props)


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    tables: Sequence[str],
    properties: dict | None = None,
) -> dict[str, DataFrame]:
    """A filtered list of tables (the source's table filter)."""
    return {t: read_jdbc(spark, url, t, properties) for t in tables}
