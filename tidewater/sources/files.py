"""File readers (SRC-1, SRC-2, SRC-3, SRC-5, SRC-8); every reader returns all records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

def read_csv_dir(
    spark: SparkSession,
    path: str,
    glob: str = "*.csv",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Every CSV under ``path`` (recursive), header row, all columns text."""
    reader = (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("encoding", "UTF-8")
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_parquet_dir(
    spark: SparkSession,
    path: str,
    glob: str = "*.parquet",
    merge_schema: bool = True,
) -> DataFrame:
    """Every Parquet file under ``path``; drifted schemas are merged."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("mergeSchema", merge_schema)
        .parquet(path)
    )


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File metadata rows (path, modificationTime, length) without parsing (SRC-3)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "modificationTime", "length")
    )


def text_schema(columns: Sequence[str]) -> StructType:
    """All-string schema: how JSON API pages are landed before staging casts."""
    return StructType([StructField(c, StringType(), True) for c in columns])


def read_json_pages(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Landed JSON pages (one file per page, each an array of records) (SRC-5).

    With a schema (usually :func:`text_schema`) nothing is inferred; one file
    per page gives one task per page.
    """
    reader = spark.read.option("multiLine", multiline).option("recursiveFileLookup", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("primitivesAsString", True)
    return reader.json(path)


def select_datasets(datasets: Mapping[str, str], years: tuple[int, int]) -> dict[str, str]:
    """Datasets whose year range overlaps ``years``; table name from the range (SRC-8).

    ``{"2023-2024": id, "2025": id}`` with ``(2024, 2025)`` ->
    ``{"bus_segment_speeds_2023_2024": id, "bus_segment_speeds_2025": id}``.
    """
    lo, hi = years
    out = {}
    for rng, ident in datasets.items():
        parts = [int(p) for p in rng.split("-")]
        a, b = parts[0], parts[-1]
        if a <= hi and b >= lo:
            out["bus_segment_speeds_" + rng.replace("-", "_")] = ident
    return out


def stack(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns become NULL (SET-2)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def with_source_tag(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))
