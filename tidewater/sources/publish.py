"""Findable layer tables: versioned publish behind a pointer (SNK-4) and incremental upsert (SNK-2, WIN-1).

A table is the folder ``<root>/<layer>/<name>``.  Each publish writes the rows to
a version folder of its own and, when that is complete, one small numbered file
in ``_versions`` that says which folders make up the table, which partitions
count in each, and the schema.  Readers resolve the newest such file, so a
build that dies half-way leaves the former version as it was, a second session
finds the tables by name, and readers of an older version are not disturbed.
Two writers cannot take the same number: the file is created, never replaced; an
upsert whose table moved on meanwhile fails and is to be run again.

An upsert rewrites only the partitions that a batch touches (those of its rows,
and those in which its keys stand now); all others stay the same files.  The
pointer's size is bounded by the number of partitions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators.windows import dedup_latest

VERSIONS = "_versions"
NULL_PARTITION = "\x00null"


def _path(spark: SparkSession, uri: str):
    """(Hadoop file system, path) of a URI, so any store Spark reads will do (SNK-5)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _children(spark: SparkSession, uri: str) -> list[str]:
    fs, path = _path(spark, uri)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _read_text(spark: SparkSession, uri: str) -> str:
    fs, path = _path(spark, uri)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create_text(spark: SparkSession, uri: str, text: str) -> None:
    """Create a file; fails if it is there."""
    fs, path = _path(spark, uri)
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def table_root(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{name}"


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the complete versions of a table, oldest first."""
    return [int(n.removesuffix(".json")) for n in _children(spark, f"{table}/{VERSIONS}") if n.endswith(".json")]


def version(spark: SparkSession, table: str, number: int | None = None) -> dict:
    """The pointer of a version (the newest by default); a torn newest pointer file is passed over."""
    found = versions(spark, table) if number is None else [number]
    for n in reversed(found):
        try:
            return json.loads(_read_text(spark, f"{table}/{VERSIONS}/{n:012d}.json")) | {"number": n}
        except json.JSONDecodeError:
            if number is not None:
                raise
    raise FileNotFoundError(f"no published version of {table}")


def _point(spark: SparkSession, table: str, schema: StructType, partition_by: Sequence[str], folders: list[dict], only: int | None = None) -> int:
    """Create the next pointer file, or that of number ``only``; returns its number."""
    pointer = json.dumps({"schema": schema.jsonValue(), "partition_by": list(partition_by), "folders": folders})
    first = max(versions(spark, table), default=0) + 1
    for number in [only] if only is not None else range(first, first + 100):
        try:
            _create_text(spark, f"{table}/{VERSIONS}/{number:012d}.json", pointer)
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
    raise RuntimeError(f"other writers took every number of {table}")


def _write(df: DataFrame, table: str, partition_by: Sequence[str]) -> str:
    folder = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{table}/{folder}")
    return folder


def _label(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NULL_PARTITION))


def _labels(df: DataFrame, column: str) -> list[str]:
    """The distinct partition labels, one a partition."""
    return sorted(r[0] for r in df.select(_label(column)).distinct().collect())


def publish(df: DataFrame, root: str, layer: str, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as the new version of a table and read that version back (the lineage cut)."""
    spark, table = df.sparkSession, table_root(root, layer, name)
    number = _point(spark, table, df.schema, partition_by, [{"folder": _write(df, table, partition_by), "partitions": None}])
    return published(spark, root, layer, name, number)


def published(spark: SparkSession, root: str, layer: str, name: str, number: int | None = None) -> DataFrame:
    """A published table: its newest version, or version ``number``."""
    table = table_root(root, layer, name)
    pointer = version(spark, table, number)
    schema = StructType.fromJson(pointer["schema"])
    parts = []
    for f in pointer["folders"]:
        # the schema is known: no footer inference, partition columns keep their types and places
        df = spark.read.schema(schema).parquet(f"{table}/{f['folder']}").select(*[F.col(f"`{c}`") for c in schema.names])
        parts.append(df if f["partitions"] is None else df.where(_label(pointer["partition_by"][0]).isin(f["partitions"])))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, root: str, layer: str, name: str, keys: Sequence[str], order: Sequence[Column]) -> list[str]:
    """Merge ``batch`` into a table published with one partition column; returns the labels of the rewritten partitions.

    Of the rows of a key, old and new, the first by ``order`` stays.  ``keys``
    may be null (equal to each other); rows of a key may move between
    partitions; partitions left without rows vanish.
    """
    spark, table = batch.sparkSession, table_root(root, layer, name)
    pointer = version(spark, table)
    (part,) = pointer["partition_by"]
    current = published(spark, root, layer, name, pointer["number"])
    batch = batch.select(*[F.col(f"`{c}`").cast(current.schema[c].dataType).alias(c) for c in current.columns])
    met = batch.select(*[F.col(k).alias(f"_new_{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_new_{i}")) for i, k in enumerate(keys)])
    holding = current.select(*keys, *[c for c in [part] if c not in keys]).join(met, same, "left_semi")
    touched = _labels(holding.select(part).union(batch.select(part)), part)
    if not touched:
        return []
    merged = dedup_latest(current.where(_label(part).isin(touched)).union(batch), list(keys), list(order))
    folder = _write(merged, table, [part])
    written = spark.read.schema(current.schema).parquet(f"{table}/{folder}")
    folders = []
    for f in pointer["folders"]:
        old = f["partitions"] if f["partitions"] is not None else _labels(spark.read.schema(current.schema).parquet(f"{table}/{f['folder']}"), part)
        rest = sorted(set(old) - set(touched))
        folders += [{"folder": f["folder"], "partitions": rest}] if rest else []
    _point(spark, table, current.schema, [part], [*folders, {"folder": folder, "partitions": _labels(written, part)}], pointer["number"] + 1)
    return touched


def vacuum(spark: SparkSession, root: str, layer: str, name: str, keep: int = 2) -> list[str]:
    """Remove what none of the newest ``keep`` versions needs; returns the removed folders."""
    table = table_root(root, layer, name)
    numbers = versions(spark, table)
    needed = {f["folder"] for n in numbers[-keep:] for f in version(spark, table, n)["folders"]}
    gone = [c for c in _children(spark, table) if c.startswith("v-") and c not in needed]
    for n in numbers[:-keep]:
        fs, path = _path(spark, f"{table}/{VERSIONS}/{n:012d}.json")
        fs.delete(path, False)
    for folder in gone:
        fs, path = _path(spark, f"{table}/{folder}")
        fs.delete(path, True)
    return gone
