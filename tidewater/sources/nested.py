"""Normalising nested records (NRM-1..3).

Landing flattens structs into ``parent__child`` columns and moves arrays of
records into child tables keyed by the parent row id and the list index;
:func:`normalised` does all of it for one table.
All of it is column expressions over ``df.schema``: no Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import checkpoint_dir

SEP = "__"


def snake(name: str) -> str:
    """'createdAt' / 'Created At' -> 'created_at'; leading underscores stay."""
    lead = name[: len(name) - len(name.lstrip("_"))]
    s = re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name)
    return lead + re.sub(r"[^0-9a-zA-Z]+", "_", s).strip("_").lower()


def _flat_columns(schema: T.StructType, prefix: list[str], keep_arrays: bool) -> list[Column]:
    out: list[Column] = []
    for f in schema.fields:
        path = prefix + [f.name]
        if isinstance(f.dataType, T.StructType):
            out += _flat_columns(f.dataType, path, keep_arrays)
        elif isinstance(f.dataType, T.ArrayType) and not keep_arrays:
            continue
        else:
            ref = F.col(".".join(f"`{p}`" for p in path))
            # a name that is a path already keeps its steps
            out.append(ref.alias(SEP.join(snake(step) for p in path for step in p.split(SEP))))
    return out


def flatten_structs(df: DataFrame, keep_arrays: bool = True) -> DataFrame:
    """Struct fields become ``parent__child`` columns, recursively (NRM-1).

    Arrays stay as they are unless ``keep_arrays=False`` (then they are
    left for :func:`explode_child`).
    """
    return df.select(*_flat_columns(df.schema, [], keep_arrays))


def explode_child(
    df: DataFrame,
    parent_id: str,
    array_col: str,
) -> DataFrame:
    """Child table of an array column: one row per element with
    ``_dlt_parent_id`` and ``_dlt_list_idx``; record elements are flattened
    (NRM-2).  Parents with an empty or NULL list produce no child rows.
    """
    exploded = df.select(
        F.col(parent_id).alias("_dlt_parent_id"),
        F.posexplode(F.col(array_col)).alias("_dlt_list_idx", "value"),
    )
    elem = df.schema[array_col].dataType.elementType
    if isinstance(elem, T.StructType):
        return flatten_structs(exploded.select("_dlt_parent_id", "_dlt_list_idx", "value.*"))
    return exploded


#: Equal rows written out by one task.
_COPIES_AT_ONCE = 1 << 20


def stamp_load(df: DataFrame, load_id: str, copies_at_once: int = _COPIES_AT_ONCE) -> DataFrame:
    """Add ``_dlt_load_id`` (constant) and ``_dlt_id`` (NRM-3).

    The id is the 256-bit hash of the row and the row's number among the rows
    equal to it, so it depends on the rows alone: a retry, another split or a
    second read gives the same ids.  Equal rows are counted (combined before
    the shuffle) and written out again from their count, in runs of
    ``copies_at_once``: the first where the count is, the others in different
    tasks; so many equal rows cost one row of shuffle a task, and no task
    gathers them.  The hash travels as 32 bytes, and columns that the caller
    does not use do not travel.
    """
    names = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.select(
        F.unhex(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)).alias("h"), *[c.alias(at) for at, c in names.items()])
    counted = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.first(at).alias(at) for at in names])
    numbers = F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(copies_at_once)) - 1)
    here = counted.select("h", *names, F.explode(numbers).alias("i"))
    more = F.sequence(F.lit(copies_at_once).cast("long"), F.col("n") - 1, F.lit(copies_at_once).cast("long"))
    runs = counted.where(F.col("n") > copies_at_once).select("h", *names, "n", F.explode(more).alias("from"))
    last = F.least(F.col("n"), F.col("from") + copies_at_once) - 1
    there = runs.repartition("h", "from").select("h", *names, F.explode(F.sequence(F.col("from"), last)).alias("i"))
    stamped = here.unionByName(there)
    return stamped.select(
        *[F.col(at).alias(c) for at, c in zip(names, df.columns)], F.lit(load_id).alias("_dlt_load_id"),
        F.concat_ws("-", F.lower(F.hex("h")), F.col("i").cast("string")).alias("_dlt_id"))


def _lists(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def normalised(df: DataFrame, name: str, load_id: str) -> dict[str, DataFrame]:
    """The flat tables of a table of nested records: ``name`` and a child per list, at any depth.

    Structs become ``parent__child`` columns; rows get their load id and row id
    (those that bring ``_dlt_id`` keep it).  A list becomes the table
    ``<name>__<column>`` with ``_dlt_parent_id``, ``_dlt_list_idx`` and an id
    made of both.  A table with lists is checkpointed to the shared folder, so
    that it is stamped once for all its children.
    """
    flat = flatten_structs(df)
    stamped = flat.withColumn("_dlt_load_id", F.lit(load_id)) if "_dlt_id" in flat.columns else stamp_load(flat, load_id)
    if _lists(stamped):
        checkpoint_dir(df.sparkSession)
        stamped = stamped.checkpoint()
    return _tables(stamped, name)


def _tables(df: DataFrame, name: str) -> dict[str, DataFrame]:
    lists = _lists(df)
    found = {name: df.drop(*lists)}
    for c in lists:
        child = explode_child(df, "_dlt_id", c)
        own_id = F.concat_ws("-", "_dlt_parent_id", F.col("_dlt_list_idx").cast("string"))
        found.update(_tables(child.withColumn("_dlt_id", own_id), name + SEP + c))
    return found
