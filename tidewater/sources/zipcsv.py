"""One CSV member out of many ZIP archives, read and written (SRC-6, SET-3).

Archives are listed by Spark's ``binaryFile`` source without their content
(one row per archive, spread over tasks by size).  Each task opens its archives by
path, reads the central directory at their end and streams the member's rows, so an archive
may be of any size: a task holds one batch of rows.  A missing member
gives 0 rows; a UTF-8 byte-order mark is stripped so the first header stays
intact.  No row passes through the driver.

``write_zip_csv`` is the way back: one archive per feed and volume, streamed by
the task that holds it.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


ROWS_AT_ONCE = 10_000
BOM = "﻿"


def _feed_name(path: str, pattern: str) -> str:
    m = re.search(pattern, path)
    return m.group(1) if m else path.rsplit("/", 1)[-1]


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path inside it of a local path or a URI."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))


def open_path(path: str) -> BinaryIO:
    """A seekable file of a store that pyarrow knows (local and mounted paths, HDFS, S3, GCS)."""
    store, inner = _store(path)
    return store.open_input_file(inner)


def read_zip_csv(
    spark: SparkSession,
    path: str,
    member: str,
    columns: Sequence[str],
    tag_col: str = "_borough",
    feed_pattern: str = r"([^/]+)\.zip$",
    glob: str = "*.zip",
    opener: Callable[[str], BinaryIO] | None = open_path,
) -> DataFrame:
    """Rows of ``member`` from every archive under ``path``.

    ``columns`` fixes the output schema (all text) so nothing is inferred;
    columns the member lacks are NULL, extra ones are dropped.  ``opener`` opens
    an archive inside a task; ``None`` lets Spark bring the packed archives, for
    stores that only Spark reads (2 GB an archive at most).
    """
    cols = list(columns)
    schema = StructType([StructField(c, StringType(), True) for c in cols] + [StructField(tag_col, StringType(), True)])

    def rows_of(archive: BinaryIO, path: str) -> Iterator[pd.DataFrame]:
        with archive, zipfile.ZipFile(archive) as zf:
            if member not in zf.namelist():
                return
            with zf.open(member) as raw:
                rows = csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
                # unpacked and parsed as it is read, a bounded number of rows at a time
                while part := list(islice(rows, ROWS_AT_ONCE)):
                    out = pd.DataFrame({c: [r.get(c) for r in part] for c in cols}, dtype=object)
                    out[tag_col] = _feed_name(path, feed_pattern)
                    yield out

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, p in enumerate(batch["path"]):
                yield from rows_of(opener(p) if opener else io.BytesIO(batch["content"][i]), p)

    archives = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", *([] if opener else ["content"]))
    )
    return archives.mapInPandas(unzip, schema)


def write_zip_csv(df: DataFrame, path: str, member: str, feed_col: str, volumes: int = 1) -> DataFrame:
    """Write ``df`` as archives ``<feed>-<volume>.zip`` under ``path``, each with one CSV ``member``.

    Values go out as text, NULL as an empty field.  ``volumes`` splits every
    feed by a hash of its rows, so that no large feed has to pass one task.
    Returns the written archives, ``feed, volume, rows``.  An archive is written
    under a name of its attempt and moved to its own when complete: a retry
    after a lost executor writes the same archive again.  ``path`` must be one
    that executors reach (a mount or a store of pyarrow's).
    """
    columns = [c for c in df.columns if c != feed_col]
    rows = df.select(
        F.col(feed_col).cast("string").alias("_feed"),
        F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(volumes)).cast("int").alias("_volume"),
        *[F.col(f"`{c}`").cast("string").alias(c) for c in columns],
    ).repartition("_feed", "_volume").sortWithinPartitions("_feed", "_volume")

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        at, done, n, streams = None, [], 0, []

        def close() -> None:
            if at is None:
                return
            for s in reversed(streams):
                s.close()
            store.move(temporary, f"{root}/{at[0]}-{at[1]}.zip")
            done.append((*at, n))

        for batch in batches:
            for (feed, volume), part in batch.groupby(["_feed", "_volume"], sort=False, dropna=False):
                if (feed, volume) != at:
                    close()
                    at, n = (feed, volume), 0
                    temporary = f"{root}/.{uuid.uuid4().hex}.part"
                    packed = store.open_output_stream(temporary)
                    zf = zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED)
                    text = io.TextIOWrapper(zf.open(member, "w", force_zip64=True), encoding="utf-8", newline="")
                    text.write(BOM)
                    streams = [packed, zf, text]
                    csv.writer(text).writerow(columns)
                csv.writer(text).writerows(part[columns].where(part[columns].notna(), "").itertuples(index=False, name=None))
                n += len(part)
        close()
        yield pd.DataFrame(done, columns=["feed", "volume", "rows"])

    return rows.mapInPandas(archives, "feed string, volume int, rows long")
