"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir

#: The columns of the ``documents`` table, which every filtering stage returns.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, buckets: int) -> Column:
    """``crc32(key as text) mod buckets``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch between Spark and Python where rows hold whole texts, or whole blocks of them.
TEXT_ROWS = 1000
BLOCK_ROWS_A_BATCH = 8


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Bound the rows of an Arrow batch, of which executors hold several copies, for the actions inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor; later steps
    reuse the rows instead of computing them again.  ``group_bytes`` bounds the
    row groups, which readers and writers hold in memory, of tables with large rows.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", str(group_bytes))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, group_bytes: int) -> DataFrame:
    """Write ``df`` to the shared folder dealt by ``key`` into ``buckets`` and read it back.

    Rows that meet it by ``key`` are shuffled to its buckets, its own rows are not shuffled again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("parquet.block.size", str(group_bytes))
    writer.option("path", path).saveAsTable(table_name, format="parquet")
    found = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")  # its name; the files stay
    return found


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of ``2 ** bits`` bits (15 at least) with the bit of each 64-bit hash's ``bits`` high bits set."""
    place = F.shiftrightunsigned(column, 64 - bits) + 1
    parts = (
        hashes.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = bytearray(1 << bits >> 3)
    for r in parts.collect():  # at most 2 ** bits / 32768 rows of 4 KiB
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(out)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each (unsigned) hash is set: surely so for hashes put in, seldom for others."""
    slot = hashes >> np.uint64(64 - bits)
    return bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def byte_runs(texts: list[bytes], lead: int, limit: int = 1 << 20):
    """Cut texts into runs of about ``limit`` bytes for array work.

    Yields ``(owners, parts)``: parts of texts and the text each belongs to.
    A long text becomes several parts, each led by the ``lead`` bytes before
    it; a text's first part is led by ``lead`` spaces.
    """
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), limit):
            before = t[max(0, at - lead) : at]
            part = b" " * (lead - len(before)) + before + t[at : at + limit]
            owners.append(i)
            parts.append(part)
            size += len(part)
            if size >= limit:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


SHARE_STEPS = 1 << 30


def chance(*columns: Column) -> Column:
    """A number below ``SHARE_STEPS`` drawn by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(SHARE_STEPS))


def share_of(column: Column, shares: dict) -> Column:
    """Rows to keep so that each value of ``column`` keeps its share (0 to 1)."""
    steps = F.lit(0)
    for value, share in shares.items():
        steps = F.when(column == F.lit(value), F.lit(int(share * SHARE_STEPS))).otherwise(steps)
    return F.col("h") < steps


#: A long text gives a sample that part of a label's bytes at most, in windows of so many bytes.
LONGEST_SHARE = 16
SAMPLE_WINDOW = 4096


def sampled_windows(text: str, size: int, seed: int) -> str:
    """``text``, or of one above ``size`` bytes whole words from seeded windows of it, ``size`` bytes at most."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= size:
        return text
    step = min(SAMPLE_WINDOW, size)
    starts = np.random.default_rng(seed).choice(-(-len(data) // step), max(1, size // (step + 1)), replace=False)
    parts = []
    for at in sorted(starts.tolist()):
        words = data[at * step : (at + 1) * step]
        # words cut at the window's ends are left out, where it holds others
        inner = words if at == 0 else words[len(words.split(None, 1)[0]) :] if words[:1].strip() and len(words.split()) > 2 else words
        if (at + 1) * step < len(data) and inner[-1:].strip() and len(inner.split()) > 1:
            inner = inner[: len(inner) - len(inner.split()[-1])]
        parts.append(inner.decode("utf-8", "ignore").strip())
    return " ".join(parts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bounds: dict | int, bytes_bound: int,
                    key: str = "doc_id", text: str = "text") -> tuple[list, dict]:
    """A bounded sample of labelled texts: rows ``(text, label, h)`` and the share drawn of each label.

    ``bounds`` maps each label value to its expected number of rows, or is that
    number for every non-null label.  Keys are drawn by their hash from the
    labels alone, so only drawn texts leave the scan (the drawn keys are few by
    ``bounds`` and broadcast).  Equal rows count once.  The text of one label is
    held to ``bytes_bound``: its rows are taken in the order of their hashes up
    to it, one at least, and a text gives ``1 / LONGEST_SHARE`` of it at most,
    in windows; so a long text pushes out no label and no short ones.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label"), chance(F.col(key)).alias("h"))
    wanted = F.col("label").isin(*bounds) if isinstance(bounds, dict) else F.col("label").isNotNull()
    known = known.filter(wanted & F.col("key").isNotNull())
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {v: min(1.0, (bounds[v] if isinstance(bounds, dict) else bounds) / n) for v, n in counts.items()}
    drawn = known.filter(share_of(F.col("label"), shares)).distinct()
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = written(texts.join(F.broadcast(drawn), "key").dropDuplicates(["key", "text", "label"]), "sample")
    longest = max(1, bytes_bound // LONGEST_SHARE)
    # the rows of a label are few by ``bounds``; they go without their texts
    rows = found.select("label", "h", "key", F.xxhash64("text").alias("tie"), F.least(F.octet_length("text"), F.lit(longest)).alias("b"))
    order = Window.partitionBy("label").orderBy("h", "key", "tie")
    before = F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("b")
    taken = rows.withColumn("before", before).filter((F.col("before") == 0) | (F.col("before") + F.col("b") <= bytes_bound))
    taken = written(taken.select("label", "key", "tie"), "taken")
    had, have = ({r.label: r.n for r in x.groupBy("label").agg(F.count("*").alias("n")).collect()} for x in (found, taken))
    shares = {v: shares[v] * n / had[v] for v, n in have.items()}
    sample = found.withColumn("tie", F.xxhash64("text")).join(F.broadcast(taken), ["label", "key", "tie"], "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [sampled_windows(t, longest, h) for t, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.string()), *b.columns[1:]], names=b.schema.names)

    short = sample.select("text", "label", "h", "key")
    return short.mapInArrow(cut, short.schema).orderBy("h", "key", "text").select("text", "label", "h").collect(), shares
