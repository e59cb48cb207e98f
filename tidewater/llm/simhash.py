"""SimHash near-duplicate search with pigeonhole blocks.

A fingerprint is the 64-bit majority vote over the XXH64 values (seed 42) of
a text's word shingles.  Two fingerprints link when they differ in at most
``max_bits`` bits.  The 64 bits are cut into ``blocks`` blocks; ``max_bits``
differing bits leave at least ``blocks - max_bits`` blocks untouched, so every
linked pair shares one of the C(blocks, max_bits) combinations of untouched
blocks.  Fingerprints meet on those combinations (an equality key), the
Hamming distance is verified inside each bucket, and a bucket hands on only a
spanning forest of its links: a dense group of n fingerprints gives n - 1
rows, not n * n / 2, and the components stay exactly those of the full link
graph.  A bucket above ``chunk`` fingerprints is dealt out as pairs of chunks,
so no task ever holds more than two chunks whatever the bucket's size.

Random collisions grow as n^2 / 2^(64 (blocks - max_bits) / blocks); raise
``blocks`` with the corpus (5 gives 25-bit keys, 8 gives 40-bit keys).

Defined results: a null text counts as empty; a text without a word has
fingerprint zero, which links like any other; repeated rows come back once
per row; null ids never become a component's id unless all its ids are null;
an empty table gives no rows; extra input columns are ignored by
``fingerprints`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

SEED = 42
WORDS_PER_VOTE = 1 << 14  # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash of one text (unsigned); zero without words."""
    import xxhash

    # bytes.lower() folds A-Z only and bytes.split() cuts at 0x20, 0x09-0x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for i in range(0, len(values), WORDS_PER_VOTE):
        part = values[i : i + WORDS_PER_VOTE].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: Column, text: str = "text", shingle_words: int = 3) -> DataFrame:
    """``keys`` plus ``fp`` (the fingerprint as a signed long) for every row."""
    rows = docs.select(*keys, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle_words) for t in b.column(b.num_columns - 1).to_pylist()), np.uint64, b.num_rows)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            names = b.schema.names[:-1] + ["fp"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fp.view(np.int64))], names=names)

    schema = rows.drop("__text").schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """Array of the bucket keys: for each choice of untouched blocks, its number and those blocks' bits."""
    if blocks <= max_bits:
        raise ValueError(f"blocks ({blocks}) must be above max_bits ({max_bits})")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, kept in enumerate(combinations(range(blocks), blocks - max_bits)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("combo"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def spanning_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    left = np.array(values, np.int64)
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count((left ^ np.int64(at)).view(np.uint64)) <= max_bits
            found = left[near].tolist()
            edges += [(at, x) for x in found]
            frontier += found
            left = left[~near]
    return edges


def links(nodes: DataFrame, max_bits: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """``a, b``: links that span every component of the distinct fingerprints ``nodes.fp``."""
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("k")).select("fp", "k.combo", "k.bits")
    # buckets of two and more, with the number of chunks each is dealt into
    sizes = (
        keyed.groupBy("combo", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        .select("combo", "bits", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("parts"))
    )
    dealt = (
        keyed.join(sizes, ["combo", "bits"])
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("combo", "bits", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "fp")
    )
    lists = dealt.groupBy("combo", "bits", "i", "j").agg(F.collect_list("fp").alias("fps")).select("fps")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for fps in batch.column(0).to_pylist() for e in spanning_links(np.array(fps, np.int64), max_bits)]
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.mapInArrow(verify, "a long, b long").distinct()


#: So many links, two numbers each, need no more tasks than there are cores.
FEW_LINKS = 1 << 20


def between(edges: DataFrame, labels: DataFrame, packed=lambda df: df) -> DataFrame:
    """``a, b``: the links whose ends have different ``labels (node, label)``, as links of those labels, each once."""
    x, y = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    met = packed(packed(edges.join(x, "a")).join(y, "b")).filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: every node of ``edges (a, b)`` with the smallest node that it reaches.

    A node takes its smallest neighbour's label, labels jump along the labels
    themselves until they rest (a chain of n nodes takes about log n jumps), and
    only links between different labels go on, as links of those: each round
    leaves half of the nodes at most, so a link is met once or twice, not once
    a round.  Each step is a checkpoint in the shared folder.  A round of few
    links has a task for each core in its steps, whatever the number of shuffle
    partitions; a round of many has those partitions.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    found = []
    links = edges.select("a", "b").checkpoint()
    while (count := links.count()) or not found:
        few = count <= FEW_LINKS

        def packed(df: DataFrame, few: bool = few) -> DataFrame:
            return df.coalesce(cores) if few else df

        links = packed(links)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
        labels = packed(labels).checkpoint()
        while True:
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = labels.join(up, "label").select("node", F.col("up").alias("label"), F.col("label").alias("was"))
            jumped = packed(jumped).checkpoint()
            labels = jumped.select("node", "label")
            if jumped.filter("label <> was").isEmpty():
                break
        found.append((labels, packed))
        links = packed(between(links, labels, packed)).checkpoint()
    while len(found) > 1:  # the labels of the last rounds name those of the rounds before
        last = found.pop()[0].select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels, packed = found.pop()
        named = packed(labels.join(last, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        found.append((named.checkpoint(), packed))
    return found[0][0]


def component_table(fps: DataFrame, key: str, max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """``fp, component``: for every distinct fingerprint the smallest ``key`` of its component."""
    nodes = fps.groupBy("fp").agg(F.min(key).alias("first_key")).checkpoint()
    labels = components(links(nodes, max_bits, blocks))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_key", F.coalesce("label", "fp").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("first_key").alias("component"))
    return named.select("fp", "label").join(smallest, "label").select("fp", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3,
                    max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """Per row: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``
    (smallest key reachable over links of at most ``max_bits`` bits)."""
    fps = written(fingerprints(docs, F.col(key).alias("doc_key"), text=text, shingle_words=shingle_words), "simhash")
    comp = component_table(fps, "doc_key", max_bits, blocks)
    return fps.join(comp, "fp").select(
        F.col("doc_key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3,
                         max_bits: int = 3, blocks: int = 5) -> DataFrame:
    """The rows of ``docs`` with one row of each component kept: the smallest key
    (nulls last), then the smallest text hash, of rows equal in both the one whose
    columns have the smallest hash.  Columns are unchanged, whatever their names."""
    has, num, body = F.col(key).isNull(), F.coalesce(F.col(key), F.lit(0)), F.xxhash64(F.col(text))
    row_key = F.struct(has.alias("no_key"), num.alias("num"), body.alias("body"))
    fps = written(fingerprints(docs, row_key.alias("row_key"), text=text, shingle_words=shingle_words), "simhash")
    kept = component_table(fps, "row_key", max_bits, blocks).select("component.*").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # a row travels in one struct, so no column of the input meets one of ours
    single = docs.select(row_key.alias("k"), F.struct(*columns).alias("row"), F.xxhash64(*hashed).alias("tie")).select("k.*", "row", "tie")
    # identical rows collapse before the shuffle, and the semi-join reuses its partitioning
    keys = ["no_key", "num", "body"]
    return single.groupBy(*keys).agg(F.min_by("row", "tie").alias("row")).join(kept, keys, "left_semi").select("row.*")
