"""Ranked lexical search over bit-sliced Bloom signatures.

Every document row has a Bloom signature of its terms.  Signatures are kept
sliced: a block of documents has one bitmap per signature bit, a bit per
document, so a term's possible documents are the AND of a few bitmaps.  Blocks
hold documents of one length class and their signature is as wide as that class
needs (about ``BITS_PER_ENTRY`` bits an entry).  Besides ``(term, 1)`` a
document enters ``(term, t)`` for each step t of ``STEPS`` that the term's count
reaches, so the bitmaps bound the count from above as well as the presence.

A search takes the items in groups of bounded size.  One pass over the texts
counts the document frequencies of the group's terms.  For every item and
document the weighted sum of the slices then bounds the score from above: a
false positive can only raise it.  The ``k`` documents of the highest bounds are
scored from their texts, which gives a floor: a score that k documents reach.
All documents whose bound reaches the floor, that is all that are not provably
excluded, are scored exactly.  In one block, of candidates with the same text
only the k smallest keys go on, for the others score no better.

Defined results: a null or empty text has no term, counts in no statistic and
is never found; texts of any length are handled whole, one at a time; repeated
rows are documents of their own; equal scores are ordered by key, null keys
last; every item row is answered for itself, also where item ids repeat or are
null; items without a term found in any document, and empty tables, give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import BLOCK_ROWS_A_BATCH, small_batches, written

HASHES = 3
BITS_PER_ENTRY = 10
#: Counts at which a term gets a further entry.
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 1024)
#: Bits of a block (2 MiB), and its documents at most.
BLOCK_BITS = 1 << 24
BLOCK_ROWS = 2048
#: Texts waiting in a task for their blocks, in bytes.
PENDING_BYTES = 8 << 20
#: Items and bytes of item text searched together.
GROUP_ITEMS = 512
GROUP_BYTES = 512 << 10
#: Terms whose slices are looked at together, and row group bytes of the index.
TERMS_AT_ONCE = 1 << 10
ROW_GROUP_BYTES = 8 << 20

TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERMS).split(b" ")


def term_counts(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


def entry_hashes(found: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(t) for t in found), np.uint64, len(found))


def slice_rows(hashes: np.ndarray, step: int, width: int) -> np.ndarray:
    """The ``HASHES`` signature bits of each term at one step, for signatures of ``width`` bits."""
    h = (hashes ^ np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    first, second = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * second) % np.uint64(width) for i in range(HASHES)]).astype(np.int64)


def signature(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a document's terms."""
    return entry_hashes(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))


def entries_of(tf: np.ndarray) -> int:
    """Entries of a document whose terms have these counts."""
    return int(np.searchsorted(STEPS, tf, "right").sum())


def width_of(entries: int) -> int:
    """Signature bits of the length class of a document with so many entries."""
    return BITS_PER_ENTRY * max(64, 1 << (entries - 1).bit_length())


def rows_of(width: int) -> int:
    return max(8, min(BLOCK_ROWS, BLOCK_BITS // width) // 8 * 8)


def sliced(signatures: list[tuple[np.ndarray, np.ndarray]], width: int) -> bytes:
    """One bitmap over the documents per signature bit."""
    bits = np.zeros((width, -(-len(signatures) // 8) * 8), bool)
    h, tf = (np.concatenate(x) for x in zip(*signatures))
    doc = np.repeat(np.arange(len(signatures)), [len(x) for x, _ in signatures])
    for t in STEPS:
        some = tf >= t
        h, tf, doc = h[some], tf[some], doc[some]
        for bit in slice_rows(h, t, width):
            bits[bit, doc] = True
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


INDEX = "block long, width long, rows int, keys array<long>, lengths array<long>, same array<string>, slices binary, texts array<string>"


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of sliced signatures with the keys, lengths in terms, text digests and texts of their documents."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, total, number = defaultdict(list), defaultdict(int), 0, TaskContext.get().partitionId() << 31

        def out(width: int) -> pa.RecordBatch:
            nonlocal number
            rows = waiting.pop(width)
            keys, lengths, same, texts, entries = zip(*rows)
            number += 1
            columns = [[number - 1], [width], [len(rows)], [keys], [lengths], [same], [sliced(entries, width)], [texts]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1)):
                body = body.as_py()
                counts = term_counts(body)
                if not counts:
                    continue
                entries = signature(counts)
                width = width_of(entries_of(entries[1]))
                cost = len(body) * 2 + 16 * len(entries[0])
                waiting[width].append((name, sum(counts.values()), xxhash.xxh3_128_hexdigest(body.encode("utf-8", "surrogatepass")), body, entries))
                size[width] += cost
                total += cost
                full = len(waiting[width]) >= rows_of(width) or size[width] >= PENDING_BYTES // 2
                for w in [width] if full else list(waiting) if total >= PENDING_BYTES else []:
                    total -= size.pop(w)
                    yield out(w)
        for w in list(waiting):
            yield out(w)

    names = [f.split()[0] for f in INDEX.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.string())]
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")).mapInArrow(run, INDEX)


def frequencies(blocks: DataFrame, vocabulary) -> list[int]:
    """In how many documents each term of the broadcast ``vocabulary (term -> place)`` occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = vocabulary.value
        n = np.zeros(len(places), np.int64)
        for b in batches:
            for texts in b.column(0):
                for t in texts.values:
                    for found in places.keys() & set(terms(t.as_py())):
                        n[places[found]] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], names=["term", "n"])

    out = [0] * len(vocabulary.value)
    counted = blocks.select("texts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # one row a term of the item group
        out[r.term] = r.n
    return out


def gain(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def norm(n, documents: int, length: int):
    """m of a document of ``n`` terms."""
    return 10 + (90 * n * documents) // length


class Items:
    """A group of items: their terms, weights and the collection's statistics."""

    def __init__(self, lists: list[list[int]], found: list[bytes], weights: list[int], documents: int, length: int):
        self.lists, self.found, self.weights = lists, found, weights
        self.documents, self.length = documents, length
        pairs = np.array([(p, i) for i, places in enumerate(lists) for p in places if weights[p]], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        #: terms in use, the items that hold each (from ``begin``, ``count`` of them) and their weights
        self.places, self.begin, self.count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.holders, self.weight = pairs[:, 1], np.array(weights, np.int64)[self.places]
        self.hashes = entry_hashes([found[p] for p in self.places.tolist()])

    def bounds(self, width: int, rows: int, lengths: np.ndarray, slices) -> np.ndarray:
        """(items, documents): upper bounds of the scores in one block."""
        bitmaps = np.frombuffer(slices, np.uint8).reshape(width, -1)
        out = np.zeros((len(self.lists), rows))
        for a in range(0, len(self.places), TERMS_AT_ONCE):
            self.add_bounds(out, bitmaps, slice(a, a + TERMS_AT_ONCE), lengths)
        # sums of whole numbers in doubles are exact below 2 ** 53, else rounded up
        return (out if out.max(initial=0) < 2.0**53 else np.ceil(out * (1 + 1e-9))).astype(np.int64)

    def add_bounds(self, out: np.ndarray, bitmaps: np.ndarray, some: slice, lengths: np.ndarray) -> None:
        """Add the weighted slices of some of the terms."""
        hashes, rows = self.hashes[some], len(lengths)
        may = np.bitwise_and.reduce(bitmaps[slice_rows(hashes, 1, len(bitmaps))])
        term, doc = np.nonzero(np.unpackbits(may, axis=1, count=rows, bitorder="little"))
        most, open_ = lengths[doc], np.arange(len(doc))
        for t in STEPS[1:]:
            # the first step that is surely not reached bounds the count
            live = np.unique(term[open_])
            may[live] &= np.bitwise_and.reduce(bitmaps[slice_rows(hashes[live], t, len(bitmaps))])
            d = doc[open_]
            reached = (may[term[open_], d >> 3] >> (d & 7).astype(np.uint8) & 1).astype(bool)
            stopped = open_[~reached]
            most[stopped] = np.minimum(most[stopped], t - 1)
            open_ = open_[reached]
            if not len(open_):
                break
        m = norm(lengths, self.documents, self.length)
        bound = (self.weight[some][term] * gain(most, m[doc])).astype(float)
        begin, count = self.begin[some], self.count[some]
        # terms of many of the block's documents as a product of matrices, the others entry by entry
        common = np.bincount(term, minlength=len(hashes)) * 8 > rows
        held = np.zeros((len(out), int(common.sum())))
        for column, p in enumerate(np.flatnonzero(common).tolist()):
            held[self.holders[begin[p] : begin[p] + count[p]], column] = 1
        dense, at = np.zeros((held.shape[1], rows)), common[term]
        dense[(np.cumsum(common) - 1)[term[at]], doc[at]] = bound[at]
        out += held @ dense
        term, doc, bound = term[~at], doc[~at], bound[~at]
        times = count[term]
        first = np.repeat(begin[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place = self.holders[first] * rows + np.repeat(doc, times)
        out += np.bincount(place, np.repeat(bound, times), out.size).reshape(out.shape)

    def score(self, item: int, counts: Counter, n: int) -> int:
        m = norm(n, self.documents, self.length)
        return sum(self.weights[p] * gain(counts[self.found[p]], m) for p in self.lists[item] if self.found[p] in counts)


def highest(blocks: DataFrame, items, k: int) -> DataFrame:
    """``item, block, at``: for each item the k documents of the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = items.value
        for b in batches:
            for i in range(b.num_rows):
                block, width, rows, lengths, slices = (b.column(c)[i] for c in range(5))
                lengths = lengths.values.to_numpy()
                bounds = group.bounds(width.as_py(), rows.as_py(), lengths, slices.as_buffer())
                top = np.argpartition(-bounds, min(k, bounds.shape[1]) - 1, axis=1)[:, :k]
                item = np.repeat(np.arange(len(bounds)), top.shape[1])
                best = np.take_along_axis(bounds, top, 1).ravel()
                ok = best > 0
                at = [pa.array(x[ok], pa.int64()) for x in (item, np.full(len(item), block.as_py()), top.ravel(), best)]
                yield pa.RecordBatch.from_arrays(at, names=["item", "block", "at", "bound"])

    found = blocks.select("block", "width", "rows", "lengths", "slices").mapInArrow(run, "item long, block long, at long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "at")
    return found.withColumn("o", F.row_number().over(order)).filter(F.col("o") <= k).select("item", "block", "at")


def exact(blocks: DataFrame, items, chosen=None, floors=None, k: int = 10) -> DataFrame:
    """``item, key, score``: exact scores of the ``chosen`` documents (block -> [(item, place)]), or of
    all documents whose bounds reach the items' ``floors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = items.value
        for b in batches:
            for i in range(b.num_rows):
                block, width, rows, keys, lengths, same, slices, texts = (b.column(c)[i] for c in range(8))
                if chosen is not None:
                    wanted = chosen.value.get(block.as_py(), [])
                else:
                    lengths = lengths.values.to_numpy()
                    bounds = group.bounds(width.as_py(), rows.as_py(), lengths, slices.as_buffer())
                    item, at = np.nonzero((bounds >= floors.value[:, None]) & (bounds > 0))
                    wanted = smallest_of_equals(item, at, keys.values, same.values, k)
                if not len(wanted):
                    continue
                asked = defaultdict(list)
                for item, at in wanted:
                    asked[at].append(item)
                found: list[list] = [[], [], []]
                for at, its in asked.items():
                    counts = term_counts(texts.values[at].as_py())
                    n = sum(counts.values())
                    for item in its:
                        for column, x in zip(found, (item, keys.values[at].as_py(), group.score(item, counts, n))):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["item", "key", "score"])

    columns = [f.split()[0] for f in INDEX.split(", ")]
    return blocks.select(*columns).mapInArrow(run, "item long, key long, score long")


def smallest_of_equals(item: np.ndarray, at: np.ndarray, keys: pa.Array, same: pa.Array, k: int) -> list[tuple[int, int]]:
    """The candidates ``(item, place)`` with the k smallest keys of each item and text (nulls last)."""
    text = same.dictionary_encode().indices.to_numpy()[at]
    null = keys.is_null().to_numpy(zero_copy_only=False)[at]
    key = keys.fill_null(0).to_numpy()[at]
    order = np.lexsort((key, null, text, item))
    item, at, text = item[order], at[order], text[order]
    new = np.append(True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])) if len(item) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    rank = np.arange(len(item)) - np.repeat(begin, np.diff(np.append(begin, len(item))))
    return list(zip(item[rank < k].tolist(), at[rank < k].tolist()))


def item_groups(items: DataFrame, key: str, text: str, group_items: int, group_bytes: int) -> Iterator[list]:
    """Item rows ``(key, text)`` in groups of bounded number and size (one item at least)."""
    group, size = [], 0
    for r in items.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body")).toLocalIterator():
        cost = len(r.body.encode("utf-8", "surrogatepass"))
        if group and (len(group) >= group_items or size + cost > group_bytes):
            yield group
            group, size = [], 0
        group.append((r.key, r.body))
        size += cost
    if group:
        yield group


def searched(blocks: DataFrame, group: list, sets: list, place: dict, documents: int, length: int, k: int, names_of: tuple) -> DataFrame:
    """The ranked documents of one group of items, written; ``names_of`` has the item key's name and type and the documents' key."""
    spark = blocks.sparkSession
    vocabulary = spark.sparkContext.broadcast(place)
    df = frequencies(blocks, vocabulary)
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) if n else 0 for n in df]
    known = Items([[place[t] for t in s if df[place[t]]] for s in sets], list(place), weights, documents, length)
    held = spark.sparkContext.broadcast(known)
    chosen = defaultdict(list)
    for r in highest(blocks, held, k).collect():  # k rows an item of the group at most
        chosen[r.block].append((r.item, r.at))
    picked = spark.sparkContext.broadcast(dict(chosen))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    first = exact(blocks.filter(F.col("block").isin(*chosen)), held, picked)
    first = first.withColumn("o", F.row_number().over(order)).filter((F.col("o") == k) & (F.col("score") > 0))
    floor = np.zeros(len(group), np.int64)
    for r in first.collect():  # one row an item of the group
        floor[r.item] = r.score
    floors = spark.sparkContext.broadcast(floor)
    scored = exact(blocks, held, None, floors, k).filter("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, g[0]) for i, g in enumerate(group)], f"item long, name {names_of[1]}")
    found = ranked.join(F.broadcast(names), "item").select(
        F.col("name").alias(names_of[0]), F.col("rank").cast("int").alias("rank"), F.col("key").alias(names_of[2]), "score")
    out = written(found, "ranked")
    for b in (vocabulary, held, picked, floors):
        b.unpersist()
    return out


def top_k(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", group_items: int = GROUP_ITEMS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k documents of the highest scores above 0 for each item."""
    spark = docs.sparkSession
    with small_batches(spark):
        blocks = written(index(docs, key, text), "slices", ROW_GROUP_BYTES)
    whole = blocks.agg(F.sum("rows").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    documents, length = whole.n or 0, whole.l or 0
    kind = items.schema[item_key].dataType.simpleString()
    results = []
    for group in item_groups(items, item_key, item_text, group_items, group_bytes) if documents else []:
        sets = [sorted(term_counts(body)) for _, body in group]
        place = {t: i for i, t in enumerate(sorted({t for s in sets for t in s}))}
        with small_batches(spark, BLOCK_ROWS_A_BATCH):
            results.append(searched(blocks, group, sets, place, documents, length, k, (item_key, kind, key)))
    if not results:
        return spark.createDataFrame([], f"{item_key} {kind}, rank int, {key} long, score long")
    return reduce(DataFrame.unionByName, results)


def oracle(k: int = 10) -> str:
    """DuckDB SQL for the search."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    return f"""
    WITH words AS (
      SELECT r, doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{pattern}')) AS term
      FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
    tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    docs AS (SELECT r, sum(tf)::BIGINT AS n FROM tfs GROUP BY r),
    whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS len FROM docs),
    asked AS (
      SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{pattern}')) AS term
      FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
    weights AS (
      SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tfs, whole GROUP BY term, n_docs),
    scored AS (
      SELECT a.i, a.item_id, t.doc_id, t.r,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // len))))::BIGINT AS score
      FROM asked a JOIN tfs t USING (term) JOIN weights USING (term) JOIN docs ON docs.r = t.r, whole GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {k}
    """
