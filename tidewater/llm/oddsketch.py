"""MinHash near-duplicates verified by odd sketches.

A text's set is its distinct word shingles (fewer words: the whole sequence as
one).  Texts with equal sets form a class; one class stands once in all that
follows.  A class has ``bands * rows`` MinHash values.  Their ``(place, value)``
pairs are folded into an odd sketch: a bitmap in which each pair flips one bit.
In the XOR of two sketches only the pairs that differ are left, so its
population count z gives the similarity, most precisely where it is high:
``J = 1 + bits / (4 samples) * ln(1 - 2 z / bits)``.

Classes meet on bands (equal values in all rows of one); a meeting counts if
neither the set sizes nor the sketches rule it out, that is if z is no more than
5.5 standard deviations above what the threshold gives.  A bucket hands on a spanning forest
of its meetings, a bucket above ``chunk`` classes one star of all its classes,
so never all pairs.  The components of those meetings are candidate groups.

Links are confirmed on full sets.  The classes of a candidate group come
together with their texts, each once, in parts of about ``part_bytes`` of sets
(64-bit shingle hashes); a search that lets a class leave as soon as it is linked names
each class by the least of those that true links reach in the part.  Where a
group has several parts, first the parts, then the groups found in them, by one
class each, are searched; at last every class outside the largest group found
meets all classes of other groups.  So a large group of near copies costs its size, and only classes that
really are not linked are compared more often.  A part names its own classes, so
only links of that last meeting, between groups found, need components.

What may be lost: a pair at exactly the threshold shares none of the bands with
probability (1 - 0.85 ** 6) ** 32 = 2.6e-7 at the defaults, and is ruled out by
its sketches with about 1e-8; both fall quickly with the similarity.

Defined results: a null text, and a text without a word, has an empty set and
is linked with nothing, not even with its like; repeated rows come back once
per row; null keys never become a component's id unless all its keys are null;
a row is kept if its key is its component's id (equal keys: all are; a null key
with a null id: yes); very long texts are hashed in runs of ``RUN_BYTES``; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import bitmap_of, in_bitmap, written
from tidewater.llm.simhash import components

SEED = 42
RUN_BYTES = 1 << 20
SHINGLES_AT_ONCE = 1 << 12
SKETCH_BITS = 256
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * MIX[0]
    h = (h ^ (h >> np.uint64(33))) * MIX[1]
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased, in order."""
    import xxhash

    # bytes.lower() folds A-Z only and bytes.split() cuts at 0x20, 0x09-0x0D
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, parts, at = xxhash.xxh64_intdigest, [], 0
    while at < len(data):
        end = at + RUN_BYTES
        while end < len(data) and data[end] != 32 and not 9 <= data[end] <= 13:
            end += 1
        words = data[at:end].split()
        parts.append(np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles of ``k`` words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - k + 1 + i])
    return np.unique(h)


@lru_cache(maxsize=4)
def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, (count, 1), np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, (count, 1), np.uint32)


def minhashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` functions over a set that is not empty."""
    a, b = functions(count)
    low = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), SHINGLES_AT_ONCE):
        np.minimum(low, (a * short[i : i + SHINGLES_AT_ONCE] + b).min(1), out=low)
    return low


def odd_sketch(values: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the samples ``(place, value)``, ``bits / 64`` words."""
    place = mixed(values.astype(np.uint64) + (np.arange(len(values), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).view("<u8")


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band."""
    rows = values.reshape(bands, -1).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h


def estimated(z: np.ndarray, samples: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity of two sets whose sketches differ in ``z`` bits."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * np.asarray(z, float) / bits, 1e-9))


def most_bits(percent: int, samples: int, bits: int = SKETCH_BITS, deviations: float = 5.5) -> int:
    """Differing bits above which a pair at ``percent`` similarity is ruled out."""
    share = 1 - percent / 100
    left = (1 - 2 / bits) ** (2 * share * samples)
    mean = bits * (1 - left) / 2
    # spread of the parity bits, and of the number of differing samples carried over to them
    spread = bits / 4 * (1 - left**2) + (2 * left) ** 2 * share * (1 - share) * samples
    return int(min(bits, np.ceil(mean + deviations * np.sqrt(spread))))


def near(left: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ one).sum(1)


def meetings(sketches: np.ndarray, sizes: np.ndarray, most: int, percent: int) -> Iterator[tuple[int, int]]:
    """Places of a spanning forest of the pairs that neither sketches nor set sizes rule out."""
    left = np.arange(len(sizes))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            size, other = sizes[at], sizes[left]
            ok = (near(sketches[left], sketches[at]) <= most) & (100 * np.minimum(size, other) >= percent * np.maximum(size, other))
            found = left[ok].tolist()
            yield from ((at, x) for x in found)
            frontier += found
            left = left[~ok]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """``100 * |a & b| >= percent * |a | b|`` of sorted distinct values."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (small + large - common)


def sets_of(texts: list[str], k: int) -> Callable[[int], np.ndarray]:
    """The set of the text at a place, made when it is first asked for: sketches rule out most pairs."""
    return lru_cache(maxsize=None)(lambda i: shingle_set(texts[i], k))


def true_groups(sets: Callable[[int], np.ndarray], sketches: np.ndarray, most: int, percent: int) -> list[tuple[int, int]]:
    """Places ``(first, other)``: every set that true links connect with earlier ones, and the first of those."""
    left, named = np.arange(len(sketches)), []
    while len(left):
        first, left = int(left[0]), left[1:]
        frontier = [first]
        while frontier and len(left):
            at = frontier.pop()
            maybe = near(sketches[left], sketches[at]) <= most
            linked = np.zeros(len(left), bool)
            for i in np.flatnonzero(maybe).tolist():
                linked[i] = similar(sets(at), sets(int(left[i])), percent)
            found = left[linked].tolist()
            named += [(first, x) for x in found]
            frontier += found
            left = left[~linked]
    return named


def sketch_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, list]]:
    """The columns of each run of rows that are equal in the first ``keys`` columns."""
    now, rows = None, {}
    for b in batches:
        for name, *row in zip(zip(*(b.column(i).to_pylist() for i in range(keys))), *(c.to_pylist() for c in b.columns[keys:])):
            if name != now:
                if now is not None:
                    yield rows
                now, rows = name, {c: [] for c in b.schema.names[keys:]}
            for column, x in zip(rows.values(), row):
                column.append(x)
    if now is not None:
        yield rows


def by_group(rows: DataFrame, keys: list[str], links) -> DataFrame:
    """``a, b``: the links that ``links(columns)`` finds in each group of rows equal in ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = []
        for columns in groups_of(batches, len(keys)):
            edges += links(columns)
            if len(edges) >= 1 << 16:
                yield edge_batch(edges)
                edges = []
        yield edge_batch(edges)

    order = rows.repartition(*keys).sortWithinPartitions(*keys, "id")
    return order.select(*keys, *[c for c in rows.columns if c not in keys]).mapInArrow(run, "a long, b long")


def signed_rows(docs: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """``row, key, th, n_shingles, high, low, keys, sketch`` of every row: a number, the hash of the text,
    128 bits of the set, the band keys and the odd sketch."""
    import xxhash

    schema = pa.schema([
        ("row", pa.int64()), ("key", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("high", pa.int64()), ("low", pa.int64()),
        ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [[] for _ in range(5)]
                for t in part.column(2):
                    h = shingle_set(t.as_py(), k)
                    row = [len(h), None, None, None, None]
                    if len(h):
                        values = minhashes(h, bands * rows)
                        name = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist()
                        row = [len(h), *name, band_keys(values, bands).view(np.int64), odd_sketch(values).tobytes()]
                    for column, x in zip(found, row):
                        column.append(x)
                numbers = pa.array(np.arange(number, number + part.num_rows))
                number += part.num_rows
                made = [pa.array(c, f.type) for c, f in zip(found, list(schema)[3:])]
                yield pa.RecordBatch.from_arrays([numbers, part.column(0), part.column(1), *made], schema=schema)

    return keyed_texts(docs, key, text).mapInArrow(
        run, "row long, key long, th long, n_shingles long, high long, low long, keys array<long>, sketch binary")


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("body"))


def maybe_members(texts: DataFrame, members: DataFrame, slot_bits: int) -> DataFrame:
    """The rows of ``texts`` whose text hash may be one of ``members``, so that only those are shuffled.

    What is broadcast is a bitmap of ``2 ** slot_bits`` bits, whatever the number of members.
    """
    bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(members, "th", slot_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits, b.column(1).to_numpy().view(np.uint64), slot_bits)))

    return texts.mapInArrow(run, texts.schema)


def candidate_edges(classes: DataFrame, most: int, percent: int, chunk: int) -> DataFrame:
    """``a, b``: a spanning forest of the meetings in every bucket of two and more."""
    keyed = classes.select("id", F.col("n_shingles").cast("int").alias("size"), "sketch", F.explode("keys").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    met = keyed.join(buckets, "bucket")
    stars = met.filter((F.col("n") > chunk) & (F.col("id") > F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    lists = met.filter(F.col("n") <= chunk).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "size", "sketch"))).alias("met"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = []
            for found in batch.column(0):
                found = found.values
                ids, sizes = (found.field(c).to_numpy() for c in ("id", "size"))
                edges += [(ids[i], ids[j]) for i, j in meetings(sketch_array(found.field("sketch")), sizes.astype(np.int64), most, percent)]
            yield edge_batch(edges)

    return thinned(lists.select("met").mapInArrow(run, "a long, b long").union(stars))


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer links with the same components, where ``a`` found ``b`` and a class is found once a bucket.

    A class keeps the link to the least of those that found it, and those are
    linked with that one.  A large group of near copies is found from few
    classes, over and over in every band: of a link for each band and member
    one a member is left, and those few among the classes that found them.
    """
    found = edges.groupBy("b").agg(F.collect_set("a").alias("by"))  # one of each band at most
    least = F.array_min("by")
    others = F.filter("by", lambda x: x != F.array_min("by"))
    return found.select(least.alias("a"), "b").union(found.select(least.alias("a"), F.explode(others).alias("b"))).distinct()


def followed(names: DataFrame, heads: DataFrame) -> DataFrame:
    """``a, b``: the names ``a`` of the ids ``b``, where ``heads`` gives some of those names a name in turn."""
    up = heads.select(F.col("a").alias("up"), F.col("b").alias("a"))
    return names.join(up, "a", "left").select(F.coalesce("up", "a").alias("a"), "b").union(heads)


def grouped(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """``nodes`` with ``found``: the name ``a`` of ``id``, itself if it has none."""
    found = names.select(F.col("b").alias("id"), F.col("a").alias("found"))
    return nodes.join(found, "id", "left").withColumn("found", F.coalesce("found", "id"))


def dealt(members: DataFrame, part_bytes: int) -> DataFrame:
    """``members`` with ``parts`` and ``part``: each ``group`` in parts of sets of about ``part_bytes``."""
    sizes = members.groupBy("group").agg(F.sum("bytes").alias("all"))
    sizes = sizes.select("group", F.ceil(F.col("all") / F.lit(part_bytes)).cast("int").alias("parts"))
    return members.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def with_texts(members: DataFrame, texts: DataFrame, *keep: str) -> DataFrame:
    """``members`` with their texts: the columns ``keep`` and ``id, sketch, body``."""
    same = texts["key"].eqNullSafe(members["key"]) & (texts["th"] == members["th"])
    return texts.join(members, same).select(*keep, "id", "sketch", "body").dropDuplicates(["id"])


def confirmed(members: DataFrame, texts: DataFrame, k: int, most: int, percent: int, part_bytes: int, slot_bits: int) -> DataFrame:
    """``a, b``: the least id ``a`` of the group of true links among ``members (id, key, th, group, sketch, bytes)``
    that ``b`` is in, for every other id of it."""

    def search(columns: dict[str, list]) -> list[tuple[int, int]]:
        ids, sets = columns["id"], sets_of(columns["body"], k)
        return [(ids[a], ids[b]) for a, b in true_groups(sets, sketch_array(pa.array(columns["sketch"])), most, percent)]

    def cross(columns: dict[str, list]) -> list[tuple[int, int]]:
        found, sketches, sets = np.array(columns["found"]), sketch_array(pa.array(columns["sketch"])), sets_of(columns["body"], k)
        side, edges, known = np.array(columns["side"]), [], set()
        other = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0).tolist():
            maybe = other[(found[other] != found[i]) & (near(sketches[other], sketches[i]) <= most)]
            for j in maybe.tolist():
                pair = frozenset((found[i], found[j]))
                if pair not in known and similar(sets(i), sets(j), percent):
                    known.add(pair)
                    edges.append((int(found[i]), int(found[j])))
        return edges

    members = written(dealt(members, part_bytes), "members")
    bodies = with_texts(members, maybe_members(texts, members, slot_bits), "group", "part")
    inside = written(by_group(bodies, ["group", "part"], search), "names")
    large = members.filter("parts > 1")
    if large.isEmpty():
        return inside
    texts = maybe_members(texts, large, slot_bits)  # from here on only those of large groups are shuffled
    # the groups found in the parts of a large group meet by one class each
    heads = large.join(inside.select(F.col("b").alias("id")), "id", "left_anti").drop("parts", "part")
    heads = with_texts(dealt(heads, part_bytes), texts, "group", "part")
    names = followed(inside, written(by_group(heads, ["group", "part"], search), "names"))
    # all classes outside the largest group found, against all classes of other groups
    state = written(grouped(large, names), "members")
    sizes = state.groupBy("group", "found").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"))
    order = Window.partitionBy("group").orderBy(F.desc("n"), "found")
    outside = written(sizes.withColumn("at", F.row_number().over(order)).filter("at > 1").select("group", "found", "all"), "outside")
    if outside.isEmpty():
        return names
    many = outside.groupBy("group").agg(F.ceil(F.sum("all") / F.lit(part_bytes)).cast("int").alias("shares"))
    asked = state.join(many, "group").join(outside.select("group", "found", F.lit(True).alias("asks")), ["group", "found"], "left")
    body = with_texts(asked, texts, "group", "found", "part", "parts", "shares", "asks")
    every = F.sequence(F.lit(0), F.col("shares") - 1)
    copies = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(
        F.lit(0).alias("side"), i.alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")).cast("int").alias("j"))))
    copies = F.concat(F.coalesce(copies, F.array()), F.transform(every, lambda j: F.struct(F.lit(1).alias("side"), F.col("part").alias("i"), j.alias("j"))))
    cells = body.withColumn("cell", F.explode(copies)).select("group", "cell.i", "cell.j", "cell.side", "found", "id", "sketch", "body")
    last = components(by_group(cells, ["group", "i", "j"], cross)).filter("node <> label")
    return followed(names, last.select(F.col("label").alias("a"), F.col("node").alias("b")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 3, percent: int = 85,
                    bands: int = 32, rows: int = 6, chunk: int = 4096, part_bytes: int = 2 << 20, slot_bits: int = 27) -> DataFrame:
    """Per row: ``key, n_shingles, component_id, kept`` over links of at least ``percent`` similarity."""
    most = most_bits(percent, bands * rows)
    signed = written(signed_rows(docs, key, text, shingle_words, bands, rows), "odd")
    filled = signed.filter("n_shingles > 0")
    # equal sets, by 128 bits, are one class; its least row number names it
    classes = written(filled.groupBy("high", "low").agg(F.min("key").alias("least"), F.min("row").alias("id")), "classes")
    single = signed.join(classes.select(F.col("id").alias("row")), "row", "left_semi").withColumnRenamed("row", "id")
    single = written(single.select("id", "key", "th", "n_shingles", "keys", "sketch"), "single")
    candidates = written(candidate_edges(single, most, percent, chunk), "meetings")
    members = single.select("id", "key", "th", "sketch", (F.col("n_shingles") * 8 + 64).alias("bytes")).join(
        components(candidates).select(F.col("node").alias("id"), F.col("label").alias("group")), "id")
    members = written(members, "members")
    names = written(confirmed(members, keyed_texts(docs, key, text), shingle_words, most, percent, part_bytes, slot_bits), "names")
    found = grouped(classes, names)
    smallest = found.groupBy("found").agg(F.min("least").alias("component_id"))
    named = found.join(smallest, "found").select("high", "low", "component_id")
    out = signed.select("key", "n_shingles", "high", "low").join(named, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))
