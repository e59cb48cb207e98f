"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``; they are written once as rows of canonical
bytes (words one space apart, pieces one line apart), so an occurrence is a
pointer, one number: ``row * ROW_BYTES + offset``.

Level by level (words, then pairs, ...) numpy prefix polynomials give the
64-bit fingerprint of every n-gram of a row at once:
``(S[end] - S[start]) * base ** -start`` with ``S`` the prefix sums of
``value[byte] * base ** place``, mixed with the language.  A task counts the fingerprints of many rows
and hands on one row per distinct one with a pointer; the shuffle adds up the
counts and keeps the least pointer.  An n-gram can only be frequent if both its
(n-1)-grams are: the frequent fingerprints of a level become a bitmap of a
fixed number of bits (``slot_bits``; 2 ** 27 bits are 16 MiB), which is all that
is broadcast.  It has false positives, which cost only shuffled rows, and no
false negatives; raise it with the corpus.

Every occurrence carries a second, independent fingerprint.  Where the
occurrences of one fingerprint differ in it, different phrases have collided:
all their rows are looked up in the text and counted by phrase.  Only frequent
phrases become text; everything after that joins on the phrases themselves.

Defined results: a null text counts as empty; a null language counts as
``und``; empty and blank texts add nothing; a text of any length is cut into
rows of about ``CUT_BYTES`` whose last words may repeat the next row's first
as context, so no n-gram is lost or counted twice; repeated rows count each
time; equal scores are ordered by count and phrase bytes; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import BLOCK_ROWS_A_BATCH, bitmap_of, in_bitmap, small_batches, written

#: Canonical bytes a row may hold (no n-gram starts beyond), those it is cut at, bytes waiting in a task for their
#: rows, n-grams counted together, and rows of counts handed over together.
ROW_BYTES = 1 << 20
CUT_BYTES = 1 << 18
PENDING_BYTES = 4 << 20
GRAMS_AT_ONCE = 1 << 19
COUNTS_A_BATCH = 1 << 16
#: A language's phrases are ranked in this many parts first, so no task meets them all.
RANK_PARTS = 64
ROW_GROUP_BYTES = 8 << 20

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
CANONICAL = bytes(
    10 if b in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
#: Row numbers a task can give; its number stands before them.
ROWS_A_TASK = 1 << 22


def canonical(texts: list[bytes]) -> bytes:
    """Words one space apart, pieces one line apart."""
    data = b"\n".join(texts).translate(CANONICAL)
    for twice, once in ((b"  ", b" "), (b" \n", b"\n"), (b"\n ", b"\n"), (b"\n\n", b"\n")):
        while twice in data:
            data = data.replace(twice, once)
    return data.strip(b" \n")


def rows_of(data: bytes, limit: int, context: int) -> Iterator[tuple[bytes, int]]:
    """Cut canonical bytes into rows ``(bytes, tail)``; the last ``tail`` words belong to the next row."""
    at, stop = 0, len(data)
    while stop - at > limit:
        line = data.rfind(b"\n", at + 1, at + limit)
        if line < 0:
            space, line = data.find(b" ", at + limit), data.find(b"\n", at + limit)
            if 0 <= space and not 0 <= line < space:
                end, tail = space, 0
                while tail < context and data[end : end + 1] == b" ":
                    ends = [x for x in (data.find(b" ", end + 1), data.find(b"\n", end + 1)) if x >= 0]
                    end, tail = min(ends, default=stop), tail + 1
                yield data[at:end], tail
                at = space + 1
                continue
        line = line if line >= 0 else stop
        yield data[at:line], 0
        at = line + 1
    if at < stop:
        yield data[at:], 0


def canonical_rows(docs: DataFrame, text: str, lang: str, context: int, limit: int = ROW_BYTES) -> DataFrame:
    """``batch, lang, words, tail, data``: the corpus as canonical bytes, one language a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, total, number = defaultdict(list), defaultdict(int), 0, TaskContext.get().partitionId() * ROWS_A_TASK

        def out(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for data, tail in rows_of(canonical(waiting.pop(name)), limit, context):
                words = data.count(b" ") + data.count(b"\n") + 1 - tail
                yield pa.RecordBatch.from_pydict(
                    {"batch": [number], "lang": [name], "words": [words], "tail": [tail], "data": [data]}, schema
                )
                number += 1

        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1)):
                body = body.as_py()
                waiting[name].append(body)
                size[name] += len(body) + 1
                total += len(body) + 1
                for full in [name] if size[name] >= limit else list(waiting) if total >= PENDING_BYTES else []:
                    total -= size.pop(full)
                    yield from out(full)
        for name in list(waiting):
            yield from out(name)

    schema = pa.schema([("batch", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("tail", pa.int32()), ("data", pa.binary())])
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, "batch long, lang string, words long, tail int, data binary")


@lru_cache(maxsize=8)
def powers(seed: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one polynomial modulo 2 ** 64: a value per byte, ``base ** i`` and ``base ** -i`` for i up to ``length``."""
    rng = np.random.default_rng(seed)
    value = rng.integers(0, 1 << 64, 256, np.uint64)
    base = int(rng.integers(0, 1 << 61)) * 8 + 5
    inverse = pow(base, -1, 1 << 64)
    run = [np.multiply.accumulate(np.append(np.uint64(1), np.full(length, b, np.uint64))) for b in (base, inverse)]
    return value, run[0], run[1]


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, lang: str = "", bits: int = 64) -> np.ndarray:
    """Fingerprints of the byte ranges ``[start, end)`` of ``data`` in a language; ``bits`` below 64 for tests."""
    value, up, down = powers(seed, 1 << max(18, int(len(data)).bit_length()))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    h ^= h >> np.uint64(32)
    h ^= np.uint64(crc32(lang.encode()) * 0x100000001 ^ seed)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h >> np.uint64(64 - bits) << np.uint64(64 - bits)


def grams(data: np.ndarray, tail: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a row, the starting words of its n-grams of ``size`` words, and
    for each word the piece it stands in."""
    cut = np.flatnonzero((data == 32) | (data == 10))
    start, end = np.append(0, cut + 1), np.append(cut, len(data))
    piece = np.append(0, np.cumsum(data[cut] == 10))
    first = np.arange(max(0, min(len(start) - size + 1, len(start) - tail)))
    return start, end, first[piece[first] == piece[first + size - 1]], piece


def counted(rows: DataFrame, size: int, below=None, slot_bits: int = 27, bits: int = 64) -> DataFrame:
    """``fp, check, n, pointer``: counts of the n-grams of ``size`` words as the tasks see them, with an occurrence.

    ``below`` is the broadcast bitmap of the frequent n-grams of one word less.
    """
    names = ["fp", "check", "n", "pointer"]

    def flush(found: list) -> Iterator[pa.RecordBatch]:
        fp, check, pointer = (np.concatenate(x) for x in zip(*found))
        found.clear()
        order = np.argsort(fp)
        fp, check, pointer = fp[order], check[order], pointer[order]
        begin = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])))
        n = np.diff(np.append(begin, len(fp)))
        least = np.minimum.reduceat(pointer, begin)
        columns = fp[begin].view(np.int64), check[begin].view(np.int64), n, least
        for at in range(0, len(n), COUNTS_A_BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + COUNTS_A_BATCH]) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, total = [], 0
        may = np.frombuffer(below.value, np.uint8) if below is not None else None
        for b in batches:
            for i in range(b.num_rows):
                batch, lang, tail = (b.column(c)[i].as_py() for c in range(3))
                data = np.frombuffer(b.column(3)[i].as_buffer(), np.uint8)
                start, end, first, piece = grams(data, tail, size)
                if may is not None and len(first):
                    part = np.flatnonzero(piece[: len(piece) - size + 2] == piece[size - 2 :])
                    ok = np.zeros(len(start) + 1, bool)
                    ok[part] = in_bitmap(may, fingerprints(data, start[part], end[part + size - 2], 1, lang, bits), slot_bits)
                    first = first[ok[first] & ok[first + 1]]
                if len(first):
                    s, e = start[first], end[first + size - 1]
                    waiting.append((fingerprints(data, s, e, 1, lang, bits), fingerprints(data, s, e, 2, lang), s + batch * ROW_BYTES))
                    total += len(s)
                if total >= GRAMS_AT_ONCE:
                    yield from flush(waiting)
                    total = 0
        if waiting:
            yield from flush(waiting)

    return rows.select("batch", "lang", "tail", "data").mapInArrow(run, "fp long, check long, n long, pointer long")


def texts_at(pointers: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, words, phrase, a`` of ``pointers (pointer, words, a)``: the texts pointed at."""
    found = pointers.select(F.shiftrightunsigned("pointer", 20).alias("batch"), F.col("pointer").bitwiseAND(ROW_BYTES - 1).alias("at"), "words", "a")
    lists = found.groupBy("batch").agg(F.collect_list(F.struct("at", "words", "a")).alias("found"))
    joined = rows.select("batch", "lang", "data").join(lists, "batch").select("lang", "data", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lang, data, found = b.column(0)[i], b.column(1)[i].as_py(), b.column(2)[i].values
                words = found.field("words").to_pylist()
                shape = {w: re.compile(rb"[^ \n]+(?: [^ \n]+){%d}" % (w - 1)) for w in set(words)}
                phrase = [shape[w].match(data, at).group() for w, at in zip(words, found.field("at").to_pylist())]
                columns = [pa.repeat(lang, len(phrase)), found.field("words"), pa.array(phrase, pa.binary()).cast(pa.string()), found.field("a")]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "a"])

    return joined.mapInArrow(run, "lang string, words int, phrase string, a long")


def frequent_phrases(rows: DataFrame, longest: int, at_least: int, slot_bits: int = 27, bits: int = 64) -> DataFrame:
    """``lang, words, phrase, a``: every phrase of up to ``longest`` words that occurs ``at_least`` times in its language."""
    spark, below, levels, pointers = rows.sparkSession, None, [], []
    for size in range(1, longest + 1):
        partial = counted(rows, size, below, slot_bits, bits)
        # the tasks have counted already: straight to the shuffle, without a second hash table in each
        totals = partial.repartition("fp").groupBy("fp").agg(
            F.sum("n").alias("a"), F.min("check").alias("low"), F.max("check").alias("high"), F.min("pointer").alias("pointer"))
        level = written(totals.filter(F.col("a") >= at_least).withColumn("words", F.lit(size)), f"phrases{size}")
        pointers.append(level.filter("low = high").select("pointer", "words", "a"))
        collided = level.filter("low <> high").select("fp")
        if not collided.isEmpty():
            # several phrases with one fingerprint: all their occurrences are told apart by their text
            mixed = partial.join(collided, "fp", "left_semi").select("pointer", F.lit(size).alias("words"), F.col("n").alias("a"))
            apart = texts_at(mixed, rows).groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= at_least)
            levels.append(apart)
        if size < longest:
            if below is not None:
                below.unpersist()
            below = spark.sparkContext.broadcast(bitmap_of(level, "fp", slot_bits))
    return reduce(DataFrame.unionByName, [*levels, texts_at(reduce(DataFrame.union, pointers), rows)])


def collocations(docs: DataFrame, longest: int = 3, at_least: int = 10, top: int = 2000, inside_percent: int = 50,
                 text: str = "text", lang: str = "lang", slot_bits: int = 27, bits: int = 64, row_bytes: int = CUT_BYTES) -> DataFrame:
    """Per language the ``top`` phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` its two sides at the cut of the
    lowest ``score = floor(1000000 * a * a / (l * r))`` (ties to the first
    cut), ``n`` all words of the language.  A phrase goes if one longer phrase
    holds it and has at least ``inside_percent`` of its occurrences.
    """
    with small_batches(docs.sparkSession):
        rows = written(canonical_rows(docs, text, lang, longest - 1, min(row_bytes, ROW_BYTES)), "canonical", ROW_GROUP_BYTES)
    with small_batches(docs.sparkSession, BLOCK_ROWS_A_BATCH):
        known = written(frequent_phrases(rows, longest, at_least, slot_bits, bits), "frequent")
    total = rows.groupBy("lang").agg(F.sum("words").alias("n"))
    part = F.split("phrase", " ")
    candidates = known.filter("words > 1").select("lang", "words", "phrase", "a", part.alias("part"))

    # phrases held by a longer one: every run of words of the longer ones
    runs = candidates.filter("words > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
            F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("part", i, k), " "))))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(runs, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))

    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "part", "words").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("part", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("part", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = [F.col(c).cast("decimal(19,0)") for c in "alr"]
    square = (F.lit(1000000).cast("decimal(7,0)") * wide[0]).cast("decimal(26,0)") * wide[0]
    sides = (wide[1] * wide[2]).cast("decimal(38,0)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"above": square, "below": sides})
    scored = scored.withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language, then the first of those: a phrase among the first
    # ``top`` of its language is among the first ``top`` of its part
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).cast("int")
    flat = lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score", part_of.alias("part"))
    first = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= top).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(at_least: int = 10, top: int = 2000, inside_percent: int = 50) -> str:
    """DuckDB SQL for phrases of up to three words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
      FROM documents),
    lists AS (
      SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
    words AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
    runs AS (
      SELECT lang, 1 AS size, w AS phrase FROM words
      UNION ALL SELECT x.lang, 2, x.w || ' ' || y.w FROM words x JOIN words y ON y.p = x.p AND y.i = x.i + 1
      UNION ALL SELECT x.lang, 3, x.w || ' ' || y.w || ' ' || z.w
      FROM words x JOIN words y ON y.p = x.p AND y.i = x.i + 1 JOIN words z ON z.p = x.p AND z.i = x.i + 2),
    known AS (SELECT lang, size, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= {at_least}),
    total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
    inner_pairs AS (
      SELECT lang, unnest([split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2),
                           split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3)]) AS phrase, a AS longer
      FROM known WHERE size = 3),
    kept AS (
      SELECT * FROM known c WHERE size > 1 AND NOT EXISTS (
        SELECT 1 FROM inner_pairs i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= {inside_percent} * c.a)),
    cuts AS (
      SELECT lang, phrase, a, 1 AS k, split_part(phrase, ' ', 1) AS f,
             substr(phrase, length(split_part(phrase, ' ', 1)) + 2) AS s FROM kept
      UNION ALL
      SELECT lang, phrase, a, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3)
      FROM kept WHERE size = 3),
    scored AS (
      SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
             (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
      FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = c.f JOIN known y ON y.lang = c.lang AND y.phrase = c.s),
    lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank
      FROM lowest WHERE o = 1)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN total USING (lang) WHERE rank <= {top}
    """
