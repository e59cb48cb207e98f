"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Items are cut into segments of ``SEGMENT`` words; each is a document of the
index.  A posting's impact is its BM25 weight over the segment's own total, so
a score is the part of a segment's weight that a passage holds (0 to 1) and
one threshold serves all.  Every training text is cut into passages of two
neighbouring blocks of ``SEGMENT`` words (a segment anywhere in a text lies
whole in one of them) and every passage is a query: all segments at or above
``THRESHOLD`` are retrieved.  A passage is passed over at once if in every run
of neighbouring segments its terms' largest impacts sum to less; the others go
through block-max WAND.  Question and answer may also stand far apart, or in
pieces: of its longer part's shingles so many are looked up in the whole text
that a text without any of them cannot hold ``OVERLAP`` of the part, and an
item with one of them is retrieved too, so none that the check accepts is
missed.  A retrieved item is then verified on the whole text: the shares of
the five-word shingles of its question (all sentences but the last) and of
its answer (the last sentence) that occur in the text must both reach
``OVERLAP``.  A part shorter than five words is one shingle.

The index is built in blocks of about ``BLOCK_BYTES`` of item text, one
broadcast each, and every text meets every block: the bound holds for any
number of items.  Document frequencies are those of all items.

Defined results: null and empty texts match nothing; items without a word
match nothing; items of equal text all match; a repeated row has its own
results; empty tables give no matches; ``drop_contaminated`` keeps all columns
and ignores their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 32
THRESHOLD = 0.7
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
POSTINGS_BLOCK = 32
RUNS = 64
BLOCK_BYTES = 512 << 10
TEXTS_AT_ONCE = 200
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; of one sentence alone: its halves."""
    parts = [w for w in map(words, SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    half = (len(only) + 1) // 2
    return only[:half], only[half:]


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def segments_of(w: list[str]) -> list[list[str]]:
    """Word lists of like length, ``SEGMENT`` at most."""
    n = -(-len(w) // SEGMENT)
    size = -(-len(w) // n) if n else 1
    return [w[i : i + size] for i in range(0, len(w), size)]


def needed(n: int) -> int:
    """Fewest of ``n`` shingles that reach ``OVERLAP``."""
    return next(i for i in range(n + 1) if i / n >= OVERLAP)


def coded(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of every run of ``size`` term numbers."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for i in range(size):
        out = (out ^ (ids[i : i + len(out)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Inverted index with impacts; postings in blocks with their maxima."""

    def __init__(self, items: list[tuple], segments: list[tuple[int, list[str]]], frequency: dict[str, int], total: int, mean: float):
        """``items``: (id, text); ``segments``: (item's place, words); the rest describes the segments of all blocks."""
        self.items = [(i, *question_answer(t)) for i, t in items]
        self.item_of = [place for place, _ in segments]
        postings: dict[str, list[tuple[int, float]]] = {}
        for s, (_, w) in enumerate(segments):
            weight = {}
            for t, n in Counter(w).items():
                idf = math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5))
                weight[t] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean))
            own = sum(weight.values())
            for t, x in weight.items():
                postings.setdefault(t, []).append((s, x / own))
        self.number = {t: i for i, t in enumerate(postings)}
        self.segments = [[s for s, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.maxima = [[max(x[i : i + POSTINGS_BLOCK]) for i in range(0, len(x), POSTINGS_BLOCK)] for x in self.impacts]
        self.largest = [max(m) for m in self.maxima]
        self.segments_of_item: dict[int, list[int]] = {}
        for s, place in enumerate(self.item_of):
            self.segments_of_item.setdefault(place, []).append(s)
        # by shingle size: codes, ascending, and the items whose check fails without all of an item's codes
        found: dict[int, list[tuple[int, int]]] = {}
        for place, (_, question, answer) in enumerate(self.items):
            part = max(question, answer, key=len)
            every = sorted(shingles(part), key=lambda x: (min(frequency[w] for w in x), x))
            size = min(SHINGLE, len(part))
            for x in every[: len(every) - needed(len(every)) + 1] if every else []:
                code = coded(np.array([self.number[w] for w in x]), size)
                found.setdefault(size, []).append((int(code[0]), place))
        self.codes = {size: (np.array([c for c, _ in sorted(x)], np.uint64), [i for _, i in sorted(x)]) for size, x in found.items()}
        # for runs of neighbouring segments: largest impact of each term in each run
        runs = min(RUNS, max(1, len(segments)))
        self.run_maxima = np.zeros((len(postings), runs), np.float32)
        for t, (p, x) in enumerate(zip(self.segments, self.impacts)):
            np.maximum.at(self.run_maxima[t], np.array(p) * runs // len(segments), np.array(x, np.float32))

    def search(self, terms: list[int], threshold: float) -> dict[int, float]:
        """All segments at or above ``threshold`` for a passage's distinct terms, by block-max WAND."""
        floor = threshold - 1e-9
        segs = [self.segments[t] for t in terms]
        imps, maxima = [self.impacts[t] for t in terms], [self.maxima[t] for t in terms]
        top = [self.largest[t] for t in terms]
        at = [0] * len(terms)
        live = sorted(range(len(terms)), key=lambda i: segs[i][0])
        found: dict[int, float] = {}
        while live:
            # the pivot: the first list at which the maxima so far can reach the threshold
            bound, pivot = 0.0, -1
            for place, i in enumerate(live):
                bound += top[i]
                if bound >= floor:
                    pivot = segs[i][at[i]]
                    break
            if pivot < 0:
                break
            while place + 1 < len(live) and segs[live[place + 1]][at[live[place + 1]]] == pivot:
                place += 1
            front = live[: place + 1]
            # the blocks that would hold the pivot
            block = {}
            for i in front:
                p = bisect_left(segs[i], pivot, at[i])
                block[i] = p
            reach = sum(maxima[i][p // POSTINGS_BLOCK] for i, p in block.items() if p < len(segs[i]))
            if reach >= floor:
                score = sum(imps[i][p] for i, p in block.items() if p < len(segs[i]) and segs[i][p] == pivot)
                if score >= floor:
                    found[pivot] = score
                next_at = pivot + 1
            else:
                # no segment before the first block's end, or before the next list's place, can reach it
                ends = [segs[i][min(len(segs[i]), (p // POSTINGS_BLOCK + 1) * POSTINGS_BLOCK) - 1] + 1 for i, p in block.items() if p < len(segs[i])]
                if place + 1 < len(live):
                    ends.append(segs[live[place + 1]][at[live[place + 1]]])
                next_at = max(pivot + 1, min(ends, default=pivot + 1))
            for i in front:
                at[i] = bisect_left(segs[i], next_at, block[i])
            live = sorted((i for i in live if at[i] < len(segs[i])), key=lambda i: segs[i][at[i]])
        return found

    def with_shingles(self, ids: list[np.ndarray]) -> list[set[int]]:
        """For each text (term numbers) the items of which it holds a looked-up shingle."""
        out: list[set[int]] = [set() for _ in ids]
        apart = np.full(SHINGLE, len(self.number), np.int32)
        flat = np.concatenate([y for x in ids for y in (x, apart)]) if ids else apart
        end = np.cumsum([len(x) + SHINGLE for x in ids])
        for size, (codes, items) in self.codes.items():
            code = coded(flat, size)
            at = np.searchsorted(codes, code)
            hit = np.flatnonzero(codes[np.minimum(at, len(codes) - 1)] == code)
            for text, k in zip(np.searchsorted(end, hit, "right").tolist(), at[hit].tolist()):
                same = codes[k]
                while k < len(codes) and codes[k] == same:
                    out[text].add(items[k])
                    k += 1
        return out

    def best_score(self, item: int, passages: list[np.ndarray]) -> float:
        """The largest score of an item's segments in any passage (its terms)."""
        best = 0.0
        for s in self.segments_of_item.get(item, []):
            weight = {}
            for w in {*self.items[item][1], *self.items[item][2]}:
                t = self.number[w]
                p = bisect_left(self.segments[t], s)
                if p < len(self.segments[t]) and self.segments[t][p] == s:
                    weight[t] = self.impacts[t][p]
            terms = np.array(sorted(weight), np.int64)
            values = np.array([weight[t] for t in terms.tolist()])
            best = max([best, *(float(values[np.isin(terms, x)].sum()) for x in passages)])
        return best

    def matches(self, text: str | None) -> list[tuple]:
        """Verified items of a whole text: (item id, best score, question share, answer share)."""
        return next(self.all_matches([text]))

    def all_matches(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            yield from self.some_matches(texts[i : i + TEXTS_AT_ONCE])

    def some_matches(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        absent = len(self.number)
        number = self.number.get
        cut = [words(t) for t in texts]
        ids = [np.fromiter((number(w, absent) for w in c), np.int32, len(c)) for c in cut]
        blocks = [-(-len(c) // SEGMENT) for c in cut]
        begin = np.cumsum([0, *blocks])
        # distinct terms of each block of words, and the sum of their largest impacts
        pairs = []
        for b, x in zip(begin.tolist(), ids):
            known = np.flatnonzero(x < absent)
            pairs.append((b + known // SEGMENT) * (absent + 1) + x[known])
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        of, term = pairs // (absent + 1), pairs % (absent + 1)
        edge = np.searchsorted(of, np.arange(int(begin[-1]) + 2))
        reach = np.zeros((int(begin[-1]) + 1, self.run_maxima.shape[1]), np.float32)
        filled = np.flatnonzero(np.diff(edge))
        if len(filled):
            reach[filled] = np.add.reduceat(self.run_maxima[term], edge[filled], axis=0)
        alone, both = reach.max(axis=1), (reach[:-1] + reach[1:]).max(axis=1)
        for text_words, b, n, held in zip(cut, begin.tolist(), blocks, self.with_shingles(ids)):
            best: dict[int, float | None] = {}
            # passages: blocks i and i + 1, a lone block in a short text
            last = max(1, n - 1) if n else 0
            bound = both[b : b + last] if n > 1 else alone[b : b + last]
            for i in np.flatnonzero(bound >= THRESHOLD - 1e-4).tolist():
                end = edge[b + min(i + 2, n)]
                terms = np.unique(term[edge[b + i] : end]).tolist()
                for s, score in self.search(terms, THRESHOLD).items():
                    item = self.item_of[s]
                    best[item] = max(best.get(item, 0.0), score)
            def passages(b=b, n=n, last=last) -> list[np.ndarray]:
                return [term[edge[b + i] : edge[b + min(i + 2, n)]] for i in range(last)]

            best |= dict.fromkeys(held - best.keys())
            yield self.verified(text_words, best, passages) if best else []

    def verified(self, text_words: list[str], best: dict[int, float | None], passages: Callable[[], list[np.ndarray]]) -> list[tuple]:
        """The items that pass the check; a score that is not known yet is taken over the ``passages``' terms."""
        out, sets = [], {}

        def share(part: list[str]) -> float:
            wanted, size = shingles(part), min(SHINGLE, len(part))
            if size not in sets:
                sets[size] = {tuple(text_words[i : i + size]) for i in range(len(text_words) - size + 1)}
            return sum(s in sets[size] for s in wanted) / len(wanted)

        for item, score in sorted(best.items()):
            key, question, answer = self.items[item]
            q = share(question) if question else 1.0
            a = share(answer) if answer else 1.0
            if q >= OVERLAP and a >= OVERLAP:
                out.append((key, self.best_score(item, passages()) if score is None else score, q, a))
        return out


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """One index after the other over blocks of the items."""
    rows = items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    parts = max(1, -(-size // block_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for part, item, t in zip(*(b.column(i).to_pylist() for i in (2, 0, 1))):
                found += [{"part": part, "item_id": item, "text": t, "words": w} for w in segments_of(words(t))]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([
                ("part", pa.int64()), ("item_id", b.schema.field(0).type), ("text", pa.string()), ("words", pa.list_(pa.string()))
            ]))

    kind = rows.schema["item_id"].dataType.simpleString()
    segments = rows.mapInArrow(cut, f"part long, item_id {kind}, text string, words array<string>").cache()
    whole = segments.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    spread = segments.select("part", F.explode(F.array_distinct("words")).alias("term"))
    frequency = spread.groupBy("term").agg(F.count("*").alias("n"))
    for part in range(parts if whole.n else 0):
        # one block of items, bounded by block_bytes
        found = segments.filter(F.col("part") == part).select("item_id", "text", "words").collect()
        terms = spread.filter(F.col("part") == part).select("term").distinct().join(frequency, "term").collect()
        place: dict[tuple, int] = {}
        cuts = [(place.setdefault((r["item_id"], r["text"]), len(place)), r["words"]) for r in sorted(found, key=lambda r: (str(r["item_id"]), r["text"]))]
        yield Index(list(place), cuts, {r["term"]: r["n"] for r in terms}, whole.n, whole.mean)
    segments.unpersist()


def matched(docs: DataFrame, items: DataFrame, *keep: Column, text: str = "text", item_key: str = "item_id",
            item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns plus ``item_id, bm25, question_overlap, answer_overlap``: one row for each text and verified item."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kind = items.schema[item_key].dataType
    schema = rows.drop("__text").schema.add("item_id", kind).add("bm25", "double").add("question_overlap", "double").add("answer_overlap", "double")
    out = None
    for index in indexes(items, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(shared.value.all_matches(b.column(b.num_columns - 1).to_pylist()))
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                flat = [x for f in found for x in f]
                columns = [b.column(i).take(at) for i in range(b.num_columns - 1)]
                columns.append(pa.array([x[0] for x in flat], arrow_type(kind)))
                columns += [pa.array([x[k] for x in flat], pa.float64()) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[kind.typeName()]


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a verified item, columns unchanged."""
    for index in indexes(items, item_key, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        place = docs.columns.index(text)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shared.value.all_matches(b.column(place).to_pylist())
                yield b.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
