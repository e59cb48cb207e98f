"""Exact top-k search by columnar branch and bound.

Vectors are turned into integers (``floor(scale * x)``) and dealt into
candidate blocks; a block is stored column by column (dimension-major).  For a
block of queries the inner products grow dimension block by dimension block.
After each, a candidate's product can grow at most by the product of the two
remaining norms (Cauchy-Schwarz); candidates whose bound stays below the
query's k-th best score so far leave, and the columns of the next dimension
block are gathered for the survivors alone.

The k-th best so far starts from a first pass over one block (real rows, so
their k-th score is a floor for the whole table) and rises within each block.
Partitions of query blocks meet partitions of candidate blocks in a Cartesian
product: a task reads both and holds about ``BLOCKS_PER_TASK`` candidate blocks
at most; the driver holds none, and no block is copied for each that it meets,
neither by a broadcast nor by a shuffle.  Each pair gives k rows a query at
most, and a ranking window (which keeps k rows a partition before its shuffle)
ends the search.

Scores are exact: sums are made in float64 while every partial sum stays below
2^53, else in Python integers; a score beyond 64 bits is an error.

Defined results: vectors that are null, empty or hold a null or a non-finite
component take no part; of two vectors of unequal length the missing
components count as zero; repeated rows are candidates of their own (all with
the query's own id are left out; a query
id with several vectors asks with the smallest); ties go to the smaller id; rows with a null
id take no part; fewer candidates than k give fewer rows; empty tables give
none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

ROWS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 256
DIMENSIONS_AT_ONCE = 8
#: Candidate blocks and query blocks of a task, about, and parts that the candidate blocks are dealt to at least.
BLOCKS_PER_TASK = 8
QUERY_BLOCKS_PER_TASK = 64
LEAST_PARTS = 64


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``v`` (array of whole doubles) of the rows that take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False)))
    return (
        vectors.select(F.col(key).cast("long").alias("id"), x.alias("x"), finite.alias("ok"))
        .filter("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND ok")
        .select("id", F.transform("x", lambda e: whole(e * F.lit(float(scale)))).alias("v"))
    )


def whole(y: Column) -> Column:
    """Floor as a double; from 2^52 on a double is whole already."""
    small = F.abs(y) < F.lit(2.0**52)
    return F.when(small, F.floor(F.when(small, y).otherwise(0.0)).cast("double")).otherwise(y)


def packed(rows: DataFrame, block: str, size: int) -> DataFrame:
    """``block, part, ids, width, data``: rows of one block as bytes, in parts of ``size`` rows, dimension-major."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        parts: dict[int, int] = {}

        def out(number: int) -> pa.RecordBatch:
            got = held.pop(number)
            width = max(len(v) for _, v in got)
            data = np.zeros((width, len(got)))
            for i, (_, v) in enumerate(got):
                data[: len(v), i] = v
            parts[number] = parts.get(number, -1) + 1
            ids = np.array([i for i, _ in got], np.int64)
            row = [[number], [parts[number]], [ids.tobytes()], [width], [data.tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))],
                names=["block", "part", "ids", "width", "data"],
            )

        for b in batches:
            for number, i, v in zip(*(b.column(k).to_pylist() for k in range(3))):
                held.setdefault(number, []).append((i, v))
                if len(held[number]) >= size:
                    yield out(number)
        for number in sorted(held):
            yield out(number)

    return rows.select(F.col(block).cast("int").alias("block"), "id", "v").repartition(block).mapInArrow(
        run, "block int, part int, ids binary, width int, data binary"
    )


def opened(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(data, np.float64).reshape(width, len(found))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, then smallest id."""
    if len(ids) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search_block(q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int,
                 seen: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id and the ids and scores of its k best in one candidate block, by branch and bound.

    ``queries`` and ``columns`` are dimension-major; only scores at or above
    the query's floor are needed.  ``seen`` counts the products made.
    """
    width = max(len(queries), len(columns))
    queries = np.pad(queries, ((0, width - len(queries)), (0, 0)))
    columns = np.pad(columns, ((0, width - len(columns)), (0, 0)))
    if not len(ids) or width * float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) >= 2.0**53:
        queries, columns = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, columns))
        for i, q in enumerate(q_ids.tolist()):
            other = np.flatnonzero(ids != q)
            scores = [int(x) for x in (queries[:, i] @ columns[:, other] if len(other) else [])]
            order = sorted(range(len(other)), key=lambda j: (-scores[j], ids[other[j]]))[:k]
            yield q, ids[other[order]], [scores[j] for j in order]
        return
    edges = [*range(0, width, DIMENSIONS_AT_ONCE), width]
    # norms of what is left after each dimension block, rounded up
    left = [np.sqrt(np.square(columns[e:]).sum(0)) * (1 + 1e-9) for e in edges[1:]]
    q_left = [np.sqrt(np.square(queries[e:]).sum(0)) * (1 + 1e-9) for e in edges[1:]]
    first = queries[: edges[1]].T @ columns[: edges[1]]
    for i, q in enumerate(q_ids.tolist()):
        total, alive = first[i], np.flatnonzero(ids != q)
        floor = floors[i]
        total = total[alive]
        if seen is not None:
            seen[0] += len(alive) * edges[1]
        for step in range(1, len(edges)):
            rest = left[step - 1][alive] * q_left[step - 1][i]
            # the k-th best lower bound is reached by k candidates, so it is a floor
            if len(alive) > k:
                lower = total - rest
                floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
            keep = total + rest >= floor
            alive, total = alive[keep], total[keep]
            if step == len(edges) - 1 or not len(alive):
                break
            a, b = edges[step], edges[step + 1]
            total = total + queries[a:b, i] @ columns[a:b, alive]
            if seen is not None:
                seen[0] += len(alive) * (b - a)
        top = best(ids[alive], total, k)
        yield q, ids[alive][top], total[top].astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024,
          rows: int = ROWS_PER_BLOCK, query_rows: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k rows of highest inner product with each row of ``is_query``."""
    kept = quantised(vectors.filter(F.col(key).isNotNull()), key, vector, scale)
    asked = quantised(vectors.filter(is_query), key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    total = kept.count()
    blocks = max(1, -(-total // rows))
    # dealt at random, so that equal rows spread as well
    table = written(packed(kept.withColumn("b", F.floor(F.rand(3) * blocks)), "b", rows), "vectors")
    asking = max(1, -(-asked.count() // query_rows))
    questions = packed(asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(asking))), "b", query_rows)
    questions = questions.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"))
    first = table.filter("block = 0 AND part = 0").repartition(1)
    floors = written(paired(questions.withColumn("floors", F.lit(None).cast("binary")), first, k), "floors")
    # the k-th score in one block is a floor of the k-th score in all
    least = floors.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k)
    known = (
        asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(asking))).join(least.hint("merge"), F.col("id") == F.col("query_id"), "left")
        .select("b", "id", "v", F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))).alias("floor"))
    )
    lists = known.withColumn("v", F.concat(F.array("floor"), "v")).select("b", "id", "v")
    led = packed(lists, "b", query_rows).select(
        F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"),
        F.lit(b"led").alias("floors"),
    )
    # written, for each partition of them is read once for each partition of the table
    led = written(led, "questions").coalesce(-(-asking // QUERY_BLOCKS_PER_TASK))
    # by ranges, for so few rows are dealt unevenly by a hash or in turns
    dealt = table.repartitionByRange(max(-(-blocks // BLOCKS_PER_TASK), min(blocks, LEAST_PARTS)), "block", "part")
    found = paired(led, dealt, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def paired(questions: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Best k of every pair of query block and candidate block, a task for each pair of their partitions.

    A task buffers its partition of ``table``.  If ``floors`` is set, row 0 of ``q_data`` holds the queries' floors.
    """
    pairs = questions.crossJoin(table.hint("shuffle_replicate_nl")).select("q_ids", "q_width", "q_data", "floors", "ids", "width", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                q_ids, q_width, q_data, led, ids, width, data = (b.column(i)[row].as_py() for i in range(7))
                asked, queries = opened(q_ids, q_width, q_data)
                floors = queries[0] if led else np.full(len(asked), -np.inf)
                queries = queries[1:] if led else queries
                columns: list[list] = [[], [], []]
                for q, found, scores in search_block(asked, queries, floors, *opened(ids, width, data), k):
                    columns[0] += [q] * len(found)
                    columns[1] += found.tolist()
                    columns[2] += [int(s) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def oracle(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    """DuckDB SQL for the search with the rows whose id is divisible by ``every`` as queries."""
    return f"""
    WITH ok AS (
      SELECT vec_id, [floor({scale} * x::DOUBLE)::HUGEINT FOR x IN embedding] AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT vec_id, row_number() OVER () AS r, v FROM ok),
    flat AS (SELECT vec_id, r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM parts),
    asked AS (
      SELECT vec_id, x, i FROM flat WHERE vec_id % {every} = 0 AND r IN (SELECT min(r) FROM parts GROUP BY vec_id)),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, c.r, sum(q.x * c.x)::BIGINT AS score
      FROM asked q JOIN flat c ON c.i = q.i AND c.vec_id <> q.vec_id GROUP BY ALL),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
