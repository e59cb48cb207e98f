"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source has a target repetition rate: its weight times the wanted number
of rows over the rows it has.  A document's number of copies is the inverse
of the Poisson distribution with that mean at a uniform number drawn by a
seeded hash of its key, so the same seed gives the same mix on any cluster.
Documents are exploded by their counts and all copies are sorted by a hash of
key and copy, which shuffles them globally.

Sources named in ``weights`` get their weight; the others, and rows without a
source, share what is left in proportion to their sizes (one common rate).
Weights of absent sources go to the others in proportion.  The driver sees one
count per named source and one for the rest, bounded by the parameter.

Defined results: rows with equal keys draw the same count; a null key draws
as the empty key; texts are carried as they are; an empty table gives no
rows; a source of weight 0 disappears.  Very long texts travel as any other
column.  Helper columns take a prefix that no input column has, so all extra
columns pass through; an input column named like ``copy``, in any case of its
letters, is replaced by the copy's number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A uniform number has this many bits.
BITS = 52


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... up to the last value below the largest uniform number."""
    steps, total, k = [], 0.0, 0
    while rate > 0 and (total < 1 - 2.0**-BITS or k <= rate):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if steps and total == steps[-1] and k > rate:
            break
        steps.append(total)
        k += 1
    return steps


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("double") / F.lit(2.0**BITS)


def rates(docs: DataFrame, weights: dict[str, float], size: float = 1.0, source: str = "source") -> tuple[dict[str, float], float]:
    """Repetition rate of each named source that is present, and of all others; ``size`` times the rows are wanted."""
    if min(weights.values(), default=0) < 0 or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be 0 or more and sum to 1 at most")
    named = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    counts = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}
    wanted = size * sum(counts.values())
    share = {s: weights[s] for s in counts if s is not None}
    if None in counts:
        share[None] = max(0.0, 1 - sum(weights.values()))
    total = sum(share.values())
    found = {s: w / total * wanted / counts[s] if total else 0.0 for s, w in share.items()}
    return {s: r for s, r in found.items() if s is not None}, found.get(None, 0.0)


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 0, size: float = 1.0, key: str = "doc_id",
        source: str = "source", copy: str | None = None) -> DataFrame:
    """``docs`` mixed to ``weights`` and shuffled; ``copy`` names a column for the copy's number, from 1."""
    named, rest = rates(docs, weights, size, source)
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    draw = F.col(f"{prefix}u")

    def count(rate: float) -> Column:
        steps = poisson_steps(rate)
        return F.size(F.filter(F.array(*map(F.lit, steps)), lambda p: p <= draw)) if steps else F.lit(0)

    copies = count(rest)
    for s, rate in named.items():
        copies = F.when(F.col(source) == F.lit(s), count(rate)).otherwise(copies)
    times, number = F.col(f"{prefix}n"), F.col(f"{prefix}copy")
    out = (
        docs.withColumn(f"{prefix}u", uniform(seed, F.col(key)))
        .withColumn(f"{prefix}n", copies)
        .filter(times > 0)
        .withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1), times)))
        .withColumn(f"{prefix}order", F.xxhash64(F.lit(seed), F.col(key), number))
        .withColumn(f"{prefix}tie", F.rand(seed))  # splits equal keys over partitions
        .orderBy(f"{prefix}order", f"{prefix}tie")
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if copy is None or c.lower() != copy.lower()]
    return out.select(*kept, *([number.alias(copy)] if copy else []))


def oracle(weights: dict[str, float], seed: int, size: float = 1.0) -> str:
    """DuckDB SQL for ``mix(documents, weights, seed, size, copy="copy")``."""
    listed = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in weights.items())
    return f"""
    WITH weights(source, w) AS (VALUES {listed}),
    docs AS (
      SELECT d.*, w.source AS named,
             ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT / pow(2, {BITS}) AS u
      FROM documents d LEFT JOIN weights w ON w.source = d.source),
    counts AS (SELECT named, count(*) AS n FROM docs GROUP BY named),
    shares AS (
      SELECT c.named, c.n, coalesce(w.w, 1 - (SELECT sum(w) FROM weights)) AS share
      FROM counts c LEFT JOIN weights w ON w.source = c.named),
    rates AS (
      SELECT named, share / sum(share) OVER () * {size!r} * sum(n) OVER () / n AS rate FROM shares),
    pmf AS (
      SELECT named, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
      FROM rates, (SELECT unnest(generate_series(0, 2000)) AS k) WHERE rate > 0),
    cdf AS (SELECT named, k, sum(p) OVER (PARTITION BY named ORDER BY k) AS c FROM pmf),
    drawn AS (
      SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (
        SELECT min(k) FROM cdf WHERE cdf.named IS NOT DISTINCT FROM d.named AND cdf.c > d.u) AS copies FROM docs d)
    SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, copies))::INTEGER AS copy FROM drawn WHERE copies > 0
    """
