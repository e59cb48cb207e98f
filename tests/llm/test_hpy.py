import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import hpy
from tidewater.llm.common import fold
from tests.conftest import SF_SMALL


def shard_of(rng, words=60, contexts=9):
    pairs = sorted({(int(w), int(rng.integers(2)) << 8 | int(c)) for w, c in zip(rng.zipf(1.3, 4000) % words, rng.integers(0, contexts, 4000))})
    word = np.array([w for w, _ in pairs], np.uint64)
    context = np.array([c for _, c in pairs], np.int64)
    return hpy.Shard(word, context, rng.integers(0, 30, len(pairs)).astype(float))


def test_sweeps_keep_the_restaurants_consistent():
    rng = np.random.default_rng(0)
    shard = shard_of(rng)
    before = shard.seats[2].customers()
    for _ in range(6):
        shard.sweep(rng, shard.sums(), 1 / 61)
        assert (shard.seats[2].customers() == before).all()
        for level, n in ((2, len(shard.up1)), (1, shard.words)):
            sent = np.bincount(shard.parent[level], shard.seats[level].tables(), n)
            assert (shard.seats[level - 1].customers() == sent).all()
        for s in shard.seats:
            assert (s.size > 0).all() and (np.diff(s.dish) >= 0).all()
            assert ((s.tables() > 0) == (s.customers() > 0)).all()
    assert shard.seats[2].tables().sum() > (before > 0).sum()  # more than the one table that a dish begins with


def test_probabilities_sum_to_one():
    """Over all words and the unknown, in every context."""
    rng = np.random.default_rng(1)
    word = np.repeat(np.arange(40, dtype=np.uint64), 6)
    context = np.tile(np.array([3, 4, 256 + 3, 256 + 4, 512 + 3, 512 + 4]), 40)
    order = np.lexsort((context, word))
    shard = hpy.Shard(word[order], context[order], rng.integers(0, 5, 240).astype(float))
    known = int((shard.count > 0).sum())
    shard.sweep(rng, shard.sums(), 1 / (known + 1))
    totals = shard.sums()
    p = shard.probabilities(totals, 1 / (known + 1))
    # the unknown: each level's escape to the uniform base
    unknown = 1 / (known + 1)
    above = {0: unknown}
    for level in range(3):
        mass = Counter()
        for x, c in zip(p[level].tolist(), shard.context[level].tolist()):
            mass[c] += x
        nxt = {}
        for c in mass:
            customers, tables = (float(x[c]) for x in totals[level])
            up = above[0] if level == 0 else above[0 if level == 1 else c & 255]
            nxt[c] = (hpy.STRENGTH[level] + hpy.DISCOUNT[level] * tables) / (hpy.STRENGTH[level] + customers) * up
            never = int((shard.count == 0).sum())  # words of no training customer hold the unknown's place each
            assert math.isclose(mass[c] + nxt[c] * (1 - never), 1.0, rel_tol=1e-9)
        above = nxt


def brute(rows):
    counts = Counter(w for _, out, t in rows if not out for w in hpy.tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {
        d: (out, len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        for d, out, t in rows for w in [hpy.tokens(t)]
    }


def check(got, rows):
    want = brute(rows)
    for r in got:
        out, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    assert len(got) == len(rows)


def test_matches_brute_force_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.out, r.text) for r in docs.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("out"), "text").collect()]
    got = hpy.score(docs, fold(F.col("doc_id"), 10) == 0, batch_bytes=60_000, shard_bytes=100_000).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("score")
    out = F.col("doc_id") == 8
    got = hpy.score(docs, out).collect()
    rows = [(r.doc_id, r.doc_id == 8, r.text) for r in docs.collect()]
    assert len(got) == 11
    want = Counter()
    for d, o, t in rows:
        want[(d, o, len(hpy.tokens(t)))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens) for r in got) == want
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert hpy.score(docs.filter(F.lit(False)), out).count() == 0
    nothing = hpy.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)} and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in nothing)


def exact_tables(c, a, d):
    """Mean number of tables of a dish of ``c`` customers: weights a^t times generalised Stirling numbers."""
    row = np.array([0.0, a])
    for n in range(1, c):
        row = np.append(row, 0.0)
        t = np.arange(len(row))
        row = np.maximum(n - d * t, 0) * row + a * np.append(0.0, row[:-1])
        row /= row.sum()
    return float((np.arange(len(row)) * row).sum())


def test_a_sweep_seats_every_customer_again():
    """Few sweeps reach the exact number of tables, at small and large counts."""
    rng = np.random.default_rng(4)
    for d in hpy.DISCOUNT:
        for c, a in ((2, 0.5), (5, 1.0), (12, 20.0), (60, 0.3), (60, 6.0), (400, 40.0), (3000, 15.0)):
            seats = hpy.Seating.spread(np.full(3000, float(c)), np.full(3000, a), d)
            for _ in range(8):
                seats.reseat(rng, np.full(3000, a), d)
            assert (seats.customers() == c).all() and (np.diff(seats.dish) >= 0).all()
            assert math.isclose(seats.tables().mean(), exact_tables(c, a, d), rel_tol=0.07), (d, c, a)


def test_seating_outlives_a_round():
    rng = np.random.default_rng(5)
    shard = shard_of(rng)
    for _ in range(3):
        shard.sweep(rng, shard.sums(), 1 / 61)
    again = [hpy.Seating.unpacked(s.packed()) for s in shard.seats]
    assert all((x.dish == y.dish).all() and (x.size == y.size).all() and x.n == y.n for x, y in zip(again, shard.seats))
    assert shard.seats[2].tables().max() > 4


def test_rows_of_whole_shards_cross_to_python_one_by_one(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, write = spark.conf.get(name), hpy.written

    def noted(df, table, group_bytes=None):
        seen[table] = (int(spark.conf.get(name)), group_bytes)
        return write(df, table, group_bytes)

    monkeypatch.setattr(hpy, "written", noted)
    docs = spark.createDataFrame([(i, "one two three") for i in range(20)], "doc_id long, text string")
    assert hpy.score(docs, fold(F.col("doc_id"), 10) == 0).count() == 20
    assert seen["batches"][0] <= 1000 and seen["seats"][0] == 1 and all(g for _, g in seen.values())
    assert spark.conf.get(name) == before


def test_contexts_are_whole_words(spark):
    """Words that end alike foretell different words."""
    rows = [(i, "xaab one" if i % 2 else "yaab two") for i in range(400)] + [(1000, "xaab one"), (1001, "xaab two"), (1002, "yaab two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    score = {r.doc_id: r.score for r in hpy.score(docs, F.col("doc_id") >= 1000, batch_bytes=600, shard_bytes=700).collect()}
    assert score[1000] > score[1001] + 1 and score[1002] > score[1001] + 1


def test_totals_are_those_of_all_shards(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {"c": Counter(), "t": Counter()}
    names = np.unique(rng.integers(0, 1 << hpy.CONTEXT_BITS, 40).astype(np.uint64))
    for slot in range(5):
        for part in range(2):
            own = np.sort(rng.choice(names[part::2], 12, replace=False))
            c, t = (rng.integers(0, 9, 12).astype("<u8") for _ in range(2))
            rows.append((slot, part, hpy.pack(np.diff(own, prepend=np.uint64(0))), hpy.pack(c), hpy.pack(t), own.tolist()))
            for k, x in (("c", c), ("t", t)):
                want[k].update(dict(zip(own.tolist(), x.tolist())))
    asked = spark.createDataFrame([r[:5] for r in rows], "slot long, part int, names binary, c binary, t binary")
    got = {(r.slot, r.part): r for r in hpy.totalled(asked).collect()}
    assert len(got) == len(rows)
    for slot, part, _, _, _, own in rows:
        for k in ("c", "t"):
            assert hpy.unpack(got[slot, part][k], "<u8").tolist() == [want[k][x] for x in own]


def test_pairs_are_shuffled_once(spark):
    """Rounds and answers meet the buckets that the pairs lie in; only small rows go to them."""
    docs = spark.createDataFrame([(i, f"one two three n{i}") for i in range(300)], "doc_id long, text string")
    found = hpy.score(docs, fold(F.col("doc_id"), 10) == 0, batch_bytes=500, shard_bytes=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2 and found.count() == 300
    # of a FlatMapCoGroups' two sides the bucketed one comes first, straight from its scan
    assert all("Exchange" not in part.split("Bucketed: true")[0] for part in plan.split("FlatMapCoGroupsInArrow")[1:])
