import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import helpers
from tidewater.llm import oddsketch


def shingles(text, k=3):
    w = helpers.words(text)
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(a, b, percent=85):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def expected(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = helpers.groups(len(rows), lambda i, j: linked(sets[i], sets[j], percent))
    out = []
    for (d, _), s, r in zip(rows, sets, root):
        ids = [rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None]
        component = min(ids, default=None) if s else d
        out.append((d, len(s), component, d == component))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sets_and_sizes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " ".join(rng.choice(["Alpha", "beta", "ümlaut", "x", " y"]) for _ in range(n))
        assert len(oddsketch.shingle_set(t, 3)) == len(shingles(t))
    assert len(oddsketch.shingle_set(None, 3)) == len(oddsketch.shingle_set(" \t\r\n", 3)) == 0
    long = "word " * 400_000 + "x" * (3 << 20) + " end of it"
    assert len(oddsketch.shingle_set(long, 3)) == len(shingles(long))


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(2)
    for share in (0.95, 0.9, 0.85):
        found = []
        for _ in range(60):
            common = rng.integers(0, 1 << 63, int(800 * share), np.uint64)
            rest = (800 - len(common)) // 2
            a, b = (np.append(common, rng.integers(0, 1 << 63, rest, np.uint64)) for _ in range(2))
            x, y = (oddsketch.odd_sketch(oddsketch.minhashes(s, 192)) for s in (a, b))
            z = int(np.bitwise_count(x ^ y).sum())
            assert z <= oddsketch.most_bits(85, 192)
            found.append(oddsketch.estimated(z, 192))
        assert abs(np.mean(found) - len(common) / (len(common) + 2 * rest)) < 0.02
    far = [oddsketch.odd_sketch(oddsketch.minhashes(rng.integers(0, 1 << 63, 300, np.uint64), 192)) for _ in range(40)]
    apart = [int(np.bitwise_count(a ^ b).sum()) for i, a in enumerate(far) for b in far[:i]]
    assert np.mean(np.array(apart) > oddsketch.most_bits(85, 192)) > 0.99


def families(rng, count, size, words, change):
    """Texts in families of near copies, chained by single changed words."""
    rows = []
    for f in range(count):
        text = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            for _ in range(change):
                text[rng.randrange(words)] = f"n{rng.randrange(5000)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, part_bytes", [(4096, 2 << 20), (4, 9000)])
def test_components_match_brute_force(spark, chunk, part_bytes):
    """Chains of near copies, copies, short texts; with parts and buckets far smaller than the groups too."""
    rng = random.Random(4)
    texts = families(rng, 6, 30, 120, 2) + families(rng, 40, 2, 60, 2) + families(rng, 1, 40, 120, 0)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(60)] + [None, None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(oddsketch.near_duplicates(docs, chunk=chunk, part_bytes=part_bytes)) == expected(rows)


def test_groups_of_groups_that_are_not_linked(spark):
    """One candidate group (sketches leave them together) of several true groups in many parts."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for f in range(4):
        own = base[:170] + [f"f{f}x{i}" for i in range(30)]
        for _ in range(20):
            t = list(own)
            t[rng.randrange(170)] = f"n{rng.randrange(9999)}"
            rows.append(" ".join(t))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(oddsketch.near_duplicates(docs, chunk=8, part_bytes=20_000)) == expected(rows)


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(oddsketch.near_duplicates(docs)) == expected(rows)
    assert oddsketch.near_duplicates(docs.filter(F.lit(False))).count() == 0


def test_query(spark):
    from tidewater.llm.queries import op12_minhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(op12_minhash(spark, SF_SMALL)) == expected(rows)


def test_meetings_of_a_large_group_are_thinned(spark):
    """In every band each member is found from one of few: one link a member is left, and the same components."""
    rng = np.random.default_rng(2)
    heads, members = list(range(6)), list(range(6, 2006))
    rows = sorted({(int(rng.integers(6)), m) for m in members for _ in range(32)} | {(5000, 5001), (5001, 5002), (5000, 5002)})
    edges = spark.createDataFrame(rows, "a long, b long")
    thin = oddsketch.thinned(edges)
    assert len(rows) > 4 * len(members) and thin.count() <= len(members) + 15 + 3
    labels = {r.node: r.label for r in oddsketch.components(thin).collect()}
    assert set(labels) == {*heads, *members, 5000, 5001, 5002}
    assert {labels[x] for x in (*heads, *members)} == {0} and {labels[x] for x in (5000, 5001, 5002)} == {5000}


def test_parts_name_their_classes_without_components(spark, monkeypatch):
    """Only the candidate groups, and the links between groups found in parts, need components."""
    rng, calls = random.Random(8), []
    rows = list(enumerate(families(rng, 3, 40, 120, 6)))
    counted = oddsketch.components
    monkeypatch.setattr(oddsketch, "components", lambda edges: calls.append(1) or counted(edges))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(oddsketch.near_duplicates(docs, chunk=8, part_bytes=20_000)) == expected(rows)
    assert len(calls) <= 2


def test_sets_are_made_when_asked_for(monkeypatch):
    """A text whose sketch rules out all others is not hashed again."""
    made, real = [], oddsketch.shingle_set
    monkeypatch.setattr(oddsketch, "shingle_set", lambda t, k: made.append(t) or real(t, k))
    texts = [" ".join(f"{c}{i}" for i in range(300)) for c in "abc"] + [" ".join(f"b{i}" for i in range(301))]
    sketches = np.array([oddsketch.odd_sketch(oddsketch.minhashes(real(t, 3), 192)) for t in texts])
    found = oddsketch.true_groups(oddsketch.sets_of(texts, 3), sketches, oddsketch.most_bits(85, 192), 85)
    assert found == [(1, 3)] and sorted(made) == sorted([texts[1], texts[3]])


def test_only_texts_of_large_groups_come_again(spark, monkeypatch):
    """After the first search, texts of groups with one part are not shuffled."""
    rng, asked, real = random.Random(9), [], oddsketch.maybe_members

    def counted(texts, members, slot_bits):
        asked.append(real(texts, members, slot_bits).count())
        return real(texts, members, slot_bits)

    monkeypatch.setattr(oddsketch, "maybe_members", counted)
    rows = list(enumerate(families(rng, 1, 40, 120, 2) + families(rng, 30, 2, 60, 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(oddsketch.near_duplicates(docs, part_bytes=20_000)) == expected(rows)
    assert len(asked) == 2 and asked[1] <= 40 < asked[0]
